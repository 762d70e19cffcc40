"""DuckDB SQL for the registered queries that SQL can express."""

ORACLES = {
    "op5_pfair_mixing": """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS n_chars,
         CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS key,
         coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS hash
  FROM documents),
placed AS (
  SELECT *, coalesce(sum(n_chars + 1) OVER (PARTITION BY key ORDER BY hash, doc_id, n_chars
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows_),
weights AS (
  SELECT key, sqrt(CAST(sum(n_chars + 1) AS DOUBLE)) AS weight FROM rows_ GROUP BY key),
shares AS (
  SELECT key, greatest(268435456 // (SELECT greatest(256, 12 * count(*)) FROM weights),
    CAST(floor(weight / (SELECT sum(weight) FROM weights) * 268435456 + 0.5) AS BIGINT)) AS n
  FROM weights),
all_ AS (
  SELECT list(key ORDER BY key) AS keys, list(n ORDER BY key) AS ns, CAST(sum(n) AS BIGINT) AS h,
         CAST(count(*) AS BIGINT) AS k FROM shares),
last_ AS (SELECT max(((start // 20000 + 1) * h + n - 1) // n) AS t_end FROM placed JOIN shares USING (key), all_),
schedule AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, [CAST(0 AS BIGINT) FOR x IN keys] AS done FROM all_
  UNION ALL
  SELECT t + 1, pick_, [done[i] + CASE WHEN i = pick_ THEN 1 ELSE 0 END FOR i IN range(1, k + 1)]
  FROM (
    SELECT t, done, k, list_aggregate([CASE WHEN (done[i] * h) // ns[i] <= t + 1
        THEN (((done[i] + 1) * h + ns[i] - 1) // ns[i]) * 100000 + i END FOR i IN range(1, k + 1)], 'min') % 100000 AS pick_
    FROM schedule, all_, last_ WHERE t + 1 < t_end)),
slots AS (
  SELECT keys[pick] AS key, t AS slot, done[pick] - 1 AS block FROM schedule, all_ WHERE t >= 0)
SELECT p.doc_id, p.source, p.n_chars, p.start, l.block, (l.block * h) // s.n AS release,
       ((l.block + 1) * h + s.n - 1) // s.n AS deadline, l.slot
FROM placed p JOIN shares s USING (key) CROSS JOIN all_ JOIN slots l ON l.key = p.key AND l.block = p.start // 20000""",
    "op9_deletion_neighbourhood_lines": """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no,
         list_filter(string_split(translate(lines[i], chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda w: w <> '') AS words
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)),
firsts AS (
  SELECT words, min((doc_id, line_no)) AS f, len(words) AS n FROM lines WHERE len(words) > 0 GROUP BY words),
joined AS (SELECT words, f, n, array_to_string(words, ' ') AS s FROM firsts WHERE n <= 8),
units AS (
  SELECT 'word' AS unit, words, f, words AS u, n FROM firsts WHERE n >= 8
  UNION ALL
  SELECT 'character', words, f, [substring(s, i, 1) FOR i IN range(1, length(s) + 1)], length(s) FROM joined WHERE length(s) >= 8),
halves AS (
  SELECT *, CASE side WHEN 0 THEN u[1:m] ELSE u[n - m + 1:n] END AS half
  FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS m FROM units),
       (VALUES (0), (1)) AS sides(side)),
pairs AS (
  SELECT DISTINCT x.unit, x.words, x.u, x.n, x.f, y.u AS other, y.n AS other_n, y.f AS other_f
  FROM halves x JOIN halves y ON x.unit = y.unit AND x.side = y.side AND x.m = y.m AND x.half = y.half
  WHERE y.f < x.f AND abs(x.n - y.n) <= 1),
near AS (
  SELECT words, min(other_f) AS g FROM pairs
  WHERE len(list_filter(range(1, greatest(n, other_n) + 1),
          lambda i: CASE WHEN n = other_n THEN list_concat(u[1:i - 1], u[i + 1:n]) = list_concat(other[1:i - 1], other[i + 1:n])
                    WHEN n > other_n THEN list_concat(u[1:i - 1], u[i + 1:n]) = other
                    ELSE list_concat(other[1:i - 1], other[i + 1:other_n]) = u END)) > 0
  GROUP BY words)
SELECT l.doc_id, l.line_no, len(l.words) AS n_words,
       coalesce(f.f[1], l.doc_id) AS first_doc_id, coalesce(f.f[2], l.line_no) AS first_line_no,
       g.g[1] AS near_doc_id, g.g[2] AS near_line_no,
       f.f IS NULL OR (f.f = (l.doc_id, l.line_no) AND g.g IS NULL) AS kept
FROM lines l LEFT JOIN firsts f ON l.words = f.words LEFT JOIN near g ON l.words = g.words""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS sizes(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, c, x.f AS l, y.f AS r, n,
         CAST(CAST(1000 AS HUGEINT) * s.f * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM split) s JOIN totals USING (lang)
  JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:c], ' ')
  JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[c + 1:s.k], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS pick FROM cuts),
longer AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM split))
  GROUP BY ALL),
kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM best b LEFT JOIN longer USING (lang, phrase) WHERE pick = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM kept WHERE rank <= 2000""",
    "op12_conversation_trie": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS t
  FROM turns GROUP BY conv_id),
bits AS (
  SELECT conv_id, t, CAST(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))) AS BIGINT) AS c
  FROM own),
heads AS (SELECT conv_id, t, xor(c, CAST(4294967295 AS BIGINT)) % 4 AS h FROM bits),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(o.t, [])[1:h], h.t[h + 1:len(h.t)]) AS t
  FROM heads h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20),
rows_ AS (
  SELECT conv_id, d, md5(CAST(to_json(t[1:d]) AS VARCHAR)) AS node,
         CASE WHEN d > 0 THEN md5(CAST(to_json(t[1:d - 1]) AS VARCHAR)) END AS parent, d = len(t) AS is_end,
         CASE WHEN d > 0 THEN len(regexp_extract_all(t[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, min(d) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM rows_ GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
below AS (SELECT DISTINCT x.node, y.node AS lower FROM rows_ x JOIN rows_ y ON x.conv_id = y.conv_id AND y.d >= x.d),
sums AS (
  SELECT b.node, CAST(sum(saved) AS BIGINT) AS saved_tokens, count_if(n_children IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.node = b.lower LEFT JOIN children c ON c.node = b.lower GROUP BY b.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = n.parent""",
}
