"""DuckDB SQL that analyses the enriched pages on its own, by regular expressions.

It knows the shape of the enriched markup (see ``carriers``) and shares nothing
with the Spark side but the documents.
"""

from __future__ import annotations

from checks.carriers import ENRICHED, LINK_REDIRECTED, LINK_STATUS, sql_select
from crawlglass.functions.text import GENERIC_ANCHORS, NARROW_CHARS, WIDE_CHARS
from crawlglass.operators.structured import SCHEMA_REQUIRED

SPACE = "chr(32) || chr(9) || chr(10) || chr(13) || chr(160)"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, {SPACE})"


def decode(x: str) -> str:
    for entity, code in (("&copy;", 169), ("&middot;", 183), ("&nbsp;", 160), ("&quot;", 34), ("&#39;", 39), ("&lt;", 60), ("&gt;", 62), ("&amp;", 38)):
        x = f"replace({x}, '{entity}', chr({code}))"
    return x


def norm(x: str) -> str:
    return f"rtrim(regexp_replace({x}, '#.*$', ''), '/')"


def root_host(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^[a-zA-Z]+://([^/?#]*)', 1), '^(?i)www[.]', '')"


def resolve(h: str) -> str:
    return (
        f"CASE WHEN {h} = '' THEN final_url WHEN regexp_matches({h}, '^[a-z]+:') THEN {h} "
        f"WHEN starts_with({h}, '/') THEN origin || {h} ELSE origin || substr({h}, 3) END"
    )


def texts(markup: str) -> str:
    nodes = f"string_split_regex({markup}, '<[^>]*>')"
    return f"list_filter(list_transform({nodes}, lambda n: {trim(decode('n'))}), lambda n: n <> '')"


def pixels(x: str, font: int) -> str:
    width = (
        f"CASE WHEN contains({quote(NARROW_CHARS)}, c) THEN CAST(0.3 AS DOUBLE) WHEN contains({quote(WIDE_CHARS)}, c) THEN CAST(0.85 AS DOUBLE) "
        f"WHEN regexp_matches(c, '^\\p{{Lu}}') THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END"
    )
    units = f"list_prepend(CAST(0 AS DOUBLE), list_transform(regexp_extract_all({x}, '(?s).'), lambda c: {width}))"
    return f"CAST(floor(list_reduce({units}, lambda a, b: a + b) * {font}) AS INTEGER)"


def count(markup: str, regex: str) -> str:
    return f"CAST(len(regexp_extract_all({markup}, '{regex}')) AS INTEGER)"


def meta(attribute: str, name: str) -> str:
    return f"""regexp_extract(alltags, '<meta {attribute}="{name}" content="([^"]*)"', 1)"""


_REQUIRED = ", ".join(f"({quote(t)}, {i}, {quote(p)})" for t, ps in SCHEMA_REQUIRED.items() for i, p in enumerate(ps))

CTES = f"""
src AS ({sql_select(ENRICHED, 'pages')}),
st AS (
  SELECT * REPLACE (
      CASE WHEN error IS NULL THEN final_url ELSE '' END AS final_url,
      CASE WHEN error IS NULL THEN status_code ELSE -1 END AS status_code,
      CASE WHEN error IS NULL THEN redirect_codes ELSE '' END AS redirect_codes,
      CASE WHEN error IS NULL THEN response_time_ms ELSE 0 END AS response_time_ms,
      CASE WHEN error IS NULL THEN content_type ELSE '' END AS content_type,
      CASE WHEN error IS NULL THEN content_encoding ELSE '' END AS content_encoding,
      CASE WHEN error IS NULL THEN cache_control ELSE '' END AS cache_control,
      CASE WHEN error IS NULL THEN x_robots_tag ELSE '' END AS x_robots_tag,
      CASE WHEN error IS NULL THEN link_header ELSE '' END AS link_header,
      error IS NULL AND hsts AS hsts),
    error IS NULL AND starts_with(final_url, 'https://') AS is_https,
    CASE WHEN error IS NOT NULL OR length_header = '' THEN 0
         ELSE coalesce(TRY_CAST(length_header AS BIGINT), strlen(html)) END AS content_length,
    CASE WHEN error IS NOT NULL THEN 'failed' WHEN status_code >= 400 THEN 'error'
         WHEN NOT contains(lower(content_type), 'html') THEN 'non_html' ELSE 'html' END AS audit_stage
  FROM src),
dc AS (
  SELECT *, audit_stage <> 'html' OR regexp_matches(html, '<(head|title|meta)[ >]') AS parse_ok,
    audit_stage = 'html' AND regexp_matches(html, '<(head|title|meta)[ >]') AS audited,
    CASE WHEN audit_stage = 'html' AND regexp_matches(html, '<(head|title|meta)[ >]') THEN html ELSE '' END AS doc,
    regexp_extract(final_url, '^https?://[^/]+') AS origin, {root_host('final_url')} AS site
  FROM st),
mk AS (
  SELECT *, regexp_replace(doc, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<!>', 'g') AS alltags FROM dc),
vi AS (
  SELECT *, regexp_replace(alltags, '(?s)<noscript>.*?</noscript>', '<!>', 'g') AS vis FROM mk),
f1 AS (
  SELECT *,
    {trim(decode("regexp_extract(alltags, '<title>([^<]*)</title>', 1)"))} AS title,
    {trim(decode(meta('name', 'description')))} AS meta_description,
    regexp_extract(alltags, '(?i)<meta name="robots" content="([^"]*)"', 1) AS meta_robots,
    list_transform(regexp_extract_all(alltags, '<link rel="canonical" href="([^"]*)"', 1), lambda h: {resolve('h')}) AS canonicals,
    regexp_extract(CASE WHEN audited THEN link_header ELSE '' END, '<([^>]+)>; rel="?canonical"?', 1) AS header_canonical,
    regexp_extract(alltags, '<html lang="([^"]*)"', 1) AS lang,
    {meta('name', 'viewport')} AS viewport,
    regexp_extract(alltags, '<meta charset="([^"]*)"', 1) AS charset,
    regexp_extract(alltags, '<base href="([^"]*)"', 1) AS base_href,
    regexp_extract(alltags, '<link rel="[a-z -]*icon" href="([^"]*)"', 1) AS icon_href,
    regexp_extract(alltags, '<link rel="next" href="([^"]*)"', 1) AS next_href,
    regexp_extract(alltags, '<link rel="prev" href="([^"]*)"', 1) AS prev_href,
    list_transform(regexp_extract_all(alltags, '(?s)<h1>(.*?)</h1>', 1), lambda e: array_to_string({texts('e')}, '')) AS h1s,
    list_transform(regexp_extract_all(alltags, '<h([1-6])>', 1), lambda l: CAST(l AS INTEGER)) AS levels,
    array_to_string({texts('vis')}, ' ') AS page_text,
    regexp_extract_all(vis, '<link rel="alternate" hreflang="[^"]*" href="[^"]*">') AS alternates,
    regexp_extract_all(vis, '<meta property="og:[^"]*" content="[^"]+">') AS ogs,
    regexp_extract_all(vis, '<meta name="twitter:[^"]*" content="[^"]+">') AS twitters,
    regexp_extract_all(vis, '<img [^>]*>') AS imgs,
    regexp_extract_all(doc, '(?s)<script type="application/ld[+]json">(.*?)</script>', 1) AS scripts,
    flatten(list_transform(regexp_extract_all(alltags, 'itemtype="([^"]*)"', 1), lambda t: string_split(t, ' '))) AS itemtypes
  FROM vi),
f2 AS (
  SELECT *,
    CAST(length(title) AS INTEGER) AS title_length, {pixels('title', 20)} AS title_pixel_width,
    CAST(length(meta_description) AS INTEGER) AS meta_description_length,
    {pixels('meta_description', 14)} AS meta_description_pixel_width,
    CASE WHEN len(canonicals) > 0 THEN canonicals[1] ELSE header_canonical END AS canonical,
    CAST(len(canonicals) AS INTEGER) + CASE WHEN header_canonical <> '' THEN 1 ELSE 0 END AS canonical_count,
    CASE WHEN len(canonicals) > 0 AND header_canonical <> '' THEN 'link+header' WHEN len(canonicals) > 0 THEN 'link'
         WHEN header_canonical <> '' THEN 'header' ELSE '' END AS canonical_source,
    len(list_distinct(list_transform(CASE WHEN header_canonical <> '' THEN list_append(canonicals, header_canonical) ELSE canonicals END, lambda u: {norm('u')}))) > 1 AS canonical_conflict,
    audited AND contains(lower(meta_robots || ' ' || x_robots_tag), 'noindex') AS is_noindex,
    CASE WHEN icon_href = '' THEN '' ELSE {resolve('icon_href')} END AS favicon,
    CASE WHEN next_href = '' THEN '' ELSE {resolve('next_href')} END AS pagination_next,
    CASE WHEN prev_href = '' THEN '' ELSE {resolve('prev_href')} END AS pagination_prev,
    CAST(len(h1s) AS INTEGER) AS h1_count,
    list_concat(
      CASE WHEN len(levels) > 0 AND levels[1] <> 1 THEN ['First heading is H' || levels[1] || ', not H1'] ELSE [] END,
      list_transform(list_filter(range(1, greatest(len(levels), 1)), lambda i: levels[i + 1] - levels[i] > 1),
                     lambda i: 'Skipped from H' || levels[i] || ' to H' || levels[i + 1])) AS order_issues,
    CASE WHEN page_text = '' THEN 0 ELSE CAST(len(regexp_extract_all(page_text, '[^ \\n\\t\\r]+')) AS INTEGER) END AS word_count,
    list_transform(alternates, lambda a: regexp_extract(a, 'hreflang="([^"]*)"', 1)) AS langs,
    list_transform(list_transform(alternates, lambda a: regexp_extract(a, ' href="([^"]*)"', 1)), lambda h: {resolve('h')}) AS alt_hrefs,
    list_distinct(list_transform(ogs, lambda m: regexp_extract(m, 'property="([^"]*)"', 1))) AS og_names,
    list_distinct(list_transform(twitters, lambda m: regexp_extract(m, 'name="([^"]*)"', 1))) AS twitter_names,
    CAST(len(imgs) AS INTEGER) AS images_total,
    CAST(len(list_filter(imgs, lambda i: NOT regexp_matches(i, ' alt="[^"]+"'))) AS INTEGER) AS images_missing_alt,
    CAST(len(list_filter(imgs, lambda i: NOT (regexp_matches(i, ' width="[^"]+"') AND regexp_matches(i, ' height="[^"]+"')))) AS INTEGER) AS images_missing_dimensions,
    CAST(len(list_filter(imgs, lambda i: contains(i, 'loading="lazy"'))) AS INTEGER) AS images_lazy_loaded,
    CASE WHEN is_https THEN {count('vis', '<(?:img|iframe|source|video|audio) [^>]*src="http://')} + {count('vis', '<link [^>]*href="http://')} ELSE 0 END AS mixed_content,
    CAST(len(scripts) AS INTEGER) AS jsonld_scripts,
    CAST(len(list_filter(scripts, lambda s: s <> '' AND NOT json_valid(s))) AS INTEGER) AS jsonld_invalid,
    array_to_string(list_sort(list_distinct(list_transform(itemtypes, lambda t: regexp_extract(rtrim(t, '/'), '[^/]*$')))), '|') AS microdata_types,
    regexp_matches(alltags, '<[a-z][^>]* (typeof|vocab)=') AS rdfa_used
  FROM f1),
facts AS (
  SELECT *,
    canonical <> '' AND {norm('canonical')} = {norm('final_url')} AS canonical_is_self,
    CASE WHEN audit_stage = 'failed' THEN 'request failed: ' || error WHEN audit_stage = 'error' THEN 'HTTP ' || status_code
         WHEN audit_stage = 'non_html' THEN 'non-HTML content'
         WHEN NOT parse_ok AND lower(content_encoding) NOT IN ('', 'gzip', 'deflate', 'identity') THEN 'undecodable content (' || lower(content_encoding) || ')'
         WHEN NOT parse_ok THEN 'empty/JS-rendered HTML' WHEN is_noindex THEN 'noindex directive' ELSE '' END AS indexability_reason,
    array_to_string(canonicals, '|') AS canonical_links,
    array_to_string(h1s, '|') AS h1,
    array_to_string(order_issues, '|') AS heading_order_issues,
    array_to_string(list_transform(range(1, len(langs) + 1), lambda i: langs[i] || '>' || alt_hrefs[i]), '|') AS hreflang,
    list_contains(list_transform(langs, lambda l: lower(l)), 'x-default') AS hreflang_has_xdefault,
    list_contains(list_transform(alt_hrefs, lambda h: {norm('h')}), {norm('final_url')}) AS hreflang_self,
    list_filter(langs, lambda l: lower(l) <> 'x-default' AND NOT regexp_full_match(l, '[a-z]{{2,3}}(-[a-zA-Z]{{2,4}})?')) AS bad_codes,
    list_filter(['og:title', 'og:image', 'og:url', 'og:type'], lambda n: NOT list_contains(og_names, n)) AS missing_og,
    array_to_string(list_sort(list_transform(og_names, lambda n: n || '=' || {decode("regexp_extract(list_last(list_filter(ogs, lambda m: contains(m, n))), 'content=\"([^\"]*)\"', 1)")})), '|') AS og_tags,
    array_to_string(list_sort(list_transform(twitter_names, lambda n: n || '=' || {decode("regexp_extract(list_last(list_filter(twitters, lambda m: contains(m, n))), 'content=\"([^\"]*)\"', 1)")})), '|') AS twitter_tags,
    CAST(length(page_text) AS INTEGER) AS visible_chars,
    CAST(length(html) AS INTEGER) AS html_chars
  FROM f2),
"""

LINKS = f"""
la AS (
  SELECT crawl_seq, final_url, origin, site, unnest(l) AS a, unnest(range(len(l))) AS i
  FROM (SELECT *, regexp_extract_all(vis, '(?s)<a [^>]*>.*?</a>') AS l FROM facts)),
lb AS (
  SELECT *, {trim(decode('''regexp_extract(a, '^<a [^>]*href="([^"]*)"', 1)'''))} AS href,
    lower(regexp_extract(a, '^<a [^>]*rel="([^"]*)"', 1)) AS rel,
    array_to_string({texts("regexp_extract(a, '(?s)^<a [^>]*>(.*)</a>$', 1)")}, '') AS label, contains(a, '<img ') AS has_img
  FROM la),
lc AS (
  SELECT *, {norm(resolve('href'))} AS target FROM lb WHERE NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)')),
links AS (
  SELECT crawl_seq, CAST(row_number() OVER (PARTITION BY crawl_seq ORDER BY i) - 1 AS INTEGER) AS pos, target AS url,
    {root_host('target')} = site AS is_internal, starts_with(target, 'http') AS is_web,
    contains(rel, 'nofollow') AS nofollow, contains(rel, 'sponsored') AS sponsored, contains(rel, 'ugc') AS ugc,
    label = '' AND NOT has_img AS is_empty, lower(label) IN ({', '.join(map(quote, GENERIC_ANCHORS))}) AS is_generic
  FROM lc),
link_counts AS (
  SELECT crawl_seq, CAST(count_if(is_internal) AS INTEGER) AS internal_links,
    CAST(count_if(NOT is_internal AND is_web) AS INTEGER) AS external_links,
    CAST(count_if(nofollow) AS INTEGER) AS nofollow_links, CAST(count_if(sponsored) AS INTEGER) AS sponsored_links,
    CAST(count_if(ugc) AS INTEGER) AS ugc_links, CAST(count_if(is_empty) AS INTEGER) AS empty_anchor_links,
    CAST(count_if(is_generic) AS INTEGER) AS generic_anchor_links
  FROM links GROUP BY crawl_seq),
"""

JSONLD = f"""
required AS (SELECT * FROM (VALUES {_REQUIRED}) AS r(type, ord, prop)),
ld AS (
  SELECT crawl_seq, unnest(scripts) AS script, unnest(range(len(scripts))) AS script_pos FROM facts),
ldo AS (
  SELECT ld.crawl_seq, ld.script_pos, j.id AS node_id, j.value AS node, json_extract_string(j.value, '$."@type"') AS type
  FROM ld, json_tree(CASE WHEN json_valid(script) THEN script ELSE '{{}}' END) AS j
  WHERE j.type = 'OBJECT' AND json_extract_string(j.value, '$."@type"') IS NOT NULL),
gaps AS (
  SELECT DISTINCT crawl_seq, type || ' schema missing required: ' || string_agg(prop, ', ' ORDER BY ord) AS message
  FROM ldo JOIN required USING (type)
  WHERE coalesce(CAST(json_extract(node, '$.' || prop) AS VARCHAR), 'null') IN ('null', '""', '[]', '{{}}', '0', 'false')
  GROUP BY crawl_seq, script_pos, node_id, type),
"""

_MESSAGES = [
    (1, "audit_stage = 'failed'", "'Request failed: ' || error"),
    (2, "redirect_codes <> ''", "'Redirect chain: [' || redirect_codes || '] -> ' || final_url"),
    (3, "audit_stage = 'error'", "'Error status: ' || status_code"),
    (4, "NOT parse_ok AND lower(content_encoding) NOT IN ('', 'gzip', 'deflate', 'identity')",
     "'Response sent as ''' || lower(content_encoding) || ''' but no decoder installed — content unreadable. Install it (e.g. pip install brotli) or the crawler advertises only gzip/deflate.'"),
    (5, "NOT parse_ok AND lower(content_encoding) IN ('', 'gzip', 'deflate', 'identity')",
     "'No HTML structure found (likely JS-rendered; needs a headless browser to audit).'"),
    (6, "audited AND title = ''", "'Missing <title>'"),
    (6, "audited AND title_length > 60", "'Title too long (' || title_length || ' chars)'"),
    (6, "audited AND title <> '' AND title_length < 10", "'Title very short (' || title_length || ' chars)'"),
    (7, "audited AND title_pixel_width > 580", "'Title likely truncated in SERP (~' || title_pixel_width || 'px > 580px)'"),
    (8, "audited AND meta_description = ''", "'Missing meta description'"),
    (8, "audited AND meta_description_length > 160", "'Meta description too long (' || meta_description_length || ' chars)'"),
    (9, "audited AND meta_description_pixel_width > 1000", "'Meta description likely truncated in SERP (~' || meta_description_pixel_width || 'px > 1000px)'"),
    (10, "is_noindex", "'Page is noindex'"),
    (11, "audited AND canonical = ''", "'Missing canonical tag'"),
    (11, "audited AND canonical <> '' AND NOT canonical_is_self", "'Canonical points elsewhere: ' || canonical"),
    (12, "audited AND canonical_conflict", "'Conflicting canonical tags (' || canonical_count || ' found)'"),
    (13, "audited AND indexability_reason <> '' AND canonical_is_self", "'Conflict: noindex + self-canonical'"),
    (14, "audited AND lang = ''", "'Missing lang attribute on <html>'"),
    (15, "audited AND viewport = ''", "'Missing viewport meta (mobile)'"),
    (15, "audited AND (contains(viewport, 'user-scalable=no') OR regexp_matches(viewport, 'maximum-scale= *1\\b'))", "'Viewport disables zoom (user-scalable=no)'"),
    (16, "audited AND h1_count = 0", "'No H1 found'"),
    (16, "audited AND h1_count > 1", "'Multiple H1s (' || h1_count || ')'"),
    (17, "audited AND len(order_issues) > 0", "'Broken heading order (' || order_issues[1] || ')'"),
    (20, "audited AND word_count < 200", "'Thin content (' || word_count || ' words)'"),
    (21, "len(langs) > 0 AND NOT hreflang_has_xdefault", "'hreflang set has no x-default'"),
    (22, "len(langs) > 0 AND NOT hreflang_self", "'hreflang set omits a self-referencing entry'"),
    (23, "len(bad_codes) > 0", "'Invalid hreflang code(s): ' || array_to_string(bad_codes[1:3], ', ')"),
    (24, "len(og_names) > 0 AND len(missing_og) > 0", "'Incomplete Open Graph (missing: ' || array_to_string(missing_og, ', ') || ')'"),
    (25, "len(twitter_names) > 0 AND NOT list_contains(twitter_names, 'twitter:card')", "'Twitter Card present but missing twitter:card type'"),
    (26, "images_missing_alt > 0", "images_missing_alt || ' image(s) missing alt text'"),
    (27, "images_missing_dimensions > 0", "images_missing_dimensions || ' image(s) missing width/height (CLS)'"),
    (28, "empty_anchor_links > 0", "empty_anchor_links || ' link(s) with empty anchor text'"),
    (29, "generic_anchor_links > 0", "generic_anchor_links || ' link(s) with generic anchor text'"),
    (30, "mixed_content > 0", "mixed_content || ' insecure (HTTP) resource(s) on HTTPS page'"),
]

PAGE_ISSUES = (
    "fl AS (SELECT facts.*, coalesce(internal_links, 0) AS internal_links, coalesce(external_links, 0) AS external_links,"
    " coalesce(nofollow_links, 0) AS nofollow_links, coalesce(sponsored_links, 0) AS sponsored_links, coalesce(ugc_links, 0) AS ugc_links,"
    " coalesce(empty_anchor_links, 0) AS empty_anchor_links, coalesce(generic_anchor_links, 0) AS generic_anchor_links"
    " FROM facts LEFT JOIN link_counts USING (crawl_seq)),\npage_issues AS ("
    + "\nUNION ALL ".join(
        f"SELECT crawl_seq, {seq} AS seq, 0 AS pos, {message} AS message FROM fl WHERE {condition}"
        for seq, condition, message in _MESSAGES
    )
    + "\nUNION ALL SELECT crawl_seq, 18, CAST(unnest(range(jsonld_invalid)) AS INTEGER), 'Invalid JSON-LD structured data' FROM facts"
    + "\nUNION ALL SELECT crawl_seq, 19, 0, message FROM gaps),\n"
)

STATUS = f"""
targets AS (
  SELECT DISTINCT url FROM (
    SELECT url FROM links WHERE is_web
    UNION ALL SELECT {norm('canonical')} FROM facts WHERE canonical <> '' AND NOT canonical_is_self)),
link_status AS (SELECT url, {LINK_STATUS} AS status, {LINK_REDIRECTED} AS redirected FROM targets WHERE length(url) % 5 <> 0),
faulty AS (
  SELECT crawl_seq, pos, url, status, status = -1 OR status >= 400 AS broken
  FROM links JOIN link_status USING (url) WHERE is_web AND (status = -1 OR status >= 400 OR redirected)),
page_faults AS (
  SELECT crawl_seq, CAST(count_if(broken) AS INTEGER) AS n_broken, CAST(count_if(NOT broken) AS INTEGER) AS n_redirecting,
    coalesce(string_agg(url || ' ' || status, '|' ORDER BY pos) FILTER (broken), '') AS broken_links,
    coalesce(string_agg(url || ' ' || status, '|' ORDER BY pos) FILTER (NOT broken), '') AS redirecting_links
  FROM faulty GROUP BY crawl_seq),
canonical_status AS (
  SELECT crawl_seq, {norm('canonical')} AS url, coalesce(status, 0) AS status, coalesce(redirected, false) AS redirected
  FROM facts LEFT JOIN link_status ON link_status.url = {norm('canonical')}
  WHERE canonical <> '' AND NOT canonical_is_self),
"""

DUPLICATES = f"""
dup_values AS (
  SELECT crawl_seq, 0 AS pos, 'Duplicate title' AS label, title AS value FROM facts WHERE parse_ok AND title <> ''
  UNION ALL SELECT crawl_seq, 1, 'Duplicate meta description', meta_description FROM facts WHERE parse_ok AND meta_description <> ''
  UNION ALL SELECT crawl_seq, 2, 'Duplicate H1', h1s[1] FROM facts WHERE parse_ok AND h1_count = 1 AND h1s[1] <> ''
  UNION ALL SELECT crawl_seq, 3, 'Duplicate canonical target', {norm('canonical')} FROM facts WHERE parse_ok AND canonical_is_self),
dup_members AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY label, value) AS n FROM dup_values) WHERE n > 1),
"""

HREFLANG = f"""
by_url AS (SELECT {norm("CASE WHEN final_url <> '' THEN final_url ELSE url END")} AS norm, max(crawl_seq) AS crawl_seq FROM facts GROUP BY 1),
edges AS (
  SELECT crawl_seq, {norm("CASE WHEN final_url <> '' THEN final_url ELSE url END")} AS src, unnest(langs) AS lang,
    unnest(alt_hrefs) AS href, unnest(range(len(langs))) AS pos FROM facts),
edn AS (SELECT *, {norm('href')} AS dst FROM edges),
unreciprocated AS (
  SELECT crawl_seq, arg_min(href, pos) AS href FROM edn
  WHERE lower(lang) <> 'x-default' AND EXISTS (SELECT 1 FROM by_url WHERE by_url.norm = edn.dst)
    AND NOT EXISTS (SELECT 1 FROM edn b JOIN by_url w ON w.crawl_seq = b.crawl_seq WHERE w.norm = edn.dst AND b.dst = edn.src)
  GROUP BY crawl_seq),
"""

SITE_ISSUES = """
site_issues AS (
  SELECT crawl_seq, 31 AS seq, pos, label || ' (shared by ' || n || ' pages)' AS message FROM dup_members
  UNION ALL SELECT crawl_seq, 32, 0, 'hreflang not reciprocated by ' || href FROM unreciprocated
  UNION ALL SELECT crawl_seq, 33, 0, n_broken || ' broken link(s)' FROM page_faults WHERE n_broken > 0
  UNION ALL SELECT crawl_seq, 34, 0, n_redirecting || ' redirecting link(s)' FROM page_faults WHERE n_redirecting > 0
  UNION ALL SELECT crawl_seq, 35, 0, 'Canonical target is unreachable (HTTP ' || status || ')' FROM canonical_status WHERE status = -1 OR status >= 400
  UNION ALL SELECT crawl_seq, 35, 0, 'Canonical points to a redirect' FROM canonical_status WHERE status <> -1 AND status < 400 AND redirected),
issues AS (SELECT * FROM page_issues UNION ALL SELECT * FROM site_issues),
"""

ALL = CTES + LINKS + JSONLD + PAGE_ISSUES + STATUS + DUPLICATES + HREFLANG + SITE_ISSUES


def query(select: str, ctes: str = ALL) -> str:
    return "WITH RECURSIVE " + ctes.strip().rstrip(",") + "\n" + select
