"""Every registered query: a Spark callable, and the SQL it is compared with."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from checks import carriers as C, facts_sql as Q
from crawlglass.functions import text as T, urls
from crawlglass.operators import duplicates, hreflang, link_status, rules, tally
from crawlglass.operators.body import heading_steps
from crawlglass.operators.edges import store_edges
from crawlglass.plans import crawl
from crawlglass.plans.page_audit import as_report, extract, page_columns, page_facts
from crawlglass.plans.run import audit_run
from crawlglass.plans.site_audit import apply_findings, issue_rows, site_findings
from crawlglass.schema import REPORT_TYPES
from crawlglass.sinks import report as sinks
from crawlglass.sources import fetch_log, robots, sitemaps, url_list
from crawlglass.storage import materialize, new_path
from crawlglass.streaming import audit as streaming

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


# ---------------------------------------------------------------- flat columns
_FLAT = {
    "redirect_codes": lambda: F.array_join(F.col("redirect_chain").cast("array<string>"), ", "),
    "canonical_links": lambda: F.array_join("canonical_links", "|"),
    "h1": lambda: F.array_join("h1", "|"),
    "heading_order_issues": lambda: F.array_join("heading_order_issues", "|"),
    "hreflang": lambda: F.array_join(F.transform("hreflang", lambda h: F.concat(h.lang, F.lit(">"), h.href)), "|"),
    "bad_codes": lambda: F.array_join(F.slice("bad_hreflang_codes", 1, 3), ", "),
    "og_tags": lambda: _joined_map("og_tags"),
    "twitter_tags": lambda: _joined_map("twitter_tags"),
    "microdata_types": lambda: F.array_join("microdata_types", "|"),
    "schema_types": lambda: F.array_join(F.array_sort(F.array_distinct("schema_types")), "|"),
    "schema_gaps": lambda: F.array_join(F.array_sort("schema_gaps"), "|"),
}
_SOURCE_COLUMN = {"redirect_codes": "redirect_chain", "bad_codes": "bad_hreflang_codes"}


def _joined_map(name: str):
    entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), "|")


def _flat(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[(_FLAT[n]() if n in _FLAT else F.col(n)).alias(n) for n in names])


def enriched(names: list[str]):
    """Spark side of a per-page projection over the enriched pages."""

    def run(spark, sf_dir):
        columns = ["crawl_seq", *names]
        source = list(dict.fromkeys(_SOURCE_COLUMN.get(n, n) for n in columns))
        return _flat(page_columns(C.enriched_log(spark, sf_dir), source), columns)

    return run


def narrow(spark, sf_dir, names: list[str]) -> DataFrame:
    """Named facts of the enriched pages, written once for passes that read them repeatedly."""
    return materialize(page_columns(C.enriched_log(spark, sf_dir), ["crawl_seq", *names]), "facts")


PROJECTIONS = {
    "src_pages": ["url", "final_url", "status_code", "redirect_codes", "response_time_ms", "content_type", "content_encoding",
                  "cache_control", "x_robots_tag", "hsts", "is_https", "content_length"],
    "prj_structure_guard": ["audit_stage", "parse_ok", "indexability_reason"],
    "prj_title": ["title", "title_length"],
    "prj_meta_description": ["meta_description", "meta_description_length"],
    "prj_meta_robots": ["meta_robots"],
    "prj_canonical_links": ["canonical_links"],
    "prj_header_canonical": ["header_canonical"],
    "prj_canonical": ["canonical", "canonical_count", "canonical_source", "canonical_is_self"],
    "prj_lang": ["lang"],
    "prj_viewport": ["viewport"],
    "prj_charset": ["charset"],
    "prj_base_href": ["base_href"],
    "prj_favicon": ["favicon"],
    "prj_pagination": ["pagination_next", "pagination_prev"],
    "prj_security_headers": ["is_https", "hsts", "content_encoding", "cache_control", "content_length"],
    "prj_headings": ["h1", "h1_count"],
    "prj_heading_order": ["heading_order_issues"],
    "prj_word_count": ["word_count"],
    "prj_text_ratio": ["visible_chars", "html_chars", "text_html_ratio"],
    "prj_jsonld": ["jsonld_scripts", "jsonld_invalid"],
    "prj_microdata": ["microdata_types"],
    "prj_rdfa": ["rdfa_used"],
    "prj_hreflang": ["hreflang", "hreflang_has_xdefault"],
    "prj_og": ["og_tags"],
    "prj_twitter": ["twitter_tags"],
    "prj_images": ["images_total", "images_missing_alt", "images_missing_dimensions", "images_lazy_loaded"],
    "prj_mixed_content": ["mixed_content"],
}
_ORACLE_COLUMN = {
    "bad_codes": "array_to_string(bad_codes[1:3], ', ')",
    "text_html_ratio": "CAST((visible_chars::BIGINT * 2000 + greatest(html_chars, 1)) // (2 * greatest(html_chars, 1)) AS DOUBLE) / 1000",
}
for _name, _columns in PROJECTIONS.items():
    register(
        _name, enriched(_columns),
        Q.query("SELECT crawl_seq, " + ", ".join(f"{_ORACLE_COLUMN.get(c, c)} AS {c}" for c in _columns) + " FROM facts", Q.CTES),
    )
register("prj_fetch_verdict", enriched(["status_code", "audit_stage", "parse_ok", "indexable", "indexability_reason"]),
         Q.query("SELECT crawl_seq, status_code, audit_stage, parse_ok, indexability_reason = '' AS indexable, indexability_reason FROM facts", Q.CTES))
register("prj_indexability", enriched(["meta_robots", "x_robots_tag", "indexable"]),
         Q.query("SELECT crawl_seq, meta_robots, x_robots_tag, indexability_reason = '' AS indexable FROM facts", Q.CTES))
register("prj_hreflang_checks", enriched(["hreflang_has_xdefault", "bad_codes"]),
         Q.query("SELECT crawl_seq, hreflang_has_xdefault, array_to_string(bad_codes[1:3], ', ') AS bad_codes FROM facts", Q.CTES))
register("limit_bad_codes", enriched(["bad_codes"]),
         Q.query("SELECT crawl_seq, array_to_string(bad_codes[1:3], ', ') AS bad_codes FROM facts", Q.CTES))
_LEVELS = ", ".join(f"CAST(len(list_filter(levels, lambda l: l = {n})) AS INTEGER) AS h{n}_count" for n in range(1, 7))
register("agg_counts", enriched([*[f"h{n}_count" for n in range(1, 7)], "images_total", "mixed_content"]),
         Q.query(f"SELECT crawl_seq, {_LEVELS}, images_total, mixed_content FROM facts", Q.CTES))
register("agg_set", enriched(["microdata_types", "schema_types"]),
         Q.query("SELECT crawl_seq, microdata_types, coalesce(t, '') AS schema_types FROM facts LEFT JOIN "
                 "(SELECT crawl_seq, array_to_string(list_sort(list_distinct(list(type))), '|') AS t FROM ldo GROUP BY 1) USING (crawl_seq)", Q.CTES + Q.JSONLD))
register("agg_any", enriched(["parse_ok", "rdfa_used", "hreflang_has_xdefault"]),
         Q.query("SELECT crawl_seq, parse_ok, rdfa_used, hreflang_has_xdefault FROM facts", Q.CTES))
register("prj_schema_types", enriched(["schema_types"]), Q.query(
    "SELECT crawl_seq, coalesce(t, '') AS schema_types FROM facts LEFT JOIN "
    "(SELECT crawl_seq, array_to_string(list_sort(list_distinct(list(type))), '|') AS t FROM ldo GROUP BY 1) USING (crawl_seq)", Q.CTES + Q.JSONLD))
register("prj_schema_required", enriched(["schema_gaps"]), Q.query(
    "SELECT crawl_seq, coalesce(g, '') AS schema_gaps FROM facts LEFT JOIN "
    "(SELECT crawl_seq, string_agg(message, '|' ORDER BY message) AS g FROM gaps GROUP BY 1) USING (crawl_seq)", Q.CTES + Q.JSONLD))
_COUNTS = ["internal_links", "external_links", "nofollow_links", "sponsored_links", "ugc_links", "empty_anchor_links", "generic_anchor_links"]
_COUNT_SQL = "SELECT facts.crawl_seq, {} FROM facts LEFT JOIN link_counts USING (crawl_seq)"


def _count_sql(names):
    return Q.query(_COUNT_SQL.format(", ".join(f"coalesce({c}, 0) AS {c}" for c in names)), Q.CTES + Q.LINKS)


register("agg_link_rel", enriched(_COUNTS), _count_sql(_COUNTS))
register("prj_anchor_quality", enriched(_COUNTS[-2:]), _count_sql(_COUNTS[-2:]))


def _pixel_width(spark, sf_dir):
    docs = C.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select(
        "doc_id", T.pixel_width(F.col("text"), 20).alias("title_px"), T.pixel_width(F.col("text"), 14).alias("description_px")
    )


register("prj_pixel_width", _pixel_width,
         f"SELECT doc_id, {Q.pixels('text', 20)} AS title_px, {Q.pixels('text', 14)} AS description_px FROM documents")


def _social_checks(spark, sf_dir):
    f = extract(C.enriched_log(spark, sf_dir), names={"og_tags", "twitter_tags", "canonical"})
    return f.select(
        "crawl_seq",
        F.when(F.size("og_tags") > 0, F.array_join("_missing_og", ", ")).otherwise("").alias("missing_og"),
        F.coalesce((F.size("twitter_tags") > 0) & ~F.map_contains_key("twitter_tags", "twitter:card"), F.lit(False)).alias("missing_card"),
    )


register("prj_social_checks", _social_checks, Q.query(
    "SELECT crawl_seq, CASE WHEN len(og_names) > 0 THEN array_to_string(missing_og, ', ') ELSE '' END AS missing_og, "
    "len(twitter_names) > 0 AND NOT list_contains(twitter_names, 'twitter:card') AS missing_card FROM facts", Q.CTES))


def _canonical_norms(spark, sf_dir):
    f = extract(C.enriched_log(spark, sf_dir), names={"canonical"})
    links = F.concat("canonical_links", F.filter(F.array("header_canonical"), lambda c: c != ""))
    norms = F.coalesce(F.array_distinct(F.transform(links, urls.normalize)), F.array().cast("array<string>"))
    return f.select("crawl_seq", F.array_join(F.array_sort(norms), "|").alias("canonicals"), F.coalesce("_canonical_conflict", F.lit(False)).alias("conflict"))


_CANON_SQL = ("list_distinct(list_transform(CASE WHEN header_canonical <> '' THEN list_append(canonicals, header_canonical) ELSE canonicals END, lambda u: "
              + Q.norm("u") + "))")
_CONFLICT_SQL = Q.query(
    f"SELECT crawl_seq, array_to_string(list_sort({_CANON_SQL}), '|') AS canonicals, canonical_conflict AS conflict FROM facts", Q.CTES)
register("prj_canonical_conflict", _canonical_norms, _CONFLICT_SQL)
register("set_canonical_distinct", _canonical_norms, _CONFLICT_SQL)

# ---------------------------------------------------------------- URL functions
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def url_query(**columns):
    def run(spark, sf_dir):
        return C.spark_pages(spark, sf_dir).select("page_id", *[c(F.col("url")).alias(n) for n, c in columns.items()])

    return run


register("url_split", url_query(scheme=urls.scheme, netloc=urls.netloc, path=urls.path, query=urls.query, fragment=urls.fragment),
         f"SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {_HOST} AS netloc, {_PATH} AS path, "
         "regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
register("url_defrag", url_query(defragged=urls.defrag), "SELECT page_id, regexp_replace(url, '#.*$', '') AS defragged FROM pages")
register("url_normalize", url_query(norm=urls.normalize), f"SELECT page_id, {Q.norm('url')} AS norm FROM pages")
register("url_root_host", url_query(root_host=urls.site_of), f"SELECT page_id, {Q.root_host('url')} AS root_host FROM pages")
_BARE = "regexp_replace({}, '^(m|blog)[.]', '')"
register("url_same_site", url_query(same_site=lambda u: urls.same_site(u, F.regexp_replace(urls.netloc(u), r"^(m|blog)\.", ""))),
         f"SELECT page_id, {Q.root_host('url')} = {_BARE.format(_HOST)} AS same_site FROM pages")
register("url_skip_ext", url_query(skipped=lambda u: urls.has_skipped_extension(F.concat(F.regexp_replace(u, r"\.html$", ".PDF"), F.lit("#x.png")))),
         f"SELECT page_id, regexp_matches(regexp_extract(regexp_replace(url, '[.]html$', '.PDF'), '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)[.](pdf|png|jpe?g|xml|json|csv|js|css|zip|gz)$') AS skipped FROM pages")
register("url_scheme_filter", url_query(has_scheme=urls.has_web_scheme, bare=lambda u: urls.has_web_scheme(F.regexp_replace(u, "^https?:", ""))),
         "SELECT page_id, regexp_matches(url, '^https?://') AS has_scheme, regexp_matches(regexp_replace(url, '^https?:', ''), '^https?://') AS bare FROM pages")
register("url_xml_unescape", url_query(unescaped=lambda u: urls.xml_unescape(F.concat(F.replace(F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("="), F.lit("&amp;lt;")), F.lit("&gt;&#39;&quot;")))),
         "SELECT page_id, replace(url, '=', '<') || '>''\"' AS unescaped FROM pages")
_REFS = ["../x", "?y=2", "//O.com/z", "/abs/./q?a=1", "rel/../a//b", "#f", "", "mailto:a@b", "HTTP://h.example/P/../q"]


def _url_join(spark, sf_dir):
    pages = C.spark_pages(spark, sf_dir).select("page_id", "url", F.explode(F.array(*map(F.lit, _REFS))).alias("ref"))
    return pages.select("page_id", "ref", urls.join(F.col("url"), F.col("ref")).alias("joined"))


_DIR = "regexp_replace(path, '[^/]*$', '')"
register("url_join", _url_join, f"""
WITH b AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS sch, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, {_PATH} AS path,
  regexp_replace(url, '#.*$', '') AS nofrag, regexp_extract(url, '^[^?#]*') AS noquery FROM pages),
r AS (SELECT * FROM b, (SELECT unnest({_REFS}) AS ref))
SELECT page_id, ref, CASE ref
  WHEN '../x' THEN origin || coalesce(nullif(regexp_replace({_DIR}, '[^/]+/$', ''), ''), '/') || 'x'
  WHEN '?y=2' THEN noquery || '?y=2' WHEN '//O.com/z' THEN sch || '://O.com/z' WHEN '/abs/./q?a=1' THEN origin || '/abs/q?a=1'
  WHEN 'rel/../a//b' THEN origin || {_DIR} || 'a/b' WHEN '#f' THEN nofrag || '#f' WHEN '' THEN url WHEN 'mailto:a@b' THEN ref
  ELSE CASE WHEN sch = 'http' THEN 'http://h.example/P/../q' ELSE ref END END AS joined
FROM r""")

# ---------------------------------------------------------------- links
_LINK_COLUMNS = ["pos", "url", "is_internal", "is_web", "nofollow", "sponsored", "ugc", "is_empty", "is_generic"]


def _links(spark, sf_dir):
    f = page_columns(C.enriched_log(spark, sf_dir), ["crawl_seq", "links"])
    return f.select("crawl_seq", F.explode("links").alias("l")).select("crawl_seq", *[f"l.{c}" for c in _LINK_COLUMNS])


register("prj_links", _links, Q.query(f"SELECT crawl_seq, {', '.join(_LINK_COLUMNS)} FROM links", Q.CTES + Q.LINKS))
register("join_generic_anchor", lambda s, d: _links(s, d).filter("is_generic").select("crawl_seq", "pos", "url"),
         Q.query("SELECT crawl_seq, pos, url FROM links WHERE is_generic", Q.CTES + Q.LINKS))
register("win_heading_lag", lambda s, d: heading_steps(C.enriched_log(s, d)), Q.query(
    "SELECT crawl_seq, CAST(i AS INTEGER) AS pos, CASE WHEN i > 0 THEN levels[i] END AS previous, levels[i + 1] AS level "
    "FROM (SELECT crawl_seq, levels, unnest(range(len(levels))) AS i FROM facts)", Q.CTES))

# ---------------------------------------------------------------- rules
_SITE_COLUMNS = ["url", "final_url", "parse_ok", "title", "meta_description", "h1", "h1_count", "canonical", "canonical_is_self", "hreflang", "links"]


def spark_link_status(facts):
    """Statuses for most link targets, as a function of the target's text."""
    return (
        link_status.distinct_targets(facts).filter("length(url) % 5 <> 0")
        .selectExpr("url", f"{C.LINK_STATUS} AS status", f"{C.LINK_REDIRECTED} AS redirected")
    )


def audited(spark, sf_dir):
    facts = materialize(page_facts(C.enriched_log(spark, sf_dir)), "facts")
    return apply_findings(facts, site_findings(facts, materialize(spark_link_status(facts), "status")))


def page_issue_rows(spark, sf_dir):
    return rules.explode_issues(page_facts(C.enriched_log(spark, sf_dir)))


_SITE_RULES = {31: duplicates, 32: hreflang, 33: link_status, 34: link_status, 35: link_status}


def _rule(seq: int):
    def run(spark, sf_dir):
        if seq <= 30:
            return page_issue_rows(spark, sf_dir).filter(F.col("seq") == seq).select("crawl_seq", "message")
        if seq == 31:
            facts = narrow(spark, sf_dir, _SITE_COLUMNS[2:9])
            return duplicates.duplicate_issues(duplicates.duplicate_candidates(facts)).select("crawl_seq", "message")
        if seq == 32:
            return hreflang.hreflang_issues(narrow(spark, sf_dir, ["url", "final_url", "hreflang"])).select("crawl_seq", "message")
        facts = narrow(spark, sf_dir, ["canonical", "canonical_is_self", "links"])
        status = materialize(spark_link_status(facts), "status")
        if seq == 35:
            found = link_status.canonical_status(facts, status)
            message = link_status.canonical_message(F.col("status"), F.col("redirected"))
            return found.select("crawl_seq", message.alias("message")).filter(F.col("message").isNotNull())
        column, label = {33: ("broken_links", " broken link(s)"), 34: ("redirecting_links", " redirecting link(s)")}[seq]
        found = link_status.page_link_findings(link_status.faulty_links(facts, status))
        return found.filter(F.size(column) > 0).select("crawl_seq", F.concat(F.size(column), F.lit(label)).alias("message"))

    return run


for _seq in range(1, 36):
    register(f"flt_rule_{_seq}", _rule(_seq), Q.query(f"SELECT crawl_seq, message FROM issues WHERE seq = {_seq}"))
register("issue_rules", lambda s, d: page_issue_rows(s, d).select("crawl_seq", "seq", "message"),
         Q.query("SELECT crawl_seq, seq, message FROM page_issues", Q.CTES + Q.LINKS + Q.JSONLD + Q.PAGE_ISSUES))
register("flt_unparsed", lambda s, d: page_columns(C.enriched_log(s, d), ["crawl_seq", "parse_ok", "title"]).filter("parse_ok").select("crawl_seq", "title"),
         Q.query("SELECT crawl_seq, title FROM facts WHERE parse_ok", Q.CTES))
register("join_schema_required", lambda s, d: page_columns(C.enriched_log(s, d), ["crawl_seq", "schema_gaps"])
         .select("crawl_seq", F.explode("schema_gaps").alias("message")),
         Q.query("SELECT crawl_seq, message FROM gaps", Q.CTES + Q.JSONLD))
register("jsonld_walk", lambda s, d: page_columns(C.enriched_log(s, d), ["crawl_seq", "schema_types"])
         .select("crawl_seq", F.explode("schema_types").alias("type")).groupBy("crawl_seq", "type").agg(F.count(F.lit(1)).alias("n")),
         Q.query("SELECT crawl_seq, type, count(*) AS n FROM ldo GROUP BY ALL", Q.CTES + Q.JSONLD))

# ---------------------------------------------------------------- site passes
_DUP = Q.CTES + Q.DUPLICATES
for _key, _label in zip(("agg_dup_title", "agg_dup_description", "agg_dup_h1", "agg_dup_canonical"), duplicates.LABELS):
    def _groups(spark, sf_dir, label=_label):
        facts = page_columns(C.enriched_log(spark, sf_dir), _SITE_COLUMNS[2:9] + ["crawl_seq"])
        groups = duplicates.duplicate_groups(duplicates.duplicate_candidates(facts))
        return groups.filter(F.col("label") == label).select("value", "n")

    register(_key, _groups, Q.query(f"SELECT value, count(*) AS n FROM dup_values WHERE label = '{_label}' GROUP BY value HAVING count(*) > 1", _DUP))


def _dup_members(spark, sf_dir):
    candidates = duplicates.duplicate_candidates(narrow(spark, sf_dir, _SITE_COLUMNS[2:9]))
    return duplicates.duplicate_members(candidates).select("crawl_seq", "label", "value", "n")


register("win_dup_count", _dup_members, Q.query("SELECT crawl_seq, label, value, n FROM dup_members", _DUP))
register("join_hreflang_recip", lambda s, d: hreflang.unreciprocated(narrow(s, d, ["url", "final_url", "hreflang"])),
         Q.query("SELECT crawl_seq, href FROM unreciprocated", Q.CTES + Q.HREFLANG))
register("win_last_wins", lambda s, d: hreflang.page_index(page_columns(C.enriched_log(s, d), ["crawl_seq", "url", "final_url"])),
         Q.query("SELECT norm, crawl_seq FROM by_url", Q.CTES + Q.HREFLANG))


def with_status(run):
    def wrapped(spark, sf_dir):
        facts = narrow(spark, sf_dir, ["canonical", "canonical_is_self", "links"])
        return run(facts, materialize(spark_link_status(facts), "status"))

    return wrapped


_ST = Q.CTES + Q.LINKS + Q.STATUS
register("join_link_status", with_status(lambda f, st: link_status.faulty_links(f, st).select("crawl_seq", "pos", "url", "status", "broken")),
         Q.query("SELECT crawl_seq, pos, url, status, broken FROM faulty", _ST))
register("join_canonical_status", with_status(lambda f, st: link_status.canonical_status(f, st)),
         Q.query("SELECT crawl_seq, url, status, redirected FROM canonical_status", _ST))


def _page_link_counts(facts, status):
    found = link_status.page_link_findings(link_status.faulty_links(facts, status))
    text = lambda c: F.array_join(F.transform(c, lambda l: F.concat(l.url, F.lit(" "), l.status)), "|")
    return found.select("crawl_seq", F.size("broken_links").alias("n_broken"), F.size("redirecting_links").alias("n_redirecting"),
                        text("broken_links").alias("broken_links"), text("redirecting_links").alias("redirecting_links"))


register("agg_page_link_counts", with_status(_page_link_counts), Q.query("SELECT * FROM page_faults", _ST))
_TARGETS = lambda s, d: link_status.distinct_targets(narrow(s, d, ["canonical", "canonical_is_self", "links"]))
register("agg_distinct_targets", _TARGETS, Q.query("SELECT url FROM targets", _ST))
register("set_targets_union", _TARGETS, Q.query("SELECT url FROM targets", _ST))


def _statuses(run):
    return lambda s, d: run(page_columns(C.enriched_log(s, d), ["status_code", "indexable"]))


_STATUS_SQL = Q.query("SELECT status_code, count(*) AS n_pages FROM facts GROUP BY status_code ORDER BY status_code", Q.CTES)
register("agg_status", _statuses(tally.status_histogram), _STATUS_SQL)
register("sort_status", _statuses(tally.status_histogram), _STATUS_SQL)
register("agg_indexable", _statuses(tally.indexable_share),
         Q.query("SELECT count_if(indexability_reason = '') AS n_indexable, count(*) AS n_pages FROM facts", Q.CTES))
_KEY = "trim(split_part(regexp_replace(message, '[0-9]+', 'N', 'g'), ':', 1))"
def _issue_rows(spark, sf_dir):
    facts = materialize(page_facts(C.enriched_log(spark, sf_dir)), "facts")
    return issue_rows(facts, materialize(spark_link_status(facts), "status"))


register("agg_issue_tally", lambda s, d: tally.tally_rows(_issue_rows(s, d)).select("issue", "n"),
         Q.query(f"SELECT {_KEY} AS issue, count(*) AS n FROM issues GROUP BY 1"))
_TOP = Q.query(f"""SELECT issue, n FROM (SELECT {_KEY} AS issue, count(*) AS n, min(crawl_seq * 1000000 + seq * 1000 + pos) AS first_seen FROM issues GROUP BY 1)
ORDER BY n DESC, first_seen LIMIT 12""")
register("topk_issues", lambda s, d: tally.top_issues(_issue_rows(s, d)), _TOP)


def _summary(spark, sf_dir):
    parts = sinks.summary(audited(spark, sf_dir))
    status = parts["statuses"].select(F.lit("status").alias("part"), F.col("status_code").cast("string").alias("value"), F.col("n_pages").alias("n"))
    share = parts["indexable"].select(F.explode(F.create_map(F.lit("indexable"), F.col("n_indexable"), F.lit("pages"), F.col("n_pages"))).alias("value", "n"))
    issues = parts["issues"].select(F.lit("issue").alias("part"), F.col("issue").alias("value"), "n")
    return status.unionByName(share.withColumn("part", F.lit("share"))).unionByName(issues)


register("sink_summary", _summary, Q.query(f"""
SELECT 'status' AS part, CAST(status_code AS VARCHAR) AS value, count(*) AS n FROM facts GROUP BY status_code
UNION ALL SELECT 'share', 'indexable', count_if(indexability_reason = '') FROM facts
UNION ALL SELECT 'share', 'pages', count(*) FROM facts
UNION ALL SELECT 'issue', issue, n FROM (
  SELECT {_KEY} AS issue, count(*) AS n, min(crawl_seq * 1000000 + seq * 1000 + pos) AS first_seen FROM issues GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 12)"""))
_ALL_ISSUES = Q.query("SELECT crawl_seq, count(*) AS n_issues, string_agg(message, ' # ' ORDER BY seq, pos, message) AS issues FROM issues GROUP BY crawl_seq")


def _site_audit(spark, sf_dir):
    by_rule = F.array_sort(F.transform("all_issues", lambda i: F.struct(i.seq, F.when(i.seq == 19, 0).otherwise(i.pos), i.message)))
    return audited(spark, sf_dir).filter(F.size("issues") > 0).select(
        "crawl_seq", F.size("issues").cast("bigint").alias("n_issues"), F.array_join(F.transform(by_rule, lambda i: i.message), " # ").alias("issues"))


register("site_audit", _site_audit, _ALL_ISSUES)
_FLAT_SQL = [c for c in sinks.FLAT_COLUMNS if c not in ("text_html_ratio",)]
_FLAT_EXPR = {
    "indexable": "indexability_reason = ''", "canonical_target_status": "coalesce(cs.status, 0)",
    "heading_order_ok": "len(order_issues) = 0", "hreflang_count": "CAST(len(langs) AS INTEGER)",
    "broken_links_count": "coalesce(n_broken, 0)", "redirecting_links_count": "coalesce(n_redirecting, 0)",
    "schema_types": "coalesce(t.t, '')", "issue_count": "CAST(coalesce(ic.n, 0) AS INTEGER)",
    **{f"h{n}_count": f"CAST(len(list_filter(levels, lambda l: l = {n})) AS INTEGER)" for n in range(1, 7)},
}
_PAGE_SQL = Q.query(
    "SELECT " + ", ".join(f"{_FLAT_EXPR.get(c, 'fl.' + c)} AS {c}" for c in _FLAT_SQL) + """ FROM fl LEFT JOIN page_faults USING (crawl_seq)
LEFT JOIN (SELECT crawl_seq, array_to_string(list_sort(list_distinct(list(type))), '|') AS t FROM ldo GROUP BY 1) t USING (crawl_seq)
LEFT JOIN (SELECT crawl_seq, count(*) AS n FROM issues GROUP BY 1) ic USING (crawl_seq)
LEFT JOIN canonical_status cs USING (crawl_seq)""")
register("page_audit", lambda s, d: sinks.flat_summary(audited(s, d)).drop("text_html_ratio"), _PAGE_SQL)

# ---------------------------------------------------------------- URL lists and seeds
def _lines(spark, sf_dir):
    return C.derived(spark, sf_dir, C.URL_LINES)


_LINE_SQL = f"WITH l AS (SELECT pos, trim(line) AS line FROM ({C.sql_select(C.URL_LINES, 'pages')})) "
register("src_url_list", lambda s, d: url_list.listed_urls(_lines(s, d)),
         _LINE_SQL + "SELECT pos, line AS url FROM l WHERE regexp_matches(line, '^https?://')")
register("src_url_list_rejected", lambda s, d: url_list.rejected_lines(_lines(s, d)),
         _LINE_SQL + "SELECT pos, line FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND NOT regexp_matches(line, '^https?://')")


def _seeds(spark, sf_dir):
    start = C.derived(spark, sf_dir, [("url", C.page_url(C.ROOT)), ("pos", "0")], distinct=True)
    listed = C.derived(spark, sf_dir, [("url", f"{C.page_url(C.CHILD_ONE)} || '/#x'"), ("pos", C.K)])
    found = C.derived(spark, sf_dir, [("url", C.page_url(C.K)), ("pos", C.K)])
    return crawl.merge_seeds(start, listed, found)


_SEED_SQL = f"""
WITH u AS (
  SELECT DISTINCT {C.page_url(C.ROOT)} AS url, 0 AS source, 0 AS pos FROM pages
  UNION ALL SELECT {C.page_url(C.CHILD_ONE)} || '/#x', 1, page_id FROM pages
  UNION ALL SELECT {C.page_url(C.K)}, 2, page_id FROM pages),
n AS (SELECT {Q.norm('url')} AS url, source, CAST(pos AS BIGINT) AS pos FROM u)
SELECT url, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, pos) AS rn FROM n) WHERE rn = 1"""
for _key in ("src_seed_merge", "set_seed_union", "win_first_occurrence"):
    register(_key, _seeds, _SEED_SQL)


def _list_only(spark, sf_dir):
    seeds = C.derived(spark, sf_dir, [("start_url", C.page_url(C.ROOT)), ("url", "url"), ("pos", C.K)])
    seeds = seeds.withColumn("start_url", F.lit("https://list.example"))
    links = spark.createDataFrame([], "url string, pos int, target string")
    return crawl.crawl_expand(seeds, links, list_only=True).select("url", "depth")


register("flt_list_only", _list_only, f"SELECT DISTINCT {Q.norm('url')} AS url, 0 AS depth FROM pages")

# ---------------------------------------------------------------- robots
_ROBOTS_SQL = f"""
WITH docs AS ({C.sql_select(C.ROBOTS, 'pages')}),
raw AS (SELECT host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM docs WHERE status = 200),
bare AS (SELECT *, trim(split_part(line, '#', 1)) AS b FROM raw),
kv AS (SELECT host, n, line, lower(trim(split_part(b, ':', 1))) AS field, replace(trim(substr(b, strpos(b, ':') + 1)), '%65', 'e') AS value, strpos(b, ':') > 0 AS has_value FROM bare),
ev AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN NOT has_value THEN NULL WHEN field = 'user-agent' THEN 'agent'
        WHEN field IN ('allow', 'disallow', 'crawl-delay') THEN 'rule' END AS kind FROM kv),
ek AS (SELECT *, lag(kind) OVER (PARTITION BY host ORDER BY n) AS prev FROM ev WHERE kind IS NOT NULL),
eg AS (SELECT *, sum(CASE WHEN kind = 'agent' AND prev IS DISTINCT FROM 'agent' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY n) AS group_id,
        max(CASE WHEN kind = 'agent' THEN n END) OVER (PARTITION BY host ORDER BY n) AS last_agent,
        coalesce(max(CASE WHEN kind = 'blank' THEN n END) OVER (PARTITION BY host ORDER BY n), -1) AS last_blank FROM ek),
el AS (SELECT * FROM eg WHERE kind <> 'blank' AND last_agent > last_blank),
kept AS (SELECT host, group_id FROM el WHERE kind = 'rule' GROUP BY ALL),
agents AS (SELECT el.host, el.group_id, value AS agent FROM el JOIN kept USING (host, group_id) WHERE kind = 'agent'),
rule_rows AS (SELECT host, group_id, n, field = 'allow' OR value = '' AS allow,
        replace(replace(replace(value, '?', '%3F'), '=', '%3D'), '&', '%26') AS path FROM el WHERE field IN ('allow', 'disallow')),
seqs AS (SELECT *, CAST(row_number() OVER (PARTITION BY host, group_id ORDER BY n) - 1 AS INTEGER) AS seq FROM rule_rows),
applies AS (SELECT host, group_id, bool_or(agent = '*') AS is_default, bool_or(contains('mozilla', lower(agent))) AS named FROM agents GROUP BY ALL),
chosen AS (SELECT host, arg_min(group_id, CASE WHEN is_default THEN 1000000 ELSE 0 END + group_id) AS group_id FROM applies WHERE is_default OR named GROUP BY host),
delay AS (SELECT host, max(CAST(value AS DOUBLE)) AS crawl_delay FROM el JOIN chosen USING (host, group_id) WHERE field = 'crawl-delay' AND regexp_matches(value, '^[0-9]+$') GROUP BY host),
cand AS ({C.sql_select(C.ROBOTS_CANDIDATES, 'pages')}),
cq AS (SELECT host, url, replace(replace(replace(replace(regexp_replace(url, '^https?://[^/]+', ''), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS q FROM cand),
decided AS (SELECT cq.host, cq.url, arg_min(allow, seq) AS allow FROM cq JOIN chosen USING (host) JOIN seqs USING (host, group_id)
  WHERE starts_with(CASE WHEN q = '' THEN '/' ELSE q END, path) GROUP BY ALL)
"""


def _robots(spark, sf_dir):
    return C.derived(spark, sf_dir, C.ROBOTS)


def _decisions(spark, sf_dir):
    candidates = C.derived(spark, sf_dir, C.ROBOTS_CANDIDATES)
    return robots.with_robots_decision(candidates, robots.agent_policy(_robots(spark, sf_dir), C.ROBOTS_AGENT))


_DECIDED = _ROBOTS_SQL + "SELECT cand.host, cand.url, coalesce(allow, true) AS allowed FROM cand LEFT JOIN decided USING (host, url)"
register("src_robots_rules", lambda s, d: robots.robots_rules(_robots(s, d)),
         _ROBOTS_SQL + "SELECT host, CAST(group_id AS BIGINT) AS group_id, agent, seq, allow, path FROM seqs JOIN agents USING (host, group_id)")
register("src_robots_crawl_delay", lambda s, d: robots.crawl_delays(_robots(s, d), C.ROBOTS_AGENT),
         _ROBOTS_SQL + "SELECT host, crawl_delay FROM delay WHERE crawl_delay > 0")
register("join_robots_prefix", _decisions, _DECIDED)
register("flt_robots_allowed", lambda s, d: _decisions(s, d).filter("allowed").select("host", "url"),
         f"SELECT host, url FROM ({_DECIDED}) WHERE allowed")
register("src_robots_sitemaps", lambda s, d: robots.robots_sitemaps(
    _robots(s, d).select("host", F.concat(F.lit("https://"), "host", F.lit("/start?x")).alias("start_url")), _robots(s, d)).select("host", "sitemap_url"),
    _ROBOTS_SQL + "SELECT host, trim(regexp_extract(line, ':(.*)$', 1)) AS sitemap_url FROM raw WHERE starts_with(lower(line), 'sitemap:') "
    "UNION ALL SELECT host, 'https://' || host || '/sitemap.xml' FROM docs WHERE host NOT IN (SELECT host FROM raw WHERE starts_with(lower(line), 'sitemap:'))")


def _eligible(spark, sf_dir):
    candidates = C.derived(spark, sf_dir, C.ROBOTS_CANDIDATES).withColumn("site", F.regexp_replace("host", "^h1", "x1"))
    policy = robots.agent_policy(_robots(spark, sf_dir), C.ROBOTS_AGENT)
    return crawl.eligible(candidates, policy, same_domain=True).select("host", "url")


register("flt_eligible", _eligible, f"SELECT host, url FROM ({_DECIDED}) WHERE allowed AND NOT starts_with(host, 'h1')")

# ---------------------------------------------------------------- sitemaps
_MAP_SQL = f"""
WITH RECURSIVE raw AS ({C.sql_select(C.SITEMAPS, 'pages')}),
docs AS (SELECT sitemap_url, body, contains(lower(body), '<sitemapindex') AS is_index FROM raw WHERE status = 200),
locs AS (SELECT sitemap_url, is_index, replace(unnest(regexp_extract_all(body, '<loc> ([^<]*)</loc>', 1)), '&amp;', '&') AS loc FROM docs),
seeds AS (SELECT DISTINCT {C.sql_select(C.SITEMAP_SEEDS, 'pages')[7:]}),
walk AS (SELECT site, sitemap_url FROM seeds UNION SELECT w.site, l.loc FROM walk w JOIN locs l ON l.sitemap_url = w.sitemap_url AND l.is_index),
found AS (SELECT DISTINCT w.site, {Q.norm('l.loc')} AS url FROM walk w JOIN locs l ON l.sitemap_url = w.sitemap_url AND NOT l.is_index
  WHERE regexp_matches(l.loc, '^https?://') AND {Q.root_host('l.loc')} = w.site)
"""


def _zip_some(batches):
    """Every third body zipped, every seventh of these in two members."""
    for batch in batches:
        bodies = []
        for i, body in enumerate(batch["body"]):
            half = len(body) // 2 if i % 7 == 0 else len(body)
            members = gzip.compress(body[:half]) + (gzip.compress(body[half:]) if half < len(body) else b"")
            bodies.append(members if i % 3 == 0 else body)
        yield batch.assign(body=bodies)


def _fetched_maps(spark, sf_dir):
    raw = C.derived(spark, sf_dir, C.SITEMAPS).withColumn("body", F.encode("body", "UTF-8"))
    return raw.mapInPandas(_zip_some, raw.schema)


def _maps(spark, sf_dir):
    return C.derived(spark, sf_dir, C.SITEMAP_SEEDS, distinct=True), _fetched_maps(spark, sf_dir)


def _walk(cap):
    def run(spark, sf_dir):
        seeds, docs = _maps(spark, sf_dir)
        return sitemaps.sitemap_walk(seeds, sitemaps.document_locations(docs), max_sitemaps=cap).select("site", "sitemap_url")

    return run


def _sitemap_pages(spark, sf_dir):
    seeds, docs = _maps(spark, sf_dir)
    return sitemaps.sitemap_expand(seeds, docs, max_sitemaps=1 << 40).select("site", "url")


def _sitemap_limit(spark, sf_dir):
    seeds, docs = _maps(spark, sf_dir)
    return sitemaps.sitemap_expand(seeds, docs, max_sitemaps=1 << 40, max_urls=4).select("site", "url")


register("src_sitemap_docs", lambda s, d: sitemaps.sitemap_docs(_fetched_maps(s, d)), f"SELECT sitemap_url, body FROM ({C.sql_select(C.SITEMAPS, 'pages')}) WHERE status = 200")
register("join_sitemap_children", _walk(1 << 40), _MAP_SQL + "SELECT site, sitemap_url FROM walk")
register("sitemap_expand", _sitemap_pages, _MAP_SQL + "SELECT site, url FROM found")
register("flt_sitemap_urls", _sitemap_pages, _MAP_SQL + "SELECT site, url FROM found")
# The walk with positions; its levels are bounded, as cycles have walks of any length.
_MAP_ORDER = _MAP_SQL.replace("locs AS (SELECT sitemap_url, is_index, replace(unnest(", """places AS (
  SELECT sitemap_url, is_index, l[i] AS loc, CAST(i - 1 AS BIGINT) AS pos FROM (
    SELECT sitemap_url, is_index, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT sitemap_url, is_index, list_transform(regexp_extract_all(body, '<loc> ([^<]*)</loc>', 1), lambda x: replace(x, '&amp;', '&')) AS l FROM docs))),
locs AS (SELECT sitemap_url, is_index, replace(unnest(""", 1).rstrip() + f""",
steps AS (
  SELECT site, sitemap_url, 0 AS level, [CAST(pos AS BIGINT)] AS path FROM seeds
  UNION ALL SELECT s.site, p.loc, s.level + 1, list_append(s.path, p.pos) FROM steps s JOIN places p ON p.sitemap_url = s.sitemap_url AND p.is_index WHERE s.level < 9),
firsts AS (SELECT site, sitemap_url, level, path FROM steps QUALIFY row_number() OVER (PARTITION BY site, sitemap_url ORDER BY level, path) = 1),
entries AS (
  SELECT f.site, {Q.norm('p.loc')} AS url, f.level, list_append(f.path, p.pos) AS path
  FROM firsts f JOIN places p ON p.sitemap_url = f.sitemap_url AND NOT p.is_index WHERE regexp_matches(p.loc, '^https?://') AND {Q.root_host('p.loc')} = f.site),
ranked AS (
  SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY level, path) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY level, path) AS pick FROM entries) WHERE pick = 1)
"""
register("limit_sitemap_urls", _sitemap_limit, _MAP_ORDER + "SELECT site, url FROM ranked WHERE rn <= 4")
register("limit_sitemaps", _walk(3), _MAP_SQL + """
SELECT site, sitemap_url FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CAST(regexp_extract(sitemap_url, '([0-9]+)[.]xml$', 1) AS BIGINT)) AS rn FROM walk) WHERE rn <= 3""")

# ---------------------------------------------------------------- crawl
_CRAWL_LINKS = f"""
hops AS (SELECT facts.url AS page_url, links.url AS target, pos FROM links JOIN facts USING (crawl_seq) WHERE is_internal AND is_web),
seeds AS (SELECT DISTINCT {C.page_url(C.ROOT)} AS url FROM pages),
"""
_SKIP = "regexp_matches(regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)[.]pdf$')"


def _crawl_sql(depth: int, select: str) -> str:
    return Q.query(select, Q.CTES + Q.LINKS + _CRAWL_LINKS + f"""
reach AS (
  SELECT {Q.root_host('url')} AS site, url, 0 AS depth FROM seeds
  UNION SELECT r.site, h.target, r.depth + 1 FROM reach r JOIN hops h ON h.page_url = r.url
  WHERE r.depth < {depth} AND NOT {_SKIP.format(u='h.target')} AND {Q.root_host('h.target')} = r.site),
found AS (SELECT site, url, min(depth) AS depth FROM reach GROUP BY ALL),""")


def _crawl(spark, sf_dir, **options):
    seeds = C.derived(spark, sf_dir, C.CRAWL_SEEDS, distinct=True)
    links = materialize(crawl.page_links(page_columns(C.enriched_log(spark, sf_dir), ["url", "links"])), "hops")
    return crawl.crawl_expand(seeds, links, **options)


register("crawl_expand", lambda s, d: _crawl(s, d, max_depth=5).select("site", "url", "depth"),
         _crawl_sql(5, "SELECT site, url, depth FROM found"))
register("limit_depth", lambda s, d: _crawl(s, d, max_depth=2).select("site", "url", "depth"), _crawl_sql(2, "SELECT site, url, depth FROM found"))
_KEPT = f"""
walks AS (
  SELECT {Q.root_host('url')} AS site, url, 0 AS depth, [0] AS path FROM seeds
  UNION ALL SELECT w.site, h.target, w.depth + 1, list_append(w.path, h.pos) FROM walks w JOIN hops h ON h.page_url = w.url
  WHERE w.depth < 3 AND NOT {_SKIP.format(u='h.target')} AND {Q.root_host('h.target')} = w.site),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, path) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY depth, path) AS pick FROM walks) WHERE pick = 1),"""
register("limit_max_pages", lambda s, d: _crawl(s, d, max_pages=7, max_depth=3).select("site", "url", "depth"),
         Q.query("SELECT site, url, depth FROM kept WHERE rn <= 7", Q.CTES + Q.LINKS + _CRAWL_LINKS + _KEPT))


_RUN_COLUMNS = ["url", "status_code", "title", "h1_count", "word_count", "images_total", "indexability_reason"]


def _audit_run(**options):
    """A run over the whole log, from the first start URL."""
    def run(spark, sf_dir):
        log = C.enriched_log(spark, sf_dir).drop("crawl_seq")
        start = C.derived(spark, sf_dir, C.CRAWL_SEEDS).agg(F.min("start_url")).first()[0]
        return audit_run(log, start_url=start, **options).select(*_RUN_COLUMNS)

    return run


_RUN_SQL = """SELECT found.url, coalesce(facts.status_code, -1) AS status_code, coalesce(facts.title, '') AS title,
  coalesce(facts.h1_count, 0) AS h1_count, coalesce(facts.word_count, 0) AS word_count, coalesce(facts.images_total, 0) AS images_total,
  CASE WHEN facts.url IS NULL THEN 'request failed: not collected' ELSE facts.indexability_reason END AS indexability_reason
FROM found LEFT JOIN facts ON facts.url = found.url WHERE found.site = (SELECT min(site) FROM reach WHERE url = (SELECT min(url) FROM seeds))"""
register("audit_run", _audit_run(), _crawl_sql(1000, _RUN_SQL))


def _hops(spark, sf_dir):
    return crawl.page_links(page_columns(C.enriched_log(spark, sf_dir), ["url", "links"]))


_HOP = Q.CTES + Q.LINKS + _CRAWL_LINKS


def _frontier_pages(spark, sf_dir):
    frontier = C.derived(spark, sf_dir, C.CRAWL_SEEDS, distinct=True).select("url")
    return store_edges(_hops(spark, sf_dir), "url", "links").follow(frontier).select("url", "target").distinct()


register("join_frontier_pages", _frontier_pages,
         Q.query("SELECT DISTINCT page_url AS url, target FROM hops JOIN seeds ON seeds.url = page_url", _HOP))


def _unvisited(spark, sf_dir):
    one_crawl = lambda df: df.withColumns({"site": F.lit("s"), "host": F.lit("h")})
    visited = C.derived(spark, sf_dir, [("url", C.page_url(C.K))])
    candidates = _hops(spark, sf_dir).select(F.col("target").alias("url")).distinct()
    return crawl.unvisited(one_crawl(candidates), one_crawl(visited)).select(F.col("url").alias("target"))


for _key in ("join_visited_anti", "set_frontier_minus_visited"):
    register(_key, _unvisited, Q.query(f"SELECT DISTINCT target FROM hops WHERE target NOT IN (SELECT {C.page_url(C.K)} FROM pages)", _HOP))

# ---------------------------------------------------------------- fetch log
_EV = f"WITH ev AS ({C.sql_select(C.EVENT_LOG, 'events')}) "
register("win_retry_rollup", lambda s, d: fetch_log.retry_rollup(C.event_log(s, d)),
         _EV + "SELECT url, arg_max(status_code, CAST(epoch_us(fetched_at) AS HUGEINT) * 10000000 + attempt) AS status_code, count(*) AS n_attempts, "
         "count_if(status_code IN (429, 500, 502, 503, 504)) AS n_retryable FROM ev GROUP BY url")
register("final_attempts", lambda s, d: fetch_log.final_attempts(C.event_log(s, d)),
         _EV + "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, attempt DESC) AS rn FROM ev) WHERE rn = 1")


def _link_status_log(spark, sf_dir):
    log = C.event_log(spark, sf_dir).selectExpr(
        "url || '/#f' AS url", "fetched_at", "attempt", "status_code",
        "CASE WHEN event_id % 7 = 3 THEN 'reset' END AS error",
        "CASE WHEN event_id % 3 = 1 THEN array(301) ELSE CAST(array() AS array<int>) END AS redirect_chain")
    return fetch_log.link_status_from_log(log)


register("src_link_status", _link_status_log, _EV +
         "SELECT url, CASE WHEN event_id % 7 = 3 THEN -1 ELSE status_code END AS status, event_id % 7 <> 3 AND event_id % 3 = 1 AS redirected "
         "FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, attempt DESC) AS rn FROM ev) WHERE rn = 1")


def _pacing(spark, sf_dir):
    log = C.event_log(spark, sf_dir).select("event_id", "host", "fetched_at")
    delays = log.select("host").distinct().filter("host <> 'h1.example'").select("host", (F.length("host") * 30.0).alias("crawl_delay"))
    return fetch_log.pacing_audit(log, delays, delay=60.0, tie="event_id").select(
        "event_id", "host", F.round(F.col("gap_seconds") * 1000000).cast("bigint").alias("gap_us"), "min_gap_seconds", "too_soon")


register("win_pacing_audit", _pacing, _EV + """, g AS (
  SELECT event_id, host, date_diff('microsecond', lag(fetched_at) OVER (PARTITION BY host ORDER BY fetched_at, event_id), fetched_at) AS gap_us,
    greatest(CAST(60 AS DOUBLE), CASE WHEN host = 'h1.example' THEN CAST(0 AS DOUBLE) ELSE length(host) * CAST(30 AS DOUBLE) END) AS min_gap_seconds FROM ev)
SELECT event_id, host, gap_us, min_gap_seconds, coalesce(gap_us / CAST(1000000 AS DOUBLE) < min_gap_seconds * CAST(0.85 AS DOUBLE), false) AS too_soon FROM g""")

# ---------------------------------------------------------------- whole reports: every declared field
_REPORT_FLAT = {
    **_FLAT, "redirect_chain": _FLAT["redirect_codes"], "issues": lambda: F.array_join(F.array_sort("issues"), " # "),
    **{c: lambda c=c: F.array_join(F.transform(c, lambda l: F.concat(l.url, F.lit(" "), l.status)), "|") for c in ("broken_links", "redirecting_links")},
}
_REPORT_EXPR = {
    **_FLAT_EXPR, "redirect_chain": "redirect_codes", "text_html_ratio": _ORACLE_COLUMN["text_html_ratio"],
    "broken_links": "coalesce(broken_links, '')", "redirecting_links": "coalesce(redirecting_links, '')", "issues": "coalesce(ic.m, '')",
}
_REPORT_FROM = """ FROM fl LEFT JOIN page_faults USING (crawl_seq)
LEFT JOIN (SELECT crawl_seq, array_to_string(list_sort(list_distinct(list(type))), '|') AS t FROM ldo GROUP BY 1) t USING (crawl_seq)
LEFT JOIN (SELECT crawl_seq, string_agg(message, ' # ' ORDER BY message) AS m FROM issues GROUP BY 1) ic USING (crawl_seq)
LEFT JOIN canonical_status cs USING (crawl_seq)"""
_REPORT_SELECT = ", ".join(f"{_REPORT_EXPR.get(c, 'fl.' + c)} AS {c}" for c in REPORT_TYPES) + _REPORT_FROM


def _flat_report(report: DataFrame, *more: str) -> DataFrame:
    return report.select(*more, *[(_REPORT_FLAT[c]() if c in _REPORT_FLAT else F.col(c)).alias(c) for c in REPORT_TYPES])


def _full_run(spark, sf_dir):
    """A run from a start URL, a URL list and a sitemap, under robots.txt, with links checked against the log."""
    log = C.enriched_log(spark, sf_dir).withColumns({"fetched_at": F.timestamp_seconds(F.col("crawl_seq")), "attempt": F.lit(1)}).drop("crawl_seq")
    start, sitemap = C.derived(spark, sf_dir, [("url", C.page_url(C.ROOT)), ("map", C.sitemap_url(C.ROOT))]).agg(F.min(F.struct("url", "map"))).first()[0]
    lines = C.derived(spark, sf_dir, [("pos", C.K), ("line", C.page_url(C.K))]).filter("pos % 41 = 7")
    rules = spark.createDataFrame([(start.split("/")[2], 200, "User-agent: *\nDisallow: /p/1\nDisallow: /q")], "host string, status int, text string")
    run = audit_run(log, start_url=start, url_lines=lines, from_sitemap=sitemap, sitemap_docs=_fetched_maps(spark, sf_dir), robots_txt=rules,
                    link_status="log", max_depth=2)
    return _flat_report(run, "crawl_seq")


_SITE = f"(SELECT {Q.root_host('min(url)')} FROM seeds)"
_ALLOWED = (f"NOT {_SKIP} AND NOT regexp_matches(regexp_extract({{u}}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/(p/1|q)') AND {{root}} = {_SITE}")
_allowed = lambda u: _ALLOWED.format(u=u, root=Q.root_host(u))
_SOURCES = f"""
all_src AS (SELECT * FROM src),
sources AS (
  SELECT min(url) AS url, 0 AS source, 0 AS place FROM seeds
  UNION ALL SELECT {C.page_url(C.K)}, 1, page_id FROM pages WHERE page_id % 41 = 7
  UNION ALL SELECT url, 2, rn FROM ranked WHERE site = {_SITE}),
first_sources AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY url ORDER BY source, place) = 1),
run_walks AS (
  SELECT url, 0 AS depth, [row_number() OVER (ORDER BY source, place)] AS path FROM first_sources WHERE {_allowed('url')}
  UNION ALL SELECT h.target, w.depth + 1, list_append(w.path, h.pos) FROM run_walks w JOIN hops h ON h.page_url = w.url
  WHERE w.depth < 2 AND {_allowed('h.target')}),
reached AS (
  SELECT url, row_number() OVER (ORDER BY depth, path) - 1 AS seq
  FROM (SELECT * FROM run_walks QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, path) = 1))"""
_VISITED = f"""
src AS (
  SELECT * REPLACE (seq AS crawl_seq) FROM (SELECT s.*, r.seq FROM all_src s JOIN reached r ON r.url = s.url)
  UNION ALL BY NAME SELECT seq AS crawl_seq, url, seq, 'not collected' AS error, '' AS html, '' AS final_url FROM reached WHERE url NOT IN (SELECT url FROM all_src)),
"""
_LOG_STATUS = f"""link_status AS (
  SELECT {Q.norm('url')} AS url, CASE WHEN error IS NOT NULL THEN -1 ELSE status_code END AS status, error IS NULL AND redirect_codes <> '' AS redirected FROM all_src),
faulty AS ("""


def _after(text: str, mark: str) -> str:
    return text[text.index(mark) + len(mark):]


_RUN_CTES = (_VISITED + _after(Q.ALL, "FROM pages),\n")).replace(
    Q.ALL[Q.ALL.index("link_status AS ("):Q.ALL.index("faulty AS (") + len("faulty AS (")], _LOG_STATUS)
_MAP_CTES = _after(_MAP_ORDER, "WITH RECURSIVE ").replace("raw AS", "map_raw AS").replace("FROM raw", "FROM map_raw").replace("seeds", "map_seeds").replace(
    "found AS", "map_found AS").replace("links", "map_links")
register("audit_run_full", _full_run,
         Q.query(f"SELECT * FROM (WITH {_RUN_CTES.strip().rstrip(',')} SELECT fl.crawl_seq, {_REPORT_SELECT})", Q.CTES + Q.LINKS + _CRAWL_LINKS + _MAP_CTES.rstrip() + "," + _SOURCES))


# ---------------------------------------------------------------- sinks: write, then read back
def _sink_json(spark, sf_dir):
    path = new_path(spark, "sink")
    sinks.write_json(audited(spark, sf_dir), path)
    return _flat_report(spark.read.schema(", ".join(f"{n} {t}" for n, t in REPORT_TYPES.items())).json(path))


def _sink_csv(spark, sf_dir):
    path, report = new_path(spark, "sink"), audited(spark, sf_dir)
    sinks.write_csv(report, path)
    schema = sinks.flat_summary(report).schema
    back = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    texts = [c for c, kind in back.dtypes if kind == "string"]  # an empty text comes back as null
    return back.fillna("", texts).drop("text_html_ratio")


register("sink_json", _sink_json, Q.query(f"SELECT {_REPORT_SELECT}"))
register("sink_csv", _sink_csv, _PAGE_SQL)

# ---------------------------------------------------------------- streams
def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run an available-now query into Parquet and read the result."""
    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream_input(spark, sf_dir):
    """The enriched log with a fetch time, written as files and read back as a stream."""
    log = C.enriched_log(spark, sf_dir).selectExpr(
        "crawl_seq", "url", "final_url", "status_code", "redirect_chain", "response_time_ms", "headers", "html", "error",
        "timestamp_seconds(1704067200 + crawl_seq * 60) AS fetched_at", "1 AS attempt", "'' AS user_agent")
    path = new_path(spark, "stream-input")
    log.write.parquet(path)
    return streaming.read_fetch_stream(spark, path)


register("stream_page_audit", lambda s, d: _drained(
    streaming.stream_page_audit(_stream_input(s, d)).select("url", "title", "h1_count", "word_count", F.size("issues").alias("n_issues"))),
    Q.query("SELECT fl.url, title, h1_count, word_count, CAST(coalesce(n, 0) AS INTEGER) AS n_issues FROM fl LEFT JOIN "
            "(SELECT crawl_seq, count(*) AS n FROM page_issues GROUP BY 1) USING (crawl_seq)", Q.CTES + Q.LINKS + Q.JSONLD + Q.PAGE_ISSUES))
register("stream_dedup", lambda s, d: _drained(
    streaming.stream_dedup(_stream_input(s, d).withColumn("url", F.concat(F.regexp_replace("url", r"\d$", ""), F.lit("/#a"))), "3650 days").select("norm")),
    f"SELECT DISTINCT rtrim(regexp_replace({C.page_url(C.K)}, '[0-9]$', ''), '/') AS norm FROM pages")


def _stream_tally(spark, sf_dir):
    out, state = new_path(spark, "tally"), new_path(spark, "tally-state")
    tallied = streaming.tally_to(streaming.stream_issue_tally(_stream_input(spark, sf_dir)), out, state)
    tallied.awaitTermination()
    tallied = spark.read.parquet(out)
    return tallied.select(F.unix_seconds("window_start").alias("window_start"), "issue", "n")


_TALLY_SQL = Q.query(f"""
SELECT window_start, issue, n FROM (
  SELECT CAST(floor((1704067200 + crawl_seq * 60) / 3600) * 3600 AS BIGINT) AS window_start, {_KEY} AS issue, count(*) AS n
  FROM page_issues GROUP BY ALL)""",
    Q.CTES + Q.LINKS + Q.JSONLD + Q.PAGE_ISSUES)
register("stream_issue_tally", _stream_tally, _TALLY_SQL)


def _live_tally(spark, sf_dir):
    """Increments until nothing is pending; the input ends while all windows of its last hour are open."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, out, state = spark.conf.get(provider), new_path(spark, "live"), new_path(spark, "live-state")
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        told = streaming.stream_live_tally(_stream_input(spark, sf_dir), wait_ms=500)
        query = (told.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
                 .trigger(processingTime="1 second").start())
        while query.isActive:  # until a batch finds no input and leaves nothing pending
            done = query.lastProgress
            if done and not done["numInputRows"] and not any(o["numRowsTotal"] for o in done["stateOperators"]):
                break
            query.awaitTermination(1)
        query.stop()
    finally:
        spark.conf.set(provider, before)
    told = spark.read.schema(told.schema).parquet(out)
    return told.groupBy("window_start", "issue").agg(F.sum("n").alias("n")).select(F.unix_seconds("window_start").alias("window_start"), "issue", "n")


register("stream_live_tally", _live_tally, _TALLY_SQL)
