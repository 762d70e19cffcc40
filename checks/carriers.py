"""Inputs of the registered queries, derived from the given tables.

The given pages lack most of what an audit looks for, so the queries run on
pages whose HTML is enriched by expressions of ``page_id``.  The expressions are
plain SQL that Spark and DuckDB read alike: both sides see the same documents
and analyse them independently.
"""

from __future__ import annotations



def _cases(*pairs: tuple[str, str], default: str = "''") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def _cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def text(n: str) -> str:
    return f"CAST({n} AS STRING)"


def page_url(k: str) -> str:
    """URL of the enriched page ``k``; five sites, some pages on http or without www."""
    return _cat(
        f"CASE WHEN {k} % 11 = 3 THEN 'http' ELSE 'https' END",
        "'://'",
        f"CASE WHEN {k} % 13 = 4 THEN '' ELSE 'www.' END",
        "'site'",
        text(f"({k} % 5)"),
        "'.example/p/'",
        text(k),
    )


K = "page_id"
# The pages of a site form a binary tree: number t on its site leads to 2t+1 and 2t+2.
NODE = f"CAST(floor({K} / 5) AS BIGINT)"
CHILD_ONE = f"(5 * (2 * {NODE} + 1) + {K} % 5)"
CHILD_TWO = f"(5 * (2 * {NODE} + 2) + {K} % 5)"
ROOT = f"({K} % 5)"
PARTNER = f"({K} + 1 - 2 * ({K} % 2))"


def _attr(url: str) -> str:
    return _cat("'\"'", url, "'\"'")


# Some pages end at another page of their site, and name it as canonical.
MERGED, MERGED_INTO = f"{K} % 60 = 42", f"({K} - 30)"

_HEAD = _cat(
    _cases(
        (f"{K} % 4 = 0", _cat("'<meta name=\"description\" content=\"Short description of page '", text(K), "'\">'")),
        (f"{K} % 4 = 2", _cat("'<meta name=\"description\" content=\" '", f"repeat('Long description words ', 6 + {K} % 7)", "'\">'")),
        (f"{K} % 4 = 3", "'<meta name=\"description\" content=\"Common &amp; shared description\">'"),
    ),
    _cases(
        (f"{K} % 17 = 3", "'<meta name=\"ROBOTS\" content=\"noindex, follow\">'"),
        (f"{K} % 17 = 5", "'<meta name=\"robots\" content=\"all\">'"),
    ),
    _cases(
        (MERGED, _cat("'<link rel=\"canonical\" href='", _attr(page_url(MERGED_INTO)), "'>'")),
        (f"{K} % 6 = 0", _cat("'<link rel=\"canonical\" href='", _attr(page_url(K)), "'>'")),
        (f"{K} % 6 = 2", _cat("'<link rel=\"canonical\" href='", _attr(_cat(page_url(K), "'/'")), "'>'")),
        (f"{K} % 6 = 3", _cat("'<link rel=\"canonical\" href=\"/p/'", text(K), "'\">'")),
        (f"{K} % 6 = 4", _cat("'<link rel=\"canonical\" href='", _attr(page_url(ROOT)), "'>'")),
        (
            f"{K} % 6 = 5",
            _cat("'<link rel=\"canonical\" href='", _attr(page_url(K)), "'><link rel=\"canonical\" href='", _attr(page_url(CHILD_ONE)), "'>'"),
        ),
    ),
    _cases(
        (f"{K} % 3 = 0", "'<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">'"),
        (f"{K} % 9 = 2", "'<meta name=\"viewport\" content=\"width=device-width, user-scalable=no\">'"),
        (f"{K} % 9 = 5", "'<meta name=\"viewport\" content=\"maximum-scale=1.0\">'"),
    ),
    _cases(
        (f"{K} % 5 = 0", "'<base href=\"https://cdn.example/\"><link rel=\"shortcut icon\" href=\"/favicon.ico\">'"),
        (f"{K} % 5 = 3", "'<link rel=\"apple-touch-icon\" href=\"http://cdn.example/i.png\">'"),
    ),
    _cases(
        (
            f"{K} % 7 = 2",
            _cat("'<link rel=\"next\" href=\"/p/'", text(f"({K} + 5)"), "'?page=2\"><link rel=\"prev\" href=\"/p/'", text(f"({K} - 2)"), "'\">'"),
        ),
    ),
    _cases(
        (
            f"{K} % 2 = 0",
            _cat(
                "'<link rel=\"alternate\" hreflang=\"en\" href='", _attr(page_url(K)),
                "'><link rel=\"alternate\" hreflang=\"de\" href='", _attr(page_url(PARTNER)),
                "'><link rel=\"alternate\" hreflang=\"X-Default\" href='", _attr(page_url(ROOT)), "'>'",
            ),
        ),
        (
            f"{K} % 8 = 1",
            _cat("'<link rel=\"alternate\" hreflang=\"en\" href='", _attr(page_url(PARTNER)), "'>'"),
        ),
        (
            f"{K} % 8 = 5",
            "'<link rel=\"alternate\" hreflang=\"en_US\" href=\"https://other.example/a\"><link rel=\"alternate\" hreflang=\"english\" href=\"/a\">"
            "<link rel=\"alternate\" hreflang=\"zh-Hant-TW\" href=\"/b\"><link rel=\"alternate\" hreflang=\"EN\" href=\"/c\">'",
        ),
    ),
    _cases(
        (
            f"{K} % 10 = 1",
            _cat("'<meta property=\"og:title\" content=\"first\"><meta property=\"og:title\" content=\"Page '", text(K), "'\"><meta property=\"og:type\" content=\"\">'"),
        ),
        (
            f"{K} % 10 = 4",
            "'<meta property=\"og:title\" content=\"t\"><meta property=\"og:image\" content=\"i\"><meta property=\"og:url\" content=\"u\">"
            "<meta property=\"og:type\" content=\"article\"><meta name=\"twitter:card\" content=\"summary\">'",
        ),
        (f"{K} % 10 = 7", "'<meta name=\"twitter:site\" content=\"@a\"><meta name=\"twitter:title\" content=\"x &quot;y&quot;\">'"),
    ),
    _cases(
        (
            f"{K} % 8 = 0",
            _cat("'<script type=\"application/ld+json\">{\"@type\": \"Article\", \"headline\": \"Page '", text(K), "'\"}</script>'"),
        ),
        (
            f"{K} % 8 = 2",
            "'<script type=\"application/ld+json\">{\"@graph\": [{\"@type\": \"Product\", \"name\": \"\", \"image\": \"i\"}, "
            "{\"@type\": \"Event\", \"name\": \"n\", \"startDate\": \"d\", \"location\": {\"@type\": \"LocalBusiness\", \"name\": \"x\", \"address\": []}}]}</script>'",
        ),
        (
            f"{K} % 8 = 4",
            "'<script type=\"application/ld+json\">{broken</script><script type=\"application/ld+json\">[{\"@type\": \"Organization\", \"name\": \"o\"}, "
            "{\"@type\": \"Recipe\"}, {\"@type\": \"Recipe\"}, {\"@type\": \"Thing\"}]</script>'",
        ),
        (f"{K} % 8 = 6", "'<script type=\"application/ld+json\"></script><script type=\"text/javascript\">var a = \"<a href=x>\";</script>'"),
    ),
)

_BODY = _cat(
    _cases(
        (f"{K} % 5 = 1", "'<h2>Part</h2><h4>Detail &amp; more</h4>'"),
        (f"{K} % 5 = 2", "'<h1>Second <em>main</em> heading</h1>'"),
        (f"{K} % 5 = 4", "'<h2>Part</h2><h3>Sub</h3><h6>Deep</h6>'"),
    ),
    _cases(
        (
            f"{K} % 4 = 1",
            "'<img src=\"/a.png\" alt=\"A\" width=\"10\" height=\"10\"><img src=\"http://cdn.example/b.png\" alt=\"\" loading=\"lazy\"><img src=\"c.png\" width=\"5\" height=\"\">'",
        ),
        (f"{K} % 4 = 3", "'<noscript><img src=\"http://cdn.example/n.png\"><h2>Hidden part</h2><a href=\"/hidden\">hidden link</a></noscript>'"),
        (f"{K} % 4 = 2", "'<iframe src=\"http://video.example/v\"></iframe><video src=\"https://video.example/v\"></video>'"),
    ),
    _cases(
        (f"{K} % 6 = 1", "'<div itemscope itemtype=\"https://schema.org/Product/ https://schema.org/Offer\"><span itemtype=\"http://schema.org/Product\">i</span></div>'"),
        (f"{K} % 6 = 5", "'<div vocab=\"https://schema.org/\" typeof=\"Person\">p</div>'"),
    ),
    _cat("'<a href='", _attr(page_url(CHILD_ONE)), "'>Child one</a> '"),
    _cat("'<a href=\"/p/'", text(CHILD_TWO), "'\">Child two</a> '"),
    _cat("'<a rel=\"NoFollow\" href='", _attr(_cat(page_url(ROOT), "'/'")), "'>Home &amp; start</a> '"),
    _cat("'<a href=\"https://other.example/x/'", text(f"({K} % 50)"), "'\" rel=\"sponsored nofollow\">Click here</a> '"),
    _cases(
        (f"{K} % 3 = 1", "'<a href=\"mailto:a@b.example\">mail</a><a href=\"#sec\">sec</a><a href=\"\" rel=\"ugc\"> </a>'"),
        (
            f"{K} % 3 = 2",
            _cat("'<a href=\" ../p/'", text(K), "'?a=1&amp;b=2#f\"><img src=\"/i.png\" alt=\"i\" width=\"1\" height=\"1\"></a><a href=\"/files/r.pdf\">here</a><a href=\"ftp://f.example/x\">ftp</a>'"),
        ),
    ),
)

# (name, SQL expression over pages): the fetch log with everything an audit reads.
ENRICHED = [
    ("crawl_seq", K),
    ("url", page_url(K)),
    ("final_url", _cases((MERGED, page_url(MERGED_INTO)), default=_cat(page_url(K), _cases((f"{K} % 29 = 7", "'-final'"))))),
    ("status_code", f"CASE WHEN {K} % 41 = 9 THEN 404 WHEN {K} % 43 = 9 THEN 503 ELSE 200 END"),
    ("redirect_codes", _cases((f"{K} % 29 = 7", "'301, 302'"), (f"{K} % 29 = 8", "'308'"))),
    ("response_time_ms", f"CAST({K} % 900 AS INT)"),
    ("content_type", _cases((f"{K} % 47 = 9", "'application/pdf'"), (f"{K} % 5 = 1", "'Text/HTML; charset=utf-8'"), default="'text/html'")),
    ("content_encoding", _cases((f"{K} % 59 = 9", "'BR'"), (f"{K} % 2 = 1", "'gzip'"))),
    ("cache_control", _cases((f"{K} % 3 = 0", "'max-age=60'"))),
    ("x_robots_tag", _cases((f"{K} % 31 = 4", "'NoIndex'"))),
    (
        "link_header",
        _cases(
            (f"{K} % 9 = 2", _cat("'<'", page_url(K), "'>; rel=\"canonical\"'")),
            (f"{K} % 9 = 5", "'</h>; rel=next, <https://other.example/h>; rel=canonical'"),
        ),
    ),
    ("hsts", f"({K} % 4 = 0)"),
    ("length_header", _cases((f"{K} % 3 = 1", text(f"({K} * 7)")), (f"{K} % 3 = 2", "'chunked'"))),
    ("error", f"CASE WHEN {K} % 53 = 9 THEN 'read timed out' END"),
    (
        "html",
        _cases(
            (f"{K} % 59 = 9", _cat("'garbage '", text(K))),
            (f"{K} % 61 = 9", "'<div id=\"app\"></div><script>boot()</script>'"),
            (f"{K} % 37 = 5", "replace(html, '<html lang=', '<html data-lang=')"),
            default=f"replace(replace(html, '</head>', {_cat(_HEAD, chr(39) + '</head>' + chr(39))}), '</article>', {_cat(_BODY, chr(39) + '</article>' + chr(39))})",
        ),
    ),
]

# Status of a link target as a function of its text.
LINK_STATUS = "CASE WHEN length(url) % 7 = 3 THEN 404 WHEN length(url) % 11 = 5 THEN -1 ELSE 200 END"
LINK_REDIRECTED = "(length(url) % 3 = 1)"

# Fetch attempts out of the events table: one row per event.
EVENT_LOG = [
    ("event_id", "event_id"),
    ("host", _cases(("user_id % 3 = 0", "'hot.example'"), default=_cat("'h'", text("user_id"), "'.example'"))),
    ("url", _cat("'https://h'", text("user_id"), "'.example/'", "event_type")),
    ("fetched_at", "ts"),
    ("attempt", "event_id"),
    (
        "status_code",
        "CASE WHEN event_type = 'error' THEN 500 + CAST(event_id % 5 AS INT) WHEN event_type = 'click' THEN 429 ELSE 200 END",
    ),
]

ROBOTS_AGENT = "Mozilla/5.0 (compatible; auditbot/1.0)"


def spread(scan):
    """Use all cores on a test table of few partitions (a Parquet row group is not split further)."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spark_pages(spark, sf_dir: str):
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def enriched_log(spark, sf_dir: str):
    """The enriched pages in the shape of a fetch log."""
    df = spark_pages(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in ENRICHED])
    headers = """map_filter(map(
        'content-type', content_type, 'content-encoding', content_encoding, 'cache-control', cache_control,
        'x-robots-tag', x_robots_tag, 'link', link_header, 'content-length', length_header,
        'strict-transport-security', CASE WHEN hsts THEN 'max-age=1' ELSE '' END), (k, v) -> v <> '')"""
    return df.selectExpr(
        "crawl_seq", "url", "final_url", "status_code",
        "CASE WHEN redirect_codes = '' THEN CAST(array() AS array<int>) ELSE CAST(split(redirect_codes, ', ') AS array<int>) END AS redirect_chain",
        "response_time_ms", f"{headers} AS headers", "html", "error",
    )


def event_log(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {n}" for n, e in EVENT_LOG])


def sql_select(columns: list[tuple[str, str]], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns) + f" FROM {table}"

_NL = "chr(10)"


def _lines(*parts: str) -> str:
    return _cat(*[p for i, part in enumerate(parts) for p in ([_NL, part] if i else [part])])


# One robots.txt per page id: groups, precedence, blank lines, delays, missing files.
ROBOTS = [
    ("host", _cat("'h'", text(K), "'.example'")),
    ("status", f"CASE WHEN {K} % 7 = 5 THEN 404 ELSE 200 END"),
    (
        "text",
        _cases(
            (f"{K} % 7 = 0", _lines("'User-agent: *'", "'Disallow: /en/ # english'", "'Allow: /en/1'", "'Crawl-delay: 4'")),
            (
                f"{K} % 7 = 1",
                _lines("'User-agent: *'", "'Disallow: /'", "''", "'User-Agent: Mozilla'", "'user-agent: other'", "'Allow: /en/1'", "'Disallow: /en/'", "'Disallow:'"),
            ),
            (f"{K} % 7 = 2", _lines("'SITEMAP: https://s.example/a.xml'", "'Disallow: /'", "'User-agent: googlebot'", "'Disallow: /'", "'sitemap:  https://s.example/b.xml '")),
            (f"{K} % 7 = 3", _lines("'User-agent: *'", "''", "'Disallow: /'", "'User-agent: zilla'", "'Disallow: /%65n'", "'Crawl-delay: 0'")),
            (f"{K} % 7 = 4", _lines("'User-agent: *'", "'User-agent: zill'", "'Allow: /'", "''", "'User-agent: *'", "'Disallow: /'", "'Crawl-delay: x'")),
            default=_lines("'User-agent: *'", "'Disallow: /fr/8?page'", "'Disallow: /es'", "'Crawl-delay: 2'"),
        ),
    ),
]
# A URL to decide on for each of these hosts: path and query of the page's own URL.
ROBOTS_CANDIDATES = [
    ("host", _cat("'h'", text(K), "'.example'")),
    ("url", _cat("'https://h'", text(K), "'.example'", "regexp_replace(url, '^https?://[^/]+', '')")),
]


def sitemap_url(k: str) -> str:
    return _cat("'https://www.site'", text(f"({k} % 5)"), "'.example/sitemap-'", text(k), "'.xml'")


def _loc(x: str) -> str:
    return _cat("'<url><loc> '", x, "'</loc></url>'")


# Sitemap documents: even nodes are indexes of the tree below them (and of themselves).
SITEMAPS = [
    ("sitemap_url", sitemap_url(K)),
    ("status", f"CASE WHEN {K} % 31 = 30 THEN 500 ELSE 200 END"),
    (
        "body",
        _cases(
            (
                f"{NODE} % 2 = 0",
                _cat("'<SitemapIndex>'", _loc(sitemap_url(CHILD_ONE)), _loc(sitemap_url(K)), _loc(sitemap_url(CHILD_TWO)), "'</SitemapIndex>'"),
            ),
            default=_cat(
                "'<urlset>'", _loc(page_url(K)), _loc(_cat(page_url(CHILD_ONE), "'/'")),
                _loc(_cat("'https://site'", text(ROOT), "'.example/q?a=1&amp;b='", text(f"({K} % 9)"))),
                _loc("'https://other.example/x'"), _loc("'/relative'"), _loc(_cat(page_url(K), "'#again'")), "'</urlset>'",
            ),
        ),
    ),
]
SITEMAP_SEEDS = [("site", _cat("'site'", text(ROOT), "'.example'")), ("sitemap_url", sitemap_url(ROOT)), ("pos", "0")]
CRAWL_SEEDS = [("start_url", page_url(ROOT)), ("url", page_url(ROOT)), ("pos", "0")]

# One line of a URL list per page.
URL_LINES = [
    ("pos", K),
    (
        "line",
        _cases(
            (f"{K} % 6 = 0", "'   '"),
            (f"{K} % 6 = 1", "'# a comment'"),
            (f"{K} % 6 = 2", "regexp_replace(url, '^https?://', '')"),
            default=_cat("'  '", "url", "' '"),
        ),
    ),
]


def derived(spark, sf_dir: str, columns: list[tuple[str, str]], distinct: bool = False):
    df = spark_pages(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in columns])
    return df.distinct() if distinct else df
