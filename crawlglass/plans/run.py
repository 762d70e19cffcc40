"""A complete audit run: seeds, crawl over collected pages, site audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlglass.functions import urls
from crawlglass.operators.skew import with_position
from crawlglass.plans.crawl import crawl_expand, merge_seeds, page_links
from crawlglass.plans.page_audit import as_report, page_facts
from crawlglass.plans.site_audit import apply_findings, site_findings
from crawlglass.schema import FETCH_LOG_SCHEMA
from crawlglass.sources.fetch_log import final_fetches, link_status_from_log
from crawlglass.sources.robots import agent_policy, robots_sitemaps
from crawlglass.sources.sitemaps import sitemap_expand
from crawlglass.sources.url_list import listed_urls
from crawlglass.storage import materialize

DEFAULT_AGENT = "Mozilla/5.0"


def _host(url: str) -> str:
    return url.split("://", 1)[1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]


def _root(url: str) -> str:
    host = _host(url)
    return host[4:] if host.lower().startswith("www.") else host


def _one_row(log: DataFrame, **values: str) -> DataFrame:
    return log.sparkSession.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()], F.lit(0).alias("pos"))


def _start(start_url: str | None, listed: DataFrame | None, from_sitemap: str | None) -> str:
    """The URL that fixes the site; checks that the run has a source and a scheme."""
    if not start_url and listed is None and not from_sitemap:
        raise ValueError("provide a start URL, a URL list, or a sitemap")
    if not start_url and listed is not None:
        first = listed.orderBy("pos").select("url").first()
        start_url = first.url if first else None
    if not start_url and from_sitemap and from_sitemap != "auto":
        start_url = from_sitemap
    if not start_url:
        raise ValueError("could not determine a start URL")
    if not start_url.startswith(("http://", "https://")):
        raise ValueError("the start URL must start with http:// or https://")
    return start_url


def _sitemap_seeds(
    log: DataFrame, start: str, from_sitemap: str, robots_txt: DataFrame | None, docs: DataFrame,
    max_urls: int | None, max_sitemaps: int | None, same_domain: bool,
) -> DataFrame:
    """Page URLs of the named sitemap, or of those robots.txt declares, as ``(url, pos)``."""
    site = _root(start)
    if from_sitemap == "auto":
        hosts = _one_row(log, host=_host(start), start_url=start).drop("pos")
        none = log.sparkSession.createDataFrame([], "host string, status int, text string")
        seeds = robots_sitemaps(hosts, none if robots_txt is None else robots_txt)
    else:
        seeds = _one_row(log, sitemap_url=from_sitemap)
    seeds = seeds.select(F.lit(site).alias("site"), "sitemap_url", "pos")
    pages = sitemap_expand(seeds, docs, max_sitemaps, max_urls or None, same_domain)
    return with_position(pages.select("url", "level", "path"), ["level", "path"], "pos", "sitemap-seeds")


def _facts(log: DataFrame, site: str) -> DataFrame:
    return page_facts(log.withColumn("crawl_seq", F.lit(None).cast("bigint")).withColumn("site", F.lit(site)))


def _not_collected(pages: DataFrame) -> DataFrame:
    """Fetch-log rows of URLs that were never fetched."""
    known = {"url": F.col("url"), "error": F.lit("not collected")}
    columns = [part.strip().split(" ", 1) for part in FETCH_LOG_SCHEMA.replace("map<string,string>", "map<string;string>").split(",")]
    return pages.select(*(
        known.get(name, F.lit(None)).cast(kind.replace(";", ",")).alias(name) for name, kind in columns
    ))


def audit_run(
    log: DataFrame,
    start_url: str | None = None,
    url_lines: DataFrame | None = None,
    from_sitemap: str | None = None,
    sitemap_docs: DataFrame | None = None,
    robots_txt: DataFrame | None = None,
    link_status: DataFrame | str | None = None,
    agent: str = DEFAULT_AGENT,
    respect_robots: bool = True,
    same_domain: bool = True,
    list_only: bool = False,
    max_pages: int | None = None,
    max_depth: int | None = None,
    max_sitemap_urls: int | None = None,
    max_sitemaps: int | None = None,
) -> DataFrame:
    """Audit the pages of ``log`` that a crawl with these options would have visited.

    ``log`` may hold several fetches of a URL: the last one of each normalised URL
    counts.  Pages come back in the declared report schema plus ``crawl_seq``,
    their position in breadth-first order.  URLs that the crawl admits and the log
    does not hold are rows too, failed with the reason ``not collected``; they
    count for ``max_pages``, as every admitted URL does.  Nothing is capped unless
    asked.  A ``link_status`` table switches the link checks on;
    ``link_status="log"`` takes it from the log itself.
    """
    listed = listed_urls(url_lines) if url_lines is not None else None
    start = _start(start_url, listed, from_sitemap)
    sources = [_one_row(log, url=start_url)] if start_url else []
    if listed is not None:
        sources.append(with_position(listed.select("url", F.col("pos").alias("line")), ["line"], "pos", "listed"))
    if from_sitemap:
        sources.append(_sitemap_seeds(log, start, from_sitemap, robots_txt, sitemap_docs, max_sitemap_urls, max_sitemaps, same_domain))
    merged = with_position(merge_seeds(*sources).select("url", "source", F.col("pos").alias("at")), ["source", "at"], "pos", "seeds")
    seeds = merged.select(F.lit(start).alias("start_url"), "url", "pos")

    site = _root(start)
    wanted = log
    if same_domain and not list_only:
        wanted = log.filter(urls.same_site(F.col("url"), F.lit(site)))
    facts = materialize(_facts(final_fetches(wanted), site), "facts")
    policy = None
    if respect_robots and robots_txt is not None:  # of the one host that decides, parsed once
        policy = materialize(agent_policy(robots_txt.filter(F.col("host") == _host(start)), agent), "policy")
    reached = crawl_expand(seeds, page_links(facts), policy, max_pages, max_depth, same_domain, list_only)
    order = with_position(reached.select("url", "depth", "path"), ["depth", "path"], "_seq", "reached")
    norm = urls.normalize(F.col("url"))
    absent = order.join(facts.select(norm.alias("url")), "url", "left_anti")
    every = facts.unionByName(_facts(_not_collected(absent.select("url")), site))
    visited = materialize(
        every.withColumn("_norm", norm)
        .join(order.select(F.col("url").alias("_norm"), "_seq"), "_norm")
        .withColumn("crawl_seq", F.col("_seq"))
        .drop("_norm", "_seq"),
        "visited",
    )
    if isinstance(link_status, str):
        link_status = materialize(link_status_from_log(log), "link-status")
    audited = apply_findings(visited, site_findings(visited, link_status))
    return as_report(audited, keep=["crawl_seq"])
