"""Breadth-first expansion over collected pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlglass.functions import urls
from crawlglass.operators.edges import store_edges
from crawlglass.operators.skew import first_per_key
from crawlglass.sources.robots import prefix_index, with_robots_decision
from crawlglass.sources.sitemaps import _cap_per_group
from crawlglass.storage import materialize, materialize_counted


def merge_seeds(*sources: DataFrame) -> DataFrame:
    """``(url, source, pos)`` of several ``(url, pos)`` lists: normalised, first occurrence kept."""
    merged = None
    for rank, source in enumerate(sources):
        part = source.filter(F.col("url") != "").select(
            urls.normalize(F.col("url")).alias("url"),
            F.lit(rank).alias("source"),
            F.col("pos").cast("bigint").alias("pos"),
        )
        merged = part if merged is None else merged.unionByName(part)
    return first_per_key(merged, ["url"], ["source", "pos"])


def eligible(candidates: DataFrame, policy: DataFrame | None, same_domain: bool) -> DataFrame:
    """Filter ``(site, host, url, …)`` by file suffix, site and robots policy.

    ``host`` names the start URL's robots.txt; row-local tests run before the join.
    """
    kept = candidates.filter(~urls.has_skipped_extension(F.col("url")))
    if same_domain:
        kept = kept.filter(urls.same_site(F.col("url"), F.col("site")))
    if policy is None:
        return kept
    return with_robots_decision(kept, policy).filter("allowed").drop("allowed")


def page_links(facts: DataFrame) -> DataFrame:
    """``(url, pos, target)``: the links a crawl follows, which are the internal http ones."""
    return (
        facts.select(urls.normalize(F.col("url")).alias("url"), F.explode("links").alias("l"))
        .filter("l.is_internal AND l.is_web")
        .select("url", "l.pos", F.col("l.url").alias("target"))
    )


def unvisited(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """``(site, host, url, …)`` of pages that their crawl has not admitted yet."""
    return candidates.join(visited, ["site", "host", "url"], "left_anti")


def crawl_expand(
    seeds: DataFrame,
    links: DataFrame,
    policy: DataFrame | None = None,
    max_pages: int | None = None,
    max_depth: int | None = None,
    same_domain: bool = True,
    list_only: bool = False,
) -> DataFrame:
    """URLs admitted by a breadth-first crawl: ``(site, host, url, depth, path)``.

    ``seeds`` is ``(start_url, url, pos)``: every start URL is a crawl of its own.
    Nothing is capped unless asked: ``max_pages`` holds for each crawl, and
    ``max_depth`` 0 admits the seeds only.  ``links`` is :func:`page_links`.  Order is
    (depth, path), ``path`` being the link positions from the seed.  Links are stored
    once, in buckets by page, and read in place at each level.  Each level is
    one job that ends in a written table; targets are reduced to their first
    occurrence by a partial aggregate before they meet the visited set.
    """
    edges = None if list_only else store_edges(links, "url", "links")
    if policy is not None and not list_only:
        policy = materialize(prefix_index(policy), "robots-index")
    frontier = seeds.select(
        urls.site_of(F.col("start_url")).alias("site"),
        urls.netloc(F.col("start_url")).alias("host"),
        urls.normalize(F.col("url")).alias("url"),
        F.lit(0).alias("depth"),
        F.array(F.col("pos").cast("bigint")).alias("path"),
    )
    visited, total, depth = None, 0, 0
    while True:
        frontier = first_per_key(frontier, ["site", "host", "url"], ["path"])
        if visited is not None:
            frontier = unvisited(frontier, visited)
        if not list_only:
            frontier = eligible(frontier, policy, same_domain)
        frontier, n = materialize_counted(frontier, "crawl-level")
        if max_pages and n + total > max_pages:
            frontier, n = materialize_counted(
                _cap_per_group(frontier, ["site", "host"], ["path"], max_pages, visited, "crawl-rank"), "crawl-level"
            )
        visited = frontier if visited is None else visited.unionByName(frontier)
        total += n
        if n == 0 or list_only or depth == max_depth:
            return visited
        depth += 1
        frontier = edges.follow(frontier).select(
            "site", "host", F.col("target").alias("url"), F.lit(depth).alias("depth"),
            F.array_append("path", F.col("pos").cast("bigint")).alias("path"),
        )
