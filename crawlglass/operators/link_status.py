"""Broken and redirecting links, and the status of canonical targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.functions import urls


def link_rows(facts: DataFrame) -> DataFrame:
    """``(crawl_seq, pos, url, is_internal)`` of every http(s) link occurrence."""
    return (
        facts.select("crawl_seq", F.explode("links").alias("l"))
        .filter("l.is_web")
        .select("crawl_seq", "l.pos", "l.url", "l.is_internal")
    )


def canonical_targets(facts: DataFrame) -> DataFrame:
    """``(crawl_seq, url)`` of canonicals that point elsewhere."""
    return facts.filter((F.col("canonical") != "") & ~F.col("canonical_is_self")).select(
        "crawl_seq", urls.normalize(F.col("canonical")).alias("url")
    )


def distinct_targets(facts: DataFrame) -> DataFrame:
    """Every URL whose status is worth knowing, once."""
    return link_rows(facts).select("url").union(canonical_targets(facts).select("url")).distinct()


def is_broken(status: Column) -> Column:
    return (status == -1) | (status >= 400)


def faulty_links(facts: DataFrame, link_status: DataFrame) -> DataFrame:
    """Link occurrences whose target is broken or redirects.

    Healthy and unknown targets cannot yield a finding, so they leave before the join.
    """
    faulty = link_status.filter(is_broken(F.col("status")) | F.col("redirected"))
    return link_rows(facts).join(faulty, "url").withColumn("broken", is_broken(F.col("status")))


def page_link_findings(faulty: DataFrame) -> DataFrame:
    """Per page: broken and redirecting links in document order (one page's own links)."""
    item = F.struct("pos", F.struct("url", "status").alias("link"))
    ordered = lambda condition: F.transform(
        F.array_sort(F.collect_list(F.when(condition, item))), lambda x: x.link
    )
    return faulty.groupBy("crawl_seq").agg(
        ordered(F.col("broken")).alias("broken_links"),
        ordered(~F.col("broken")).alias("redirecting_links"),
    )


def canonical_status(facts: DataFrame, link_status: DataFrame) -> DataFrame:
    """``(crawl_seq, url, status, redirected)``; an unknown target has status 0."""
    joined = canonical_targets(facts).join(link_status, "url", "left")
    return joined.select(
        "crawl_seq", "url",
        F.coalesce("status", F.lit(0)).alias("status"),
        F.coalesce("redirected", F.lit(False)).alias("redirected"),
    )


def canonical_message(status: Column, redirected: Column) -> Column:
    return F.when(
        is_broken(status), F.concat(F.lit("Canonical target is unreachable (HTTP "), status, F.lit(")"))
    ).when(redirected, "Canonical points to a redirect")
