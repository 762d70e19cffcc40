"""Language annotations must be returned by the page they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.functions import urls


def _norm() -> Column:
    return urls.normalize(F.when(F.col("final_url") != "", F.col("final_url")).otherwise(F.col("url")))


def page_index(facts: DataFrame) -> DataFrame:
    """``(norm, crawl_seq)``: the last page of each normalised URL."""
    return facts.select(_norm().alias("norm"), "crawl_seq").groupBy("norm").agg(F.max("crawl_seq").alias("crawl_seq"))


def hreflang_edges(facts: DataFrame) -> DataFrame:
    """``(crawl_seq, pos, lang, href, src, dst)``: one row per annotation."""
    return (
        facts.filter(F.size("hreflang") > 0)
        .select("crawl_seq", _norm().alias("src"), F.posexplode("hreflang").alias("pos", "h"))
        .select("crawl_seq", "pos", "h.lang", "h.href", "src", urls.normalize(F.col("h.href")).alias("dst"))
    )


def unreciprocated(facts: DataFrame) -> DataFrame:
    """The first annotation of each page whose collected target does not point back.

    The last page of each URL is found together with all it points to, its own annotations, so an annotation meets
    its target once: whether the target is collected and whether it points back is told by the same row.
    """
    page = F.struct("crawl_seq", F.transform("hreflang", lambda h: urls.normalize(h.href)).alias("targets"))
    targets = facts.select(_norm().alias("dst"), page.alias("page")).groupBy("dst").agg(F.max("page").alias("page"))
    checked = hreflang_edges(facts).filter(F.lower("lang") != "x-default")
    missing = checked.join(targets, "dst").filter(~F.array_contains("page.targets", F.col("src")))
    return missing.groupBy("crawl_seq").agg(F.min_by("href", "pos").alias("href"))


def hreflang_issues(facts: DataFrame) -> DataFrame:
    return unreciprocated(facts).select(
        "crawl_seq",
        F.lit(32).alias("seq"),
        F.lit(0).alias("pos"),
        F.lit("hreflang_reciprocity").alias("code"),
        F.concat(F.lit("hreflang not reciprocated by "), "href").alias("message"),
    )
