"""Values shared by several pages: titles, descriptions, H1s, self-canonical targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlglass.functions import urls
from crawlglass.operators.skew import HOT_ROWS, hot_keys, join_unique

LABELS = ("Duplicate title", "Duplicate meta description", "Duplicate H1", "Duplicate canonical target")


def duplicate_candidates(facts: DataFrame) -> DataFrame:
    """``(crawl_seq, pos, label, value)``: one unpivoting pass for all four labels."""
    values = (
        F.col("title"),
        F.col("meta_description"),
        F.when(F.col("h1_count") == 1, F.get("h1", F.lit(0))),
        F.when(F.col("canonical_is_self"), urls.normalize(F.col("canonical"))),
    )
    pairs = [
        F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("label"), value.alias("value"))
        for pos, (label, value) in enumerate(zip(LABELS, values))
    ]
    return (
        facts.filter("parse_ok")
        .select("crawl_seq", F.explode(F.array(*pairs)).alias("v"))
        .select("crawl_seq", "v.*")
        .filter(F.col("value") != "")
    )


def duplicate_groups(candidates: DataFrame) -> DataFrame:
    """``(label, value, n)`` of values on more than one page."""
    return (
        candidates.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def duplicate_members(candidates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every page of every duplicate group, with the group size."""
    groups = duplicate_groups(candidates)
    hot = hot_keys(groups, ["label", "value"], "n", hot_rows)
    return join_unique(candidates, groups, ["label", "value"], spread="crawl_seq", hot=hot)


def duplicate_issues(candidates: DataFrame) -> DataFrame:
    return duplicate_members(candidates).select(
        "crawl_seq",
        F.lit(31).alias("seq"),
        "pos",
        F.lit("duplicate").alias("code"),
        F.concat("label", F.lit(" (shared by "), "n", F.lit(" pages)")).alias("message"),
    )
