"""Site-level tallies: status histogram, indexable share, most frequent issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.functions import text as T


def issue_key(message: Column) -> Column:
    """Digits become ``N``; the key ends before the first colon."""
    return T.strip(F.substring_index(F.regexp_replace(message, r"(?U)\d+", "N"), ":", 1))


def status_histogram(report: DataFrame) -> DataFrame:
    return report.groupBy("status_code").agg(F.count(F.lit(1)).alias("n_pages")).orderBy("status_code")


def indexable_share(report: DataFrame) -> DataFrame:
    return report.agg(F.count_if("indexable").alias("n_indexable"), F.count(F.lit(1)).alias("n_pages"))


def issue_tally(report: DataFrame, order: str = "crawl_seq") -> DataFrame:
    """``(issue, n, first_seen)``; ``first_seen`` keeps ties in order of appearance."""
    issues = report.select(order, F.posexplode("issues").alias("pos", "message"))
    return issues.groupBy(issue_key(F.col("message")).alias("issue")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos")).alias("first_seen")
    )


def tally_rows(issues: DataFrame) -> DataFrame:
    """The same from one row an issue, ``(crawl_seq, seq, pos, message)``: one partial aggregate, no page is built."""
    return issues.groupBy(issue_key(F.col("message")).alias("issue")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("crawl_seq", "seq", "pos")).alias("first_seen")
    )


def top_issues(report: DataFrame, k: int = 12, order: str = "crawl_seq") -> DataFrame:
    """Of a page report, or of issue rows."""
    counted = tally_rows(report) if "message" in report.columns else issue_tally(report, order)
    ranked = counted.orderBy(F.desc("n"), "first_seen").limit(k)
    return ranked.select("issue", "n")


def all_tallies(report: DataFrame, order: str = "crawl_seq") -> DataFrame:
    """``(part, value, n, first_seen)``: statuses, indexable pages and issues, all counted by one partial aggregate."""
    one = lambda part, value, pos: F.struct(
        F.lit(part).alias("part"), value.cast("string").alias("value"), F.lit(pos).alias("pos") if isinstance(pos, int) else pos.alias("pos")
    )
    pages = F.array(one("status", F.col("status_code"), 0), one("indexable", F.col("indexable"), 0))
    issues = F.transform("issues", lambda message, i: one("issue", issue_key(message), i))
    rows = report.select(order, F.explode(F.concat(pages, issues)).alias("r")).select(order, "r.*")
    return rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos")).alias("first_seen"))
