"""Report outputs: nested JSON Lines, flat CSV, and the tallies of a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlglass.operators.tally import all_tallies
from crawlglass.plans.page_audit import as_report
from crawlglass.storage import materialize

# Columns of the flat summary, in order.
FLAT_COLUMNS = [
    "url", "final_url", "status_code", "parse_ok", "response_time_ms", "indexable",
    "indexability_reason", "title", "title_length", "title_pixel_width",
    "meta_description_length", "meta_description_pixel_width",
    "canonical_is_self", "canonical_count", "canonical_target_status",
    "h1_count", "h2_count", "h3_count", "h4_count", "h5_count", "h6_count",
    "heading_order_ok", "word_count", "text_html_ratio",
    "internal_links", "external_links", "nofollow_links", "sponsored_links",
    "ugc_links", "empty_anchor_links", "generic_anchor_links",
    "broken_links_count", "redirecting_links_count",
    "images_total", "images_missing_alt", "images_missing_dimensions",
    "images_lazy_loaded", "hreflang_count", "hreflang_has_xdefault",
    "schema_types", "microdata_types", "rdfa_used", "mixed_content",
    "is_https", "hsts", "issue_count",
]


def flat_summary(report: DataFrame) -> DataFrame:
    """One flat row per page; nested values become counts or ``|``-joined texts."""
    derived = {
        "hreflang_count": F.size("hreflang"),
        "schema_types": F.array_join(F.array_sort(F.array_distinct("schema_types")), "|"),
        "microdata_types": F.array_join("microdata_types", "|"),
        "heading_order_ok": F.size("heading_order_issues") == 0,
        "broken_links_count": F.size("broken_links"),
        "redirecting_links_count": F.size("redirecting_links"),
        "issue_count": F.size("issues"),
    }
    return report.select(*[derived.get(c, F.col(c)).alias(c) for c in FLAT_COLUMNS])


def write_json(report: DataFrame, path: str) -> None:
    """JSON Lines, one page per row, every declared field present."""
    as_report(report).write.option("ignoreNullFields", "false").json(path)


def write_csv(report: DataFrame, path: str) -> None:
    flat_summary(report).write.option("header", True).option("escape", '"').csv(path)


def write_outputs(report: DataFrame, prefix: str, k: int = 12, order: str = "url") -> dict[str, DataFrame]:
    """Both files and the tables of :func:`summary`; the report is computed once."""
    stored = materialize(report, "report")
    write_json(stored, f"{prefix}.json")
    write_csv(stored, f"{prefix}.csv")
    return summary(stored, k, order)


def summary(report: DataFrame, k: int = 12, order: str = "crawl_seq") -> dict[str, DataFrame]:
    """The three small tables of a printed summary, from one pass over the report."""
    counted = materialize(all_tallies(report, order), "summary")
    of = lambda part: counted.filter(F.col("part") == part)
    return {
        "indexable": of("indexable").agg(
            F.coalesce(F.sum(F.when(F.col("value") == "true", F.col("n"))), F.lit(0)).cast("bigint").alias("n_indexable"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_pages"),
        ),
        "statuses": of("status").select(F.col("value").cast("int").alias("status_code"), F.col("n").alias("n_pages")).orderBy("status_code"),
        "issues": of("issue").orderBy(F.desc("n"), "first_seen").limit(k).select(F.col("value").alias("issue"), "n"),
    }
