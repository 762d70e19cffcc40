"""Response-level columns and the fetch verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.functions import urls


def header(name: str) -> Column:
    """A response header (the fetch log keeps lower-case keys); ``''`` when absent."""
    return F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))


def from_pages(pages: DataFrame) -> DataFrame:
    """Lift ``pages(page_id, url, html)`` to a fetch log of successful responses."""
    return pages.select(
        F.col("page_id").alias("crawl_seq"),
        "url",
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.array().cast("array<int>").alias("redirect_chain"),
        F.lit(0).alias("response_time_ms"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"),
        "html",
        F.lit(None).cast("string").alias("error"),
    )


def add_response_columns(fetch_log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Status, header and verdict columns; ``audit_stage`` tells how far a page got."""
    failed = F.col("error").isNotNull()
    ok = lambda value, default: F.when(failed, F.lit(default)).otherwise(value)
    length_header = F.try_element_at("headers", F.lit("content-length"))
    site = F.col("site") if "site" in fetch_log.columns else F.lit(None).cast("string")
    df = fetch_log.select(
        "crawl_seq",
        "url",
        F.coalesce(ok(F.col("final_url"), ""), F.lit("")).alias("final_url"),
        ok(F.col("status_code"), -1).alias("status_code"),
        F.when(failed, F.array().cast("array<int>"))
        .otherwise(F.coalesce("redirect_chain", F.array().cast("array<int>")))
        .alias("redirect_chain"),
        ok(F.coalesce("response_time_ms", F.lit(0)), 0).alias("response_time_ms"),
        ok(header("content-type"), "").alias("content_type"),
        ok(header("content-encoding"), "").alias("content_encoding"),
        ok(header("cache-control"), "").alias("cache_control"),
        ok(header("x-robots-tag"), "").alias("x_robots_tag"),
        ok(header("link"), "").alias("_link_header"),
        ok(F.coalesce(F.map_contains_key("headers", "strict-transport-security"), F.lit(False)), False).alias("hsts"),
        ok(F.coalesce(F.col("final_url").startswith("https://"), F.lit(False)), False).alias("is_https"),
        F.when(failed | length_header.isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.coalesce(F.trim(length_header).try_cast("bigint"), F.octet_length("html").cast("bigint"), F.lit(0)))
        .alias("content_length"),
        F.col("error").alias("_error"),
        F.coalesce(site, urls.site_of(F.coalesce("final_url", "url"))).alias("site"),
        F.col("html").alias("_html"),
        *(keep or []),
    )
    stage = (
        F.when(F.col("_error").isNotNull(), "failed")
        .when(F.col("status_code") >= 400, "error")
        .when(~F.contains(F.lower("content_type"), F.lit("html")), "non_html")
        .otherwise("html")
    )
    return df.withColumn("audit_stage", stage)
