"""URL lists: text files with one URL per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlglass.functions import text as T, urls


def read_url_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``pos``, a sortable key that follows the order of the file."""
    return spark.read.text(path).select(
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("pos"),
        F.col("value").alias("line"),
    )


def _entries(lines: DataFrame) -> DataFrame:
    line = T.strip(F.col("line"))
    return lines.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def listed_urls(lines: DataFrame) -> DataFrame:
    """``(pos, url)`` of the lines that hold a web URL."""
    return _entries(lines).filter(urls.has_web_scheme(F.col("line"))).withColumnRenamed("line", "url")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines left out because they have no scheme."""
    return _entries(lines).filter(~urls.has_web_scheme(F.col("line")))
