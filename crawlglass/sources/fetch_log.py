"""The fetch log: reading it, reducing repeated attempts, and what it says about URLs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from crawlglass.functions import urls
from crawlglass.operators.skew import with_position
from crawlglass.schema import FETCH_LOG_SCHEMA
from crawlglass.storage import materialize

# Statuses that are tried again.
RETRY_STATUSES = (429, 500, 502, 503, 504)
# Default spacing of requests, and the lower end of its jitter.
DEFAULT_DELAY, JITTER_FLOOR = 0.3, 0.85
# Bytes of bitmaps that one scan of a stored log is told its rows by: half a billion rows.
LOCATOR_BYTES = 64 << 20


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(FETCH_LOG_SCHEMA).format(fmt).load(path)


def read_link_status(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema("url string, status int, redirected boolean").format(fmt).load(path)


def assign_crawl_seq(log: DataFrame) -> DataFrame:
    """Number the pages by fetch time.

    Only fetch time, URL and attempt are sorted; page texts move once, to meet their number.  Rows that agree in all
    three share a number: reduce the log to :func:`final_fetches` first.
    """
    key = ["fetched_at", "url", "attempt"]
    numbers = with_position(log.select(*key).distinct(), ["fetched_at", "url", "attempt"], "crawl_seq", "crawl-seq")
    return log.drop("crawl_seq").join(numbers.toDF(*(f"_{c}" if c in key else c for c in numbers.columns)), [
        F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key
    ]).drop(*(f"_{c}" for c in key))


def with_page_key(log: DataFrame) -> DataFrame:
    """``log`` with a ``crawl_seq`` that tells its rows apart.

    A log without numbers gets them by fetch time; numbers that are partly missing, or not unique, are refused, as
    findings of one page would be reported for another.
    """
    if "crawl_seq" not in log.columns:
        return assign_crawl_seq(log)
    known = log.agg(
        F.count(F.lit(1)).alias("rows"), F.count("crawl_seq").alias("numbered"), F.count_distinct("crawl_seq").alias("different")
    ).first()
    if known.rows and not known.numbered:
        return assign_crawl_seq(log)
    if known.numbered < known.rows or known.different < known.rows:
        raise ValueError("crawl_seq must be set and unique for every row of the fetch log, or for none")
    return log


def _last_first(log: DataFrame) -> list[str]:
    return [c for c in ("fetched_at", "attempt") if c in log.columns]


def retry_rollup(log: DataFrame) -> DataFrame:
    """Per URL: status of the last attempt, attempts, and how many were retryable."""
    return log.groupBy("url").agg(
        F.max_by("status_code", F.struct(*_last_first(log), "status_code")).alias("status_code"),
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(F.col("status_code").isin(*RETRY_STATUSES)).alias("n_retryable"),
    )


def final_attempts(log: DataFrame) -> DataFrame:
    """One row for each URL: its last attempt, by fetch time, attempt and status."""
    return _last_of(log, F.col("url"))


def final_fetches(log: DataFrame) -> DataFrame:
    """One row for each normalised URL: its last fetch, as ``/a`` and ``/a/`` are one page."""
    return _last_of(log, urls.normalize(F.col("url")))


def _stored(log: DataFrame) -> DataFrame:
    """``log`` if it is a stored Parquet table, or filters and columns of one; else a stored copy: rows need a place."""
    plan = log._jdf.queryExecution().analyzed()
    lines = plan.toString().splitlines()
    nodes = [re.match(r"\W*(\w*)", line)[1] for line in lines]
    plain = set(nodes) <= {"Project", "Filter", "SubqueryAlias", "Relation"} and lines[-1].endswith(" parquet")
    return log if plain and plan.deterministic() else materialize(log, "fetch-log")


def _last_of(log: DataFrame, page: Column) -> DataFrame:
    """The last row of each page; texts are read for these rows only, and never move.

    Winners are found on narrow columns, each by the file and row where it is stored.  As bitmaps, one bit a row of a
    file, they go to the scan that reads whole rows.  Bitmaps beyond ``LOCATOR_BYTES`` are dealt out by file: several
    scans, each of its own files.  Rows that agree in time, attempt, status and URL are taken by their place.
    """
    stored = _stored(log)
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    at = F.struct(*_last_first(log), "status_code", "url", file.alias("file"), row.alias("row"))
    last = stored.select(page.alias("page"), at.alias("at")).groupBy("page").agg(F.max("at").alias("at"))
    # The built-in bitmap functions number from 1.
    bits = last.select(F.col("at.file").alias("_file"), (F.col("at.row") + 1).alias("n")).groupBy(
        "_file", F.expr("bitmap_bucket_number(n)").alias("_part")
    ).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(n))").alias("_bits"))
    bits = materialize(bits, "last-rows")
    size = bits.agg(F.sum(F.length("_bits") + F.octet_length("_file") + 32)).first()[0] or 0
    scans = -(-size // LOCATOR_BYTES) or 1
    of_scan = lambda path, i: F.pmod(F.xxhash64(path), F.lit(scans)) == i
    read = []
    for i in range(scans):
        files, told = (stored, bits) if scans == 1 else (stored.filter(of_scan(file, i)), bits.filter(of_scan("_file", i)))
        placed = files.select("*", file.alias("_file"), row.alias("_row")).withColumn("_part", F.floor(F.col("_row") / 32_768) + 1)
        byte = F.conv(F.hex(F.substring("_bits", F.floor(F.pmod("_row", F.lit(32_768)) / 8).cast("int") + 1, F.lit(1))), 16, 10)
        bit = byte.cast("int").bitwiseAND(F.expr("shiftleft(1, CAST(pmod(_row, 8) AS INT))"))
        read.append(placed.join(F.broadcast(told), ["_file", "_part"]).filter(bit != 0).select(*(F.col(f"`{c}`") for c in log.columns)))
    return reduce(DataFrame.unionAll, read)


def link_status_from_log(log: DataFrame) -> DataFrame:
    """``(url, status, redirected)`` by normalised URL, from its latest fetch; -1 for an error."""
    status = F.when(F.col("error").isNotNull(), F.lit(-1)).otherwise(F.col("status_code"))
    redirected = F.when(F.col("error").isNotNull(), F.lit(False)).otherwise(F.size("redirect_chain") > 0)
    return (
        log.select(
            urls.normalize(F.col("url")).alias("url"),
            F.struct("fetched_at", "attempt").alias("at"),
            F.struct(status.alias("status"), redirected.alias("redirected")).alias("s"),
        )
        .groupBy("url")
        .agg(F.max_by("s", "at").alias("s"))
        .select("url", "s.status", "s.redirected")
    )


def _previous(log: DataFrame) -> DataFrame:
    """``log`` with ``previous_at``: the time of the fetch before, of the same host, by (time, ``_tie``).

    Rows are dealt out by ranges of (host, time), so a busy host is shared by as many tasks as it needs.  A range knows
    all predecessors but that of its first row, which is the last row of the range before: one small row a range.
    """
    by_time = ["host", "fetched_at", "_tie"]
    ranged = log.repartitionByRange(*by_time).sortWithinPartitions(*by_time)
    placed = materialize(ranged.withColumn("_row", F.monotonically_increasing_id()), "paced")
    placed = placed.withColumn("_range", F.shiftright("_row", 33))  # upper bits: partition of the sort
    row = F.struct("host", "fetched_at")
    lasts = placed.groupBy("_range").agg(F.max_by(row, "_row").alias("last")).orderBy("_range").collect()
    before = [(after["_range"], *own["last"]) for own, after in zip(lasts, lasts[1:])]
    starts = log.sparkSession.createDataFrame(before, "_range bigint, _host string, _before timestamp")
    last = F.lag(row).over(Window.partitionBy("_range").orderBy("_row"))
    # One row a range is broadcast.
    met = placed.withColumn("_last", last).join(F.broadcast(starts), "_range", "left")
    own = F.coalesce("_last", F.struct(F.col("_host").alias("host"), F.col("_before").alias("fetched_at")))
    return met.withColumn("previous_at", F.when(own.host == F.col("host"), own.fetched_at)).drop(
        "_row", "_range", "_last", "_host", "_before", "_tie"
    )


def pacing_audit(log: DataFrame, delays: DataFrame | None = None, delay: float = DEFAULT_DELAY, tie: str = "url") -> DataFrame:
    """Seconds since the previous fetch of the same host, and whether that was too soon.

    ``log`` has ``host`` and ``fetched_at``; ``delays`` has ``(host, crawl_delay)``.  Fetches at one time are in order
    of ``tie``.
    """
    paced = _previous(log.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withColumn("_tie", F.col(tie)))
    if delays is None:
        paced = paced.withColumn("crawl_delay", F.lit(None).cast("double"))
    else:
        paced = paced.join(delays.select("host", "crawl_delay"), "host", "left")
    allowed = F.greatest(F.lit(float(delay)), F.coalesce("crawl_delay", F.lit(0.0)))
    gap = (F.unix_micros("fetched_at") - F.unix_micros("previous_at")) / F.lit(1_000_000.0)
    return paced.withColumns({"gap_seconds": gap, "min_gap_seconds": allowed}).withColumn(
        "too_soon", F.coalesce(F.col("gap_seconds") < allowed * F.lit(JITTER_FLOOR), F.lit(False))
    ).drop("previous_at", "crawl_delay")
