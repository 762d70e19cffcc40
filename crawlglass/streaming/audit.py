"""The row-local audit on a stream of fetch-log rows, and its stateful companions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from crawlglass.functions import urls
from crawlglass.operators.tally import issue_key
from crawlglass.plans.page_audit import page_audit, page_facts
from crawlglass.schema import FETCH_LOG_SCHEMA


def read_fetch_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(FETCH_LOG_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def stream_page_audit(log: DataFrame) -> DataFrame:
    """Stateless: each arriving page is audited by the same columns as in batch."""
    return page_audit(log)


def stream_dedup(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each normalised URL once.  State is dropped behind the watermark, so a URL
    fetched again later than ``delay`` counts as new."""
    return (
        log.withWatermark("fetched_at", delay)
        .withColumn("norm", urls.normalize(F.col("url")))
        .dropDuplicatesWithinWatermark(["norm"])
    )


def tally_to(tally: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole tally of an input that ends in ``path``: windows still open at its end are there too.

    Each batch replaces the table, and all windows stay in the state.  For an endless input append the closed windows
    instead: ``tally.writeStream.outputMode("append")``.
    """
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    return (
        tally.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(replace).start()
    )


def _windowed_issues(log: DataFrame, window: str, keep: list[str]) -> DataFrame:
    issues = page_facts(log, keep=keep).select(*keep, F.explode("page_issues").alias("issue"))
    return issues.select(
        *keep, F.window("fetched_at", window).alias("w"), issue_key(F.col("issue.message")).alias("issue")
    )


def stream_issue_tally(log: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Issue counts per tumbling window of fetch time; late rows are dropped by the watermark."""
    issues = _windowed_issues(log.withWatermark("fetched_at", delay), window, ["fetched_at"])
    return issues.groupBy("w", "issue").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "issue", "n"
    )


class _Pending(StatefulProcessor):
    """Counts the rows of a key that were not told yet, and tells them when its timer fires."""

    def __init__(self, wait_ms: int):
        self._wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._count = handle.getValueState("pending", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self._count.exists():  # the first row not told sets the timer; further ones do not put it off
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._wait_ms)
            self._count.update((0,))
        self._count.update((self._count.get()[0] + sum(map(len, rows)),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = self._count.get()[0]
        self._count.clear()
        yield pd.DataFrame({"window_start": [key[0]], "issue": [key[1]], "n": [told]})

    def close(self) -> None:
        pass


def stream_live_tally(log: DataFrame, window: str = "1 hour", wait_ms: int = 60_000) -> DataFrame:
    """Increments of the issue counts of all windows, open and late ones too: the sums of ``n`` are the counts.

    A window's first row that is not told yet sets a timer, and after ``wait_ms`` an increment tells all rows since:
    also when the input stalls and no watermark moves.  The state holds what is not told yet and nothing else, so it is
    bounded by the windows and issues of one waiting time, however long the stream runs, and no row is dropped as late.
    The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    issues = _windowed_issues(log, window, ["fetched_at"]).select(F.col("w.start").alias("window_start"), "issue")
    return issues.groupBy("window_start", "issue").transformWithStateInPandas(
        _Pending(wait_ms), "window_start timestamp, issue string, n bigint", "Append", "ProcessingTime"
    )


# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
