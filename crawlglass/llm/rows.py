"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Bytes of text that one step inside a task looks at together; a longer text makes a step of its own.
STEP_BYTES = 4_000_000


def name(column: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given input columns under the operator's own names, so no other column can clash with them."""
    return df.select(*(name(source).alias(own) for own, source in columns.items()))


def packed(df: DataFrame, into: str = "row") -> DataFrame:
    """All columns as one struct, so that columns added beside it cannot clash with them."""
    return df.select(F.struct(*(name(c) for c in df.columns)).alias(into))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(doc_id, text)`` with ``row``, a key that rows of one id and different texts do not share.

    It is the id where no id has different texts, else a hash of id and text; the second value tells which.  Rows with
    equal ids and texts are alike in all they get, so they may share a key; hashes of different ids may meet, so who
    joins on hashes compares the ids as well.
    """
    body = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(body).alias("least"), F.max(body).alias("most"))
    repeated = not texts.filter("least <> most").isEmpty()
    return docs.withColumn("row", F.xxhash64("doc_id", body) if repeated else F.col("doc_id")), repeated


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, cut so that the texts of one step have at most ``limit`` bytes (or are one text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a step; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
