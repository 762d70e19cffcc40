"""Vector best-fit packing of documents into training sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths).  Pieces
are taken from the largest to the smallest; among the open sequences that still hold a piece in every dimension, the
one with the smallest weighted norm of what would remain (``rule="norm"``) or the largest weighted dot-product of
demand and residual (``rule="dot"``) takes it.  Demands and residuals are parts of the capacities.

Lengths, not token ids, are shuffled: shards of some thousand pieces, dealt by a hash, are packed independently.
Each shard leaves at most a sequence or two partly filled, and the number of shards follows the number of pieces.

A mixture is packed in runs instead (:func:`pack_in_order`): contiguous stretches of the stored order, so that the order
of the sources outlives packing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from crawlglass.llm.rows import name, narrow, steps, texts_of
from crawlglass.llm.tokens import encoder
from crawlglass.storage import materialize

TOKENIZER = "byte_bpe_50k.json"
TOKENS, END_ID, SHARD_PIECES = 2_048, 0, 8_192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
PLACE = ", part string, row long"  # where a piece's document is stored
RUN_SEQUENCES, GROUP_ROWS, LEAST = 256, 64, 32  # a piece counts at least 1 / LEAST of a sequence


def pieces(
    docs: DataFrame, tokenizer: str | None = None, *, tokens: int = TOKENS, end_id: int = END_ID,
    doc_id: str = "doc_id", text: str = "text", placed: bool = False,
) -> DataFrame:
    """One row a piece: its document, number from 0, first id and number of ids in the document, and their crc32.

    ``end_id`` follows each document's ids.  Documents of more than ``tokens`` ids are cut into pieces of ``tokens``
    ids, of which the first may be shorter.  A null text is empty and gives one piece, the end id.  Rows with a null
    or repeated id are documents like others; no rows give no rows.  With ``placed``, ``docs`` is read from Parquet and
    each piece has the file (``part``) and the number (``row``) of its document.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for step in steps(batches):
            owner, number, start, length, sums = [], [], [], [], []
            for i, text_ in enumerate(texts_of(step)):
                ids = np.append(encode(text_).astype("<u4"), np.uint32(end_id))
                first = len(ids) % tokens or tokens
                bounds = [0, *range(min(first, len(ids)), len(ids) + 1, tokens)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    owner.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    sums.append(crc32(ids[a:b].astype("<u4").tobytes()))
            rows = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [step.column(0).take(rows), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(sums, pa.int64()), *(step.column(c).take(rows) for c in place)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", *place],
            )

    place = ["part", "row"] if placed else []
    if placed:
        # Spark numbers the files of a table: five digits or more, then maybe a count of files of one task.
        file = F.col("_metadata.file_name")
        part = F.concat(F.lpad(F.regexp_extract(file, r"^part-(\d+)", 1), 10, "0"), file)
        base = docs.select(name(doc_id).alias("doc_id"), name(text).alias("text"), part.alias("part"), F.col("_metadata.row_index").alias("row"))
    else:
        base = narrow(docs, doc_id=doc_id, text=text)
    return base.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, PIECES + PLACE * placed)


def best_fit(
    demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each row of ``demand`` (in the given order) and what its bin held of dimension 0 before.

    A row that exceeds a capacity on its own gets a bin of its own.  Ties go to the bin opened first.
    """
    n = len(demand)
    bins, before = np.empty(n, np.int64), np.zeros(n, np.int64)
    part = demand / capacity
    least = demand[::-1]
    least = np.minimum.accumulate(least, axis=0)[::-1] if n else least  # the smallest demand from a row on
    left = np.empty((max(n, 1), demand.shape[1]))  # residual of each open bin
    number = np.empty(max(n, 1), np.int64)
    opened = live = 0
    for i in range(n):
        room = left[:live]
        fits = np.flatnonzero((room >= demand[i]).all(axis=1))
        if len(fits):
            share = room[fits] / capacity
            if rule == "dot":
                best = fits[np.argmax((share * part[i] * weights).sum(axis=1))]
            else:
                best = fits[np.argmin((((share - part[i]) ** 2) * weights).sum(axis=1))]
        else:
            best = live
            left[best], number[best] = capacity, opened
            live, opened = live + 1, opened + 1
        bins[i], before[i] = number[best], capacity[0] - left[best, 0]
        left[best] -= demand[i]
        if i + 1 < n and (left[best] < least[i + 1]).any():  # nothing fits there any more
            left[best : live - 1], number[best : live - 1] = left[best + 1 : live].copy(), number[best + 1 : live].copy()
            live -= 1
    return bins, before


def pack(
    cut: DataFrame, *, tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
    weights: Mapping[str, float] | None = None, rule: str = "norm", shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """``sequence_id`` and gapless ``offset`` for each row of ``cut`` (the columns of :func:`pieces`).

    ``documents`` and ``attention`` (sum of squared lengths) bound a sequence further; None sets no bound beyond
    ``tokens``.  A piece over a bound on its own gets its own sequence.  The order is by demand, then document and
    piece, so equal pieces are placed alike in every run; repeated rows each get a place; no rows give no rows.
    """
    cut = materialize(cut, "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    capacity = np.array([tokens, documents or tokens, attention or tokens**2], float)
    by = weights or {}
    share = np.array([by.get("tokens", 1.0), by.get("documents", 0.01), by.get("attention", 0.01)])

    def fill(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        length = shard["length"].to_numpy()
        demand = np.stack([length, np.ones_like(length), length**2], axis=1).astype(float)
        size = (demand / capacity * share).sum(axis=1)
        known = shard["doc_id"].astype("Int64").fillna(-1).to_numpy(np.int64)
        order = np.lexsort((shard["piece"].to_numpy(), known, -size))
        shard = shard.iloc[order]
        bins, before = best_fit(demand[order], capacity, share, rule)
        return shard.drop(columns="shard").assign(sequence_id=(int(key[0]) << 32) + bins, offset=before)

    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard")
    return cut.select("*", shard).groupBy("shard").applyInPandas(fill, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Cut and pack whole documents; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, tokenizer), **options)


def pack_in_order(
    cut: DataFrame, *, tokens: int = TOKENS, run_sequences: int = RUN_SEQUENCES, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The columns of :func:`pack` for each row of ``cut`` (:func:`pieces` with ``placed``); ids follow the stored order.

    The stored order is cut into runs that fill about ``run_sequences`` sequences, at a multiple of ``group_rows``
    documents of a file.  Best-fit works inside a run.  ``sequence_id`` rises from run to run, and within a run by the
    place of the piece that opened the sequence; so every prefix of the sequences is a prefix of the stored order,
    but for one run.
    """
    cut = materialize(cut, "placed-pieces").withColumn("group", F.floor(F.col("row") / group_rows))
    mass = F.sum(F.greatest(F.col("length"), F.lit(-(-tokens // LEAST)))).alias("mass")
    groups = cut.groupBy("part", "group").agg(mass)
    earlier = lambda w: F.coalesce(F.sum("mass").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = groups.groupBy("part").agg(F.sum("mass").alias("mass")).select("part", earlier(W.orderBy("part")).alias("first"))
    inside = groups.select("part", "group", earlier(W.partitionBy("part").orderBy("group")).alias("before"))
    run = F.floor((F.col("first") + F.col("before")) / (tokens * run_sequences)).alias("run")
    runs = inside.join(files, "part").select("part", "group", run)
    capacity = np.array([tokens, tokens, tokens**2], float)
    share = np.array([1.0, 0.01, 0.01])

    def fill(key: tuple, pieces_: pd.DataFrame) -> pd.DataFrame:
        place = np.empty(len(pieces_), np.int64)
        place[np.lexsort((pieces_["piece"], pieces_["row"], pieces_["part"]))] = np.arange(len(pieces_))
        length = pieces_["length"].to_numpy()
        order = np.lexsort((place, -length))
        length, place = length[order], place[order]
        demand = np.stack([length, np.ones_like(length), length**2], axis=1).astype(float)
        bins, before = best_fit(demand, capacity, share)
        rank = np.argsort(np.argsort(place[np.unique(bins, return_index=True)[1]]))
        out = pieces_.iloc[order].drop(columns=["run", "part", "group", "row"])
        return out.assign(sequence_id=(int(key[0]) << 32) + rank[bins], offset=before)

    return cut.join(runs, ["part", "group"]).groupBy("run").applyInPandas(fill, PACKED)


def pack_mixture(docs: DataFrame, tokenizer: str | None = None, *, tokens: int = TOKENS, **options) -> DataFrame:
    """Cut documents that are stored in the order of a mixture, and pack them in that order."""
    return pack_in_order(pieces(docs, tokenizer, tokens=tokens, placed=True), tokens=tokens, **options)
