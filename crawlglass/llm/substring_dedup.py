"""Duplicate substrings by prefix-free parsing: phrases, their dictionary, and suffix arrays of it.

A rolling hash of every ``GRAM`` bytes triggers phrase borders: a phrase is a maximal run of ``length``-byte strings
with the same smallest rolling hash.  Borders depend on the bytes alone, so equal strings lie in equal places of their
phrases, and each string of ``length`` bytes lies in exactly one phrase of its document.

1.  Each document asks which of its triggers occur in another document (:mod:`sharing`).  A string without a shared
    trigger is in no other document.
2.  The phrases of shared triggers go to buckets by trigger.  A bucket's distinct phrases are its dictionary; for each
    the smallest document is known.  Phrases of one trigger that differ are sorted by suffix (prefix doubling over
    8, 16, 32 and ``length`` bytes), so equal strings become neighbours, and each string gets the smallest document
    of all phrases that hold it.
3.  The parse - where each document has which phrase - carries this back to the documents as byte ranges.

A step of a task that meets a phrase in several documents asks for all places in the smallest of them only; for the
others the answer is known.  Matching is exact: rolling hashes only decide where strings meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import compress, decompress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlglass.llm.rows import narrow, steps, with_row_key
from crawlglass.llm.sharing import ASKED, answers, ask, bucket_count, key48, unpack48
from crawlglass.llm.words import mix64

LENGTH, GRAM = 50, 20
BUCKET_BYTES = 2_000_000
_PACKED_STEP = 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
# ``rows``: the keys of the rows, null where they are the ids.
PHRASES = "bucket int, triggers binary, docs binary, rows binary, starts binary, sizes binary, data binary, spans binary"


def _triggers(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of ``length`` bytes, the smallest rolling hash of its ``gram``-byte parts."""
    h, span = data.astype(np.uint64) + np.uint64(1), 1
    total, done, rest = None, 0, gram  # hash of the ``done`` bytes handled so far, by the binary digits of gram
    while rest:
        if rest & 1:
            if total is None:
                total, done = h, span
            else:
                n = len(total) - span
                total, done = total[:n] * _power(span) + h[done : done + n], done + span
        rest >>= 1
        if rest:
            h = h[: len(h) - span] * _power(span) + h[span:]
            span *= 2
    low, width, wanted = mix64(total), 1, length - gram + 1
    while width * 2 <= wanted:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    n = len(data) - length + 1
    return np.minimum(low[:n], low[wanted - width : wanted - width + n])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as deflated UTF-8: what is shuffled by document takes half the bytes."""
    for step in steps(batches):
        texts = [compress((t or "").encode("utf-8"), 1) for t in step.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([step.column(0), pa.array(texts, pa.binary()), step.column(2)], names=["doc_id", "text", "row"])


def _suffix_minimum(phrases: list[bytes], least: np.ndarray, length: int) -> list[np.ndarray]:
    """For each phrase, the smallest document of each string of ``length`` bytes in it, over all ``phrases``."""
    data = np.frombuffer(b"".join(phrases) + bytes(length), np.uint8)
    sizes = np.array([len(p) for p in phrases])
    count = sizes - length + 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = len(data) - length
    rank = np.zeros(n + length - 8 + 1, np.uint64)
    for j in range(8):  # eight bytes as a number, in byte order
        rank = (rank << np.uint64(8)) | data[j : j + len(rank)]
    width = 8
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    while width < length:
        step = min(width, length - width)
        both = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
        if width + step == length:  # only whole strings of one phrase are compared
            inside = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            both = both[inside]
        rank = np.unique(both, return_inverse=True)[1].astype(np.uint64)
        width += step
    owner = np.repeat(least, count)
    best = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, rank.astype(np.int64), owner)
    return np.split(best[rank.astype(np.int64)], np.cumsum(count)[:-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _resolve(batch: pd.DataFrame, length: int) -> pd.DataFrame:
    """Byte ranges of one bucket's askers that a smaller document has."""
    told = [np.frombuffer(x, "<i8").reshape(-1, 4) for x in batch["spans"] if x is not None]
    given = _per_row(*np.concatenate(told).T) if told else None
    batch = batch[batch["spans"].isna()]
    if not len(batch):
        return given
    col = lambda name, kind: np.frombuffer(b"".join(batch[name]), kind)
    triggers, docs, starts, sizes = col("triggers", "<u8"), col("docs", "<i8"), col("starts", "<i8"), col("sizes", "<i4")
    rows = docs if batch["rows"].isna().any() else col("rows", "<i8")
    data = b"".join(map(decompress, batch["data"]))
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    number: dict[bytes, int] = {}
    phrases, kinds, least, trigger = [], np.empty(len(docs), np.int64), [], []
    for i in range(len(docs)):
        if not sizes[i]:  # a further place of the phrase before
            kinds[i] = kinds[i - 1]
            continue
        text = data[at[i] : at[i] + sizes[i]]
        k = number.setdefault(text, len(phrases))
        if k == len(phrases):
            phrases.append(text)
            least.append(docs[i])
            trigger.append(triggers[i])
        elif docs[i] < least[k]:
            least[k] = docs[i]
        kinds[i] = k
    least, trigger = np.array(least), np.array(trigger, np.uint64)
    # Dictionary phrases of a trigger that has several: their strings are compared.
    _, kind, count = np.unique(trigger, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[kind] > 1)
    found: dict[int, np.ndarray] = {}
    if len(several):
        found = dict(zip(several.tolist(), _suffix_minimum([phrases[k] for k in several], least[several], length)))
    who, begin, end = [], [], []
    for i, k in enumerate(kinds):
        if least[k] < docs[i]:
            who.append(i), begin.append(starts[i]), end.append(starts[i] + len(phrases[k]))
        elif k in found:
            some = found[k] < docs[i]
            if some.any():
                a, b = _runs(some)
                who.extend([i] * len(a)), begin.extend(starts[i] + a), end.extend(starts[i] + b + length - 1)
    who = np.array(who, np.int64)
    found_spans = _per_row(docs[who], rows[who], np.array(begin, np.int64), np.array(end, np.int64))
    return found_spans if given is None else pd.concat([given, found_spans], ignore_index=True)


def _per_row(docs: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((docs, rows))
    docs, rows, pairs = docs[order], rows[order], np.stack([begin, end], axis=1)[order].astype("<i8")
    new = (np.diff(rows, prepend=~rows[:1]) != 0) | (np.diff(docs, prepend=~docs[:1]) != 0)
    cuts = np.flatnonzero(new) if len(rows) else np.empty(0, np.int64)
    blobs = [pairs[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(rows)))]
    return pd.DataFrame({"doc_id": docs[cuts], "row": rows[cuts], "spans": pd.Series(blobs, dtype=object)})


def duplicate_spans(
    docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows (doc_id, deflated text) with ``spans``: packed (start, end) byte ranges that a smaller document also has.

    Ranges may touch or overlap.  ``length`` is at least 24 and more than ``gram``.  See :func:`remove_duplicates`
    for the cases.
    """
    base = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    base, repeated = with_row_key(base)
    known = base.filter("doc_id IS NOT NULL")
    buckets = bucket_count(known, "text", BUCKET_BYTES)

    def question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            ids = step.column(0).to_numpy(zero_copy_only=False)
            texts = [np.frombuffer((t or "").encode("utf-8"), np.uint8) for t in step.column(1).to_pylist()]
            keys = [
                np.unique(key48(_triggers(t, length, gram))) if len(t) >= length else np.empty(0, np.uint64) for t in texts
            ]
            at = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
            if not len(at):
                continue
            keys, who = np.concatenate(keys), step.column(2).to_numpy(zero_copy_only=False)[at]
            pair = np.lexsort((who, keys))  # a row that is repeated in the step asks once
            new = np.append(True, (np.diff(keys[pair]) != 0) | (np.diff(who[pair]) != 0))
            keys, who, at = keys[pair][new], who[pair][new], at[pair][new]
            yield ask(keys, who, buckets, ids[at].astype(np.uint64) if repeated else None)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_PACKED_STEP):
            ids = step.column(0).to_numpy(zero_copy_only=False)
            texts = [np.frombuffer(decompress(t), np.uint8) for t in step.column(1).to_pylist()]
            seen: dict[bytes, tuple] = {}
            told: list[tuple] = []
            given = zip(ids.tolist(), texts, step.column(2).to_pylist(), step.column(3).to_pylist())
            for doc, data, shared, row in sorted(given, key=lambda r: r[0]):
                if len(data) < length:
                    continue
                low = _triggers(data, length, gram)
                starts = np.flatnonzero(np.diff(low, prepend=~low[:1]) != 0)
                ends = np.append(starts[1:], len(low)) + length - 1
                some = np.isin(key48(low[starts]), unpack48(b"".join(shared)))
                whole = data.tobytes()
                for a, b, key in zip(starts[some].tolist(), ends[some].tolist(), low[starts[some]].tolist()):
                    phrase = whole[a:b]
                    before = seen.setdefault(phrase, (key, doc, []))
                    if before[1] < doc:
                        told.append((doc, row, a, b))
                    else:
                        before[2].append((row, a))
            if told:
                yield _phrase_rows([buckets + told[0][0] % 64], [[None]] * 6, [np.array(told, "<i8").tobytes()])
            if not seen:
                continue
            # Further places of a phrase follow its first as records of size 0 without bytes.
            places = [
                (key, doc, at, b"" if i else phrase, row) for phrase, (key, doc, found) in seen.items() for i, (row, at) in enumerate(found)
            ]
            keys = np.array([p[0] for p in places], np.uint64)
            order = np.argsort(keys % np.uint64(buckets), kind="stable")
            bucket = (keys[order] % np.uint64(buckets)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            columns: list[list] = [[], [], [], [], [], []]
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                part = order[a:b].tolist()
                columns[0].append(keys[part].astype("<u8").tobytes())
                columns[1].append(np.array([places[i][1] for i in part], "<i8").tobytes())
                columns[2].append(np.array([places[i][4] for i in part], "<i8").tobytes() if repeated else None)
                columns[3].append(np.array([places[i][2] for i in part], "<i8").tobytes())
                columns[4].append(np.array([len(places[i][3]) for i in part], "<i4").tobytes())
                columns[5].append(compress(b"".join([places[i][3] for i in part]), 1))
            yield _phrase_rows(bucket[cuts].tolist(), columns, [None] * len(cuts))

    # The filter is what the inner join adds anyway: with it both joins deal out the texts by one and the same exchange.
    squeezed = "doc_id long, text binary, row long"
    texts = known.mapInArrow(_squeezed, squeezed).filter("row IS NOT NULL")
    shared = answers(known.mapInArrow(question, ASKED)).withColumnRenamed("id", "row")
    phrases = texts.join(shared, "row").select("doc_id", "text", "keys", "row").mapInArrow(parse, PHRASES)
    spans = phrases.groupBy("bucket").applyInPandas(lambda batch: _resolve(batch, length), "doc_id long, row long, spans binary")
    key = ["row", "doc_id"] if repeated else ["row"]
    spans = spans.groupBy(*key).agg(F.collect_list("spans").alias("spans"))
    apart = base.filter("doc_id IS NULL").mapInArrow(_squeezed, squeezed).withColumn("spans", F.lit(None).cast("array<binary>"))
    return texts.join(spans, key, "left").select("doc_id", "text", "spans").unionAll(apart.select("doc_id", "text", "spans"))


def _phrase_rows(buckets: list[int], columns: list[list], spans: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), *(pa.array(c, pa.binary()) for c in columns), pa.array(spans, pa.binary())],
        names=["bucket", "triggers", "docs", "rows", "starts", "sizes", "data", "spans"],
    )


def remove_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, kept (bytes that remain), n_bytes, n_removed, n_spans for each row of ``docs``.

    A byte goes if it lies in a string of ``length`` bytes of its document that also starts in a document with a
    smaller id, judged on the input.  ``n_spans`` counts maximal runs of removed bytes.  Texts are UTF-8; a null text
    is empty.  Rows with a null id keep all bytes and remove none elsewhere.  Rows that repeat an id are one
    document in this sense: they never remove each other's bytes.  No rows give no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_PACKED_STEP):
            out: list[list] = [[], [], [], []]
            for text, packed in zip(step.column(1).to_pylist(), step.column(2).to_pylist()):
                data = decompress(text)
                pairs = np.frombuffer(b"".join(packed or ()), "<i8").reshape(-1, 2)
                pairs = pairs[pairs[:, 1] <= len(data)]
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                upto = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
                new = np.append(True, pairs[1:, 0] > upto[:-1]) if len(pairs) else np.empty(0, bool)
                begin = pairs[new, 0]
                end = np.append(upto[:-1][new[1:]], upto[-1:]) if len(pairs) else begin
                kept, last = [], 0
                for a, b in zip(begin.tolist(), end.tolist()):
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                out[0].append(b"".join(kept))
                out[1].append(len(data))
                out[2].append(int((end - begin).sum()))
                out[3].append(len(begin))
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:])],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    spans = duplicate_spans(docs, **options).select("doc_id", "text", "spans")
    return spans.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
