"""Which hashed keys occur with several owners, answered to those who asked.

Tasks hold many keys of few bytes each, so questions travel as packed arrays: one row for each step of a task and each
bucket of keys.  A key that a step already sees with two owners is known to be shared there and then; the step sends it
once, without waiting for an answer.  So a key that is in a third of all rows still sends one record a step.

Keys are numbers of 48 bits.  Two different things that meet in one key are only taken to be shared; whoever asks
compares the things themselves later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# ``known``: how many of a row's keys, at its end, its step has seen with several owners; -1 for a row of answers that
# a step gave itself.  ``ids`` and ``runs``: who asked, and for how many keys in a row.  Without ``owners`` ids own.
ASKED = "bucket int, known int, keys binary, owners binary, ids binary, runs binary"
_SPREAD = 64  # rows of answers are dealt to so many further buckets


def bucket_count(docs: DataFrame, text: str, bytes_each: int) -> int:
    """Buckets in proportion to the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(16, -(-total // bytes_each)))


def key48(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(16)


def pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view("<u2").reshape(-1, 4)[:, :3].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(data, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    first = np.flatnonzero(np.diff(ids, prepend=~ids[:1])) if len(ids) else np.empty(0, np.int64)
    return ids[first].astype("<i8").tobytes(), np.diff(np.append(first, len(ids))).astype("<u4").tobytes()


def ask(keys: np.ndarray, ids: np.ndarray, buckets: int, owners: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of ``ASKED`` for one step; each (key, owner) comes once, and ``ids`` tells who gets the answer."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    owners = None if owners is None else owners[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    count = np.diff(np.append(first, len(keys)))
    shared = np.repeat(count > 1, count)
    rows: list[tuple] = []
    if shared.any():
        by_id = np.flatnonzero(shared)[np.argsort(ids[shared], kind="stable")]
        rows.append((buckets + int(keys[by_id[0]] % np.uint64(_SPREAD)), -1, pack48(keys[by_id]), None, *_runs(ids[by_id])))
    keys, ids, many = keys[first], ids[first], count > 1
    owners = None if owners is None else owners[first]
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((ids, many, bucket))
    for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        alone = some[~many[some]]
        rows.append((
            int(bucket[some[0]]), int(many[some].sum()), pack48(keys[some]),
            None if owners is None else owners[alone].astype("<u8").tobytes(), *_runs(ids[alone]),
        ))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=[part.split(" ")[0] for part in ASKED.split(", ")]
    )


def _per_id(keys: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    order = np.argsort(ids, kind="stable")
    keys, ids = keys[order], ids[order]
    cuts = np.flatnonzero(np.diff(ids, prepend=~ids[:1])) if len(ids) else np.empty(0, np.int64)
    blobs = [pack48(keys[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(ids)))]
    return pd.DataFrame({"id": ids[cuts], "keys": pd.Series(blobs, dtype=object)})


def _answer(batch: pd.DataFrame) -> pd.DataFrame:
    """The shared keys of all who asked in one bucket."""
    keys, owners, ids, many = [], [], [], []
    for row in batch.itertuples():
        own = unpack48(row.keys)
        asked = np.repeat(np.frombuffer(row.ids, "<i8"), np.frombuffer(row.runs, "<u4"))
        if row.known < 0:
            keys.append(own), ids.append(asked), owners.append(np.zeros(len(own), np.uint64)), many.append(np.full(len(own), 2))
            continue
        alone = np.frombuffer(row.owners, "<u8") if row.owners is not None else asked.astype(np.uint64)
        pad = np.zeros(row.known)
        keys.append(own), ids.append(np.append(asked, pad.astype(np.int64)))
        owners.append(np.append(alone, pad.astype(np.uint64)))
        many.append(np.append(np.zeros(len(asked), np.int64), np.ones(row.known, np.int64)))
    keys, owners, ids, many = (np.concatenate(x) for x in (keys, owners, ids, many))
    told = many == 2
    given = _per_id(keys[told], ids[told])
    keys, owners, ids, many = keys[~told], owners[~told], ids[~told], many[~told]
    if not len(keys):
        return given
    order = np.lexsort((owners, many, keys))
    keys, owners, ids, many = keys[order], owners[order], ids[order], many[order]
    new = np.diff(keys, prepend=~keys[:1]) != 0
    group = np.cumsum(new) - 1
    differs = ~new & ((many > 0) | (np.diff(owners, prepend=owners[:1]) != 0))
    shared = np.bincount(group, weights=differs, minlength=group[-1] + 1) > 0
    wanted = shared[group] & (many == 0)
    return pd.concat([given, _per_id(keys[wanted], ids[wanted])], ignore_index=True)


def answers(asked: DataFrame) -> DataFrame:
    """id, keys (list of packed arrays): the keys each asker shares with another owner."""
    told = asked.groupBy("bucket").applyInPandas(_answer, "id long, keys binary")
    return told.groupBy("id").agg(F.collect_list("keys").alias("keys"))
