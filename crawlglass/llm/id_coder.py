"""Token ids in compressed blocks: an adaptive context-mixing range coder.

A segment holds whole documents, in order, and is self-contained: a header, the documents' ids and lengths, and blocks
of ids.  Each block starts with empty statistics and carries its length and the crc32 of its ids, so it can be decoded
and checked on its own.

Inside a block three predictions are mixed for every id.  Order 2 names the id that last followed the two ids before,
order 1 the one that last followed the id before, each with a confidence of 0 to 3; order 0 gives every id its count so
far (refreshed at fixed places); what no order knows is spread evenly over the vocabulary.  The mixing weights are
counts of how often each prediction was right in the block, kept for each combination of confidences and for guesses
that agree or not; they too take effect at fixed places, as shares of a power of two.  A carry-less range coder with
64-bit numbers codes the prediction that is right and then, for order 0 and new ids, the id.

All blocks of a segment are coded side by side: one array operation handles one id of every block.  What does not
depend on the id before (hashes, shares and counts, when encoding) is done for many ids of every block at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from crawlglass.llm.rows import narrow, steps, texts_of
from crawlglass.llm.tokens import encoder
from crawlglass.storage import materialize

STEP_BYTES = 8_000_000  # of text encoded together
TOKENIZER, END_ID = "word_bpe_49k.json", 2
MAGIC = b"TIDS2\0"
BLOCK_IDS, LEAST_BLOCK, FEW_LANES, LANES = 4_096, 256, 1_024, 2_048
MOST_VOCABULARY = 1 << 20
_PLACE_BITS = BLOCK_IDS.bit_length() - 1  # with the bits of an id at most 32
_REFRESH = (16, 64, 256, 1_024, 2_048)  # powers of two: shares of order 0 need no division
_SLOT_BITS, _SHARE_BITS = 11, 12
_STEP_WEIGHT, _MOST_WEIGHT = 24, 4_096
_U, _U32 = np.uint64, np.uint32
_SPREAD, _SPREAD2, _SPREAD3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xBF58476D1CE4E5B9)
_1, _2, _32, _HASH = _U(1), _U(2), _U(32), _U(64 - _SLOT_BITS)
_SHARE, _LOW_MASK, _OVER = _U(_SHARE_BITS), _U((1 << 32) - 1), _U(1 << 32)
# An entry is an id and, in its two lowest bits, the confidence.  The confidence after an id, by entry ^ (id << 2).
_NEXT = np.array([1, 2, 3, 3, 1], np.int32)
# Three fields of 16 bits, to compare one number with three at once, and the highest bits of the fields.
_FIELDS, _HIGHEST = _U(0x0001_0001_0001), _U(0x8000_8000_8000)
# An id that is spread evenly or counted: 20 bits each for the id and the ids below it, 24 bits for how many it is.
_ID, _BELOW, _FIELD20, _FIELD24 = _U(44), _U(24), _U((1 << 20) - 1), _U((1 << 24) - 1)
_EVEN, _ENTRY, _NO_SURE = _U(1 << 44 | 1 << 24), _U(42), _U((1 << 22) - 4)
_GUESSED = _U((1 << 64) - (1 << 44))
FILES = "part int, segment int, data binary"
READ = "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long"
# Weights at first of order 2, order 1, order 0 and a new id, for confidences and for guesses that differ or agree.
_START = [(6 * sure2, 4 * sure1 * differ, 24, 16) for sure2 in range(4) for differ in (0, 1) for sure1 in range(4)]
_CONTEXTS = len(_START)


def _borders(n: int) -> list[int]:
    """The places where weights take effect; those of order 0 are among them."""
    return [0, *(p for p in (16, 32, *range(64, 512, 64), *range(512, n, 128)) if p < n), n]


class Mixer:
    """The statistics of all blocks: the same for the encoder and the decoder."""

    def __init__(self, blocks: int):
        self.base = (np.arange(2 * blocks, dtype=np.uint64) << _U(_SLOT_BITS)).reshape(2, blocks)  # order 1, order 2
        self.table = np.zeros(2 * blocks << _SLOT_BITS, np.int32)
        self.context0 = np.arange(blocks) * _CONTEXTS
        self.weights = np.tile(np.array(_START, np.float64).T, blocks)  # events x (contexts of all blocks); whole numbers
        self.rows = self.weights.shape[1]

    def slots(self, last: np.ndarray, older: np.ndarray) -> np.ndarray:
        """Places in the table (.., order, block) for the entries before (.., block)."""
        slots = np.empty((*last.shape[:-1], 2, last.shape[-1]), np.uint64)
        single, both = slots[..., 0, :], slots[..., 1, :]
        np.multiply(last, _SPREAD, out=single)
        np.multiply(older, _SPREAD2, out=both)
        both ^= single
        both *= _SPREAD3
        slots >>= _HASH
        slots += self.base
        return slots.view(np.int64)

    def contexts(self, found: np.ndarray) -> np.ndarray:
        """Columns of the weights (.., block) for entries found (.., order, block)."""
        sure = found & 3
        context = np.minimum(found[..., 0, :] ^ found[..., 1, :], 4)
        context &= 4  # the guesses differ
        context |= sure[..., 0, :]
        context |= sure[..., 1, :] << 3
        return context + self.context0

    def shares(self, order0: bool) -> tuple[np.ndarray, np.ndarray]:
        """As the weights: where the shares of the predictions begin, and the shares, in parts of 2**_SHARE_BITS."""
        weights = self.weights if order0 else self.weights * [[1], [1], [0], [1]]
        scale = ((1 << _SHARE_BITS) - 4) / weights.sum(axis=0)
        begins, shares = np.zeros(weights.shape, np.uint64), np.empty(weights.shape, np.uint64)
        for k in range(3):
            shares[k] = np.ceil(weights[k] * scale)  # none for no weight
            np.add(begins[k], shares[k], out=begins[k + 1])
        np.subtract(_U(1 << _SHARE_BITS), begins[3], out=shares[3])
        return begins, shares

    def learn(self, marks: np.ndarray) -> None:
        """Count the events (event * rows + column of the weights) of a stretch."""
        self.weights += _STEP_WEIGHT * np.bincount(marks.ravel(), minlength=4 * self.rows).reshape(4, self.rows)
        many = np.flatnonzero(self.weights.sum(axis=0) > _MOST_WEIGHT)
        self.weights[:, many] = np.ceil(self.weights[:, many] / 2)


def _bottom(vocabulary: int) -> np.uint64:
    """The least span: a share of it can be told, and in that each id of the vocabulary or counted by order 0."""
    return _U(1 << (_SHARE_BITS + max(vocabulary - 1, _REFRESH[-1] - 1).bit_length()))


def _settle(low: np.ndarray, span: np.ndarray, bottom: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``low`` and ``span`` after 32 bits are done with where the span has become too small, and where that is."""
    small = span < bottom
    # A span across the next multiple of 2**32 is cut there, so that the upper 32 bits are settled.
    within = np.minimum(span, _OVER - (low & _LOW_MASK)) << _32
    return np.where(small, low << _32, low), np.where(small, within, span), small


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id (blocks x ids), as (ids x blocks): how many ids before the last refresh are smaller, and equal."""
    blocks, n = ids.shape
    smaller, equal = np.zeros((n, blocks), np.uint16), np.zeros((n, blocks), np.uint16)
    places = [r for r in _REFRESH if r < n]
    for first in range(0, blocks, 64):
        some = ids[first : first + 64]
        row0 = np.arange(len(some))[:, None] * n
        pairs = np.sort(some << _U32(_PLACE_BITS) | np.arange(n, dtype=np.uint32), axis=1)  # of id and place
        sorted_ = pairs >> _U32(_PLACE_BITS)
        new = np.zeros(some.shape, np.int64)
        new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
        rank = np.empty(some.shape, np.int64)
        rank.ravel()[(pairs & _U32((1 << _PLACE_BITS) - 1)) + row0] = new.cumsum(axis=1) + row0
        for begin, end in zip(places, [*places[1:], n]):
            count = np.bincount(rank[:, :begin].ravel(), minlength=some.size).reshape(some.shape)
            before = count.cumsum(axis=1) - count
            at = rank[:, begin:end]
            equal[begin:end, first : first + 64] = count.ravel()[at].T
            smaller[begin:end, first : first + 64] = before.ravel()[at].T
    return smaller, equal


def _encode(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """The coded bytes of each row of ``ids`` (blocks x ids)."""
    blocks, n = ids.shape
    mixer, bottom, evenly = Mixer(blocks), _bottom(vocabulary), _U(vocabulary)
    low, span = np.zeros(blocks, np.uint64), np.full(blocks, (1 << 64) - 1, np.uint64)
    out, used = np.zeros(blocks * (n + 2), "<u4"), np.arange(blocks) * (n + 2)  # at most one word an id, and two
    smaller, equal = _counted(ids)
    table, order0 = mixer.table, 0
    previous = np.zeros((2, blocks), np.uint64)
    for begin, end in zip(borders := _borders(n), borders[1:]):
        order0 = begin if begin in _REFRESH else order0
        own = ids[:, begin:end].T.astype(np.uint64)
        by_step = np.concatenate([previous, own << _2])
        previous, entry = by_step[-2:], by_step[2:].astype(np.int32)
        slots = mixer.slots(by_step[1:-1], by_step[:-2])
        found = np.empty(slots.shape, np.int32)
        for slot, old, new in zip(slots, found, entry):
            np.take(table, slot, out=old, mode="clip")
            table[slot] = new + _NEXT.take(old ^ new, mode="clip")
        # The event of each id: named by order 2, by order 1, counted by order 0, new.
        off = found ^ entry[:, None]
        named = (off > 0) & (off < 4)
        event = np.where(equal[begin:end] > 0, 2, 3)
        event[named[:, 0]] = 1
        event[named[:, 1]] = 0
        mark = mixer.contexts(found) + event * mixer.rows
        begins, shares = mixer.shares(order0 > 0)
        before, share = begins.ravel()[mark], shares.ravel()[mark]
        mixer.learn(mark)
        is_new, counted = event == 3, event == 2
        start = np.where(is_new, own, np.where(counted, smaller[begin:end], _U(0)))
        part = np.where(counted, equal[begin:end], _1)
        halvings = np.where(counted, _U(max(order0, 1).bit_length() - 1), _U(0))
        for before_, share_, start_, part_, halvings_, new in zip(before, share, start, part, halvings, is_new):
            span >>= _SHARE
            before_ *= span
            low += before_
            span *= share_
            each = np.where(new, span // evenly, span >> halvings_)
            start_ *= each
            low += start_
            span = each * part_
            out[used] = low >> _32  # stays if it is settled
            low, span, small = _settle(low, span, bottom)
            used += small
    for _ in range(2):
        out[used] = low >> _32
        used += 1
        low <<= _32
    return [out[i * (n + 2) : end].tobytes() for i, end in enumerate(used)]


def _decode(coded: list[bytes], n: int, vocabulary: int) -> np.ndarray:
    """The ids (blocks x ``n``) of blocks coded by :func:`_encode`."""
    blocks = len(coded)
    mixer, bottom, evenly = Mixer(blocks), _bottom(vocabulary), _U(vocabulary)
    given = np.zeros((blocks, n + 2), np.uint32)
    for row, c in zip(given, coded):
        words = np.frombuffer(c, "<u4")[: n + 2]
        row[: len(words)] = words
    low, span = np.zeros(blocks, np.uint64), np.full(blocks, (1 << 64) - 1, np.uint64)
    code = given[:, 0] << _32 | given[:, 1]
    given, used = given.ravel(), np.arange(blocks) * (n + 2) + 2
    lane = np.arange(blocks)
    by_step = np.empty((n, blocks), np.int32)  # ids << 2
    last = older = np.zeros(blocks, np.uint64)
    table, found, order0 = mixer.table, np.empty((2, blocks), np.int32), 0
    counts, row0 = np.zeros(1, np.uint64), lane
    for begin, end in zip(borders := _borders(n), borders[1:]):
        if begin in _REFRESH:
            order0 = begin
            counts, row0 = _packed_counts(by_step[:begin].T), lane * begin
        halvings = np.array([0, 0, max(order0, 1).bit_length() - 1, 0], np.uint64)
        begins, shares = mixer.shares(order0 > 0)
        # Taken from a number with its highest bits set, a field keeps the bit where the number reaches that share.
        tests = _HIGHEST - (begins[1] | begins[2] << _U(16) | begins[3] << _32)
        parts = (begins << _32 | shares).ravel()
        marks = np.empty((end - begin, blocks), np.int64)
        for entry, mark in zip(by_step[begin:], marks):
            slot = mixer.slots(last, older)
            np.take(table, slot, out=found, mode="clip")
            context = mixer.contexts(found)
            span >>= _SHARE
            ahead = code - low
            share = ahead // span
            share *= _FIELDS
            share += tests.take(context)
            share &= _HIGHEST
            event = np.bitwise_count(share).astype(np.int64)
            np.multiply(event, mixer.rows, out=mark)
            mark += context
            share = parts.take(mark)
            before = share >> _32
            before *= span
            low += before
            ahead -= before
            share &= _LOW_MASK
            span *= share
            # Order 0 and new ids: which one.  A named id is the only one, in the whole span.
            is_new = event == 3
            each = np.where(is_new, span // evenly, span >> halvings.take(event))
            ahead //= each
            which = np.where(is_new, ahead * _EVEN + _1, counts.take(ahead.view(np.int64) + row0, mode="clip"))
            guess = np.where(event == 1, found[0], found[1]).astype(np.uint64)
            guess <<= _ENTRY
            which = np.where(event < 2, guess & _GUESSED | _1, which)
            low += each * ((which >> _BELOW) & _FIELD20)
            np.multiply(each, which & _FIELD24, out=span)
            which >>= _ENTRY
            which &= _NO_SURE
            last, older = which, last
            entry[:] = which
            table[slot] = entry + _NEXT.take(found ^ entry, mode="clip")
            low, span, small = _settle(low, span, bottom)
            code = np.where(small, code << _32 | given.take(used, mode="clip"), code)
            used += small
        mixer.learn(marks)
    return np.ascontiguousarray(by_step.T).view(np.uint32) >> 2


def _packed_counts(ids: np.ndarray) -> np.ndarray:
    """The sorted entries of each row as packed ids, with the numbers of smaller and of equal ones in their row."""
    seen = np.sort(ids >> 2, axis=1)
    new = np.ones(seen.shape, bool)
    new[:, 1:] = seen[:, 1:] != seen[:, :-1]
    firsts = np.flatnonzero(new)
    sizes = np.diff(firsts, append=seen.size)
    packed = seen.ravel()[firsts].astype(np.uint64) << _ID
    packed |= (firsts % ids.shape[1]).astype(np.uint64) << _BELOW
    packed |= sizes.astype(np.uint64)
    return np.repeat(packed, sizes)


def write_segment(doc_ids: list[int | None], docs: list[np.ndarray], vocabulary: int) -> bytes:
    """Bytes of a segment with the given documents' ids, in this order."""
    if vocabulary > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of {vocabulary} ids; at most {MOST_VOCABULARY} can be coded")
    sizes = np.array([len(d) for d in docs], "<i8")
    ids = np.concatenate([np.empty(0, np.uint32), *docs]).astype(np.uint32)
    n = int(np.clip(-(-len(ids) // FEW_LANES), LEAST_BLOCK, BLOCK_IDS))  # long blocks learn more
    blocks = -(-len(ids) // n)
    padded = np.zeros(blocks * n, np.uint32)
    padded[: len(ids)] = ids
    padded = padded.reshape(blocks, n)
    if blocks == 1:
        padded = padded[:, : len(ids)]
    coded: list[bytes] = []
    for i in range(0, blocks, LANES):
        coded += _encode(padded[i : i + LANES], vocabulary)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [MAGIC, struct.pack("<IIIQ", vocabulary, n, len(docs), len(ids)), known.tobytes(), names.tobytes(), sizes.tobytes()]
    parts.append(struct.pack("<I", crc32(b"".join(parts))))
    for row, c in zip(padded, coded):
        parts += [struct.pack("<II", len(c), crc32(row.astype("<u4").tobytes())), c]
    return b"".join(parts)


def read_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents' names and ids of a segment; ValueError where a checksum or the magic number is wrong."""
    if not data.startswith(MAGIC):
        raise ValueError("not a segment of token ids")
    at = len(MAGIC)
    vocabulary, n, docs, total = struct.unpack_from("<IIIQ", data, at)
    at += 20
    known = np.frombuffer(data, np.uint8, docs, at)
    names = np.frombuffer(data, "<i8", docs, at + docs)
    sizes = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    if crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the header of a segment is damaged")
    at += 4
    blocks, coded, sums = -(-total // n), [], []
    for _ in range(blocks):
        size, check = struct.unpack_from("<II", data, at)
        coded.append(data[at + 8 : at + 8 + size])
        sums.append(check)
        at += 8 + size
    width = total if blocks == 1 else n
    rows = [_decode(coded[i : i + LANES], width, vocabulary) for i in range(0, blocks, LANES)]
    for row, check in zip((r for part in rows for r in part), sums):
        if crc32(row.astype("<u4").tobytes()) != check:
            raise ValueError("a block of token ids is damaged")
    ids = np.concatenate([np.empty(0, np.uint32), *(r.ravel() for r in rows)])[:total]
    return [int(d) if k else None for d, k in zip(names, known)], np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


def write_ids(
    docs: DataFrame, tokenizer: str | None = None, *, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Segments (part, segment, data) of all documents in ascending order of their id, written to the shared folder.

    ``end_id`` follows each document's ids.  A segment has about ``LANES`` * ``BLOCK_IDS`` ids, or one longer
    document.  Spark's own Parquet files carry the segments, so commits and lost tasks are handled by Spark.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        part, number = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            data = write_segment(names, held, tool.vocabulary)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())],
                names=["part", "segment", "data"],
            )

        for step in steps(batches, limit=STEP_BYTES):
            for name, own in zip(step.column(0).to_pylist(), tool.encode_all(texts_of(step))):
                ids = np.append(own.astype(np.uint32), np.uint32(end_id))
                if held and size + len(ids) > LANES * BLOCK_IDS:
                    yield segment()
                    names, held, size, number = [], [], 0, number + 1
                names.append(name)
                held.append(ids)
                size += len(ids)
        if held:
            yield segment()

    rows = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(code, FILES), "token-ids")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of ``files``, from the decoded segments.

    ``start`` is the number of ids of all documents before it.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(c) for c in ("part", "segment", "data"))):
                names, docs = read_segment(data.as_py())
                sizes = np.array([len(d) for d in docs], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(docs), pa.int32()), pa.array([segment.as_py()] * len(docs), pa.int32()),
                     pa.array(names, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
                     pa.array([crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64())],
                    names=["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(decode, READ)


def token_ids(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each row of ``docs``: encoded, written, read back and decoded.

    A null text is empty and has its end id only.  Rows with a null id come first; rows that repeat an id follow each
    other in the order of their texts.  Texts of any length are encoded whole.  No rows give no rows.
    """
    read = materialize(read_ids(write_ids(docs, tokenizer, **options)), "token-ids-read")
    # One row a segment: their number is the number of ids / 4 million.
    sizes = read.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    first = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    second = sizes.select("part", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("second"))
    return read.join(second.join(first, "part"), ["part", "segment"]).select(
        "doc_id", (F.col("first") + F.col("second") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
