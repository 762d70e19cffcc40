"""Collocations: word sequences that occur together more often than their parts would by chance.

Texts are cut into blocks of one language.  In a block the hash of every n-gram is read off prefix polynomials of the
word hashes (Rabin-Karp), so an n-gram costs a few array operations and is never made into text.  A block sends each
different fingerprint once, with its count; the block's number is the pointer to its occurrences.  Buckets of
fingerprints add the counts up and tell the blocks which of their fingerprints are frequent.  Only there, n-grams
become text: occurrences with one fingerprint are compared word by word, and the phrases are counted anew as strings.
So two sequences that share a fingerprint cannot mix; at worst a rare one is counted in vain.

Definitions: A-Z are lower-cased; ``[.,;:!?]`` and U+000A to U+000D end a piece; words are runs of anything but space
and tab; an n-gram lies within a piece.  Occurrences may overlap.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import compress, decompress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from crawlglass.llm.rows import name, steps, texts_of
from crawlglass.llm.sharing import key48, pack48, unpack48
from crawlglass.llm.shipping import ship
from crawlglass.llm.words import mix64, word_places
from crawlglass.operators.skew import hot_keys, join_unique
from crawlglass.storage import materialize

LONGEST, LEAST, INSIDE_PERCENT, TOP = 5, 100, 100, 2_000
UNKNOWN = "und"
# Bytes of text of a block; a block's arrays take some 40 times as much.
BLOCK_BYTES = 4_000_000
# Bytes of text for each bucket of fingerprints; every word starts at most LONGEST of them.
BUCKET_BYTES = 3_000_000
# Phrases with more look-ups than this are spread over several tasks.
HOT_LOOKUPS = 20_000

_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_GAP = np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
_APART = _BREAK | _GAP
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_ORDER = 0xD6E8FEB86659FD93


def _reach(data: np.ndarray, at: int, more: int) -> int:
    """Where the ``more``-th word after ``at`` ends, or the piece, if that is sooner."""
    size = 1_024
    while True:
        window = data[at : at + size]
        stops = np.flatnonzero(_BREAK[window])
        if len(stops):
            window = window[: stops[0]]
        word = ~_APART[window]
        ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        if len(ends) >= more:
            return at + int(ends[more - 1])
        if len(stops) or at + size >= len(data):
            return at + len(window)
        size *= 8


def _cuts(text: bytes, limit: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """``text`` in stretches of about ``limit`` bytes, each with the number of its bytes in which n-grams may start.

    Stretches end where a piece ends.  A piece beyond ``limit`` is cut between words; the stretch then goes on for as
    many words as an n-gram that starts in it can reach.
    """
    data, at = np.frombuffer(text, np.uint8), 0
    while len(data) - at > limit:
        window = data[at : at + limit]
        ends = np.flatnonzero(_BREAK[window])
        if len(ends):
            own = int(ends[-1]) + 1
            yield text[at : at + own], own
            at += own
            continue
        gaps = np.flatnonzero(_GAP[window])
        own = int(gaps[-1]) + 1 if len(gaps) else limit
        while not len(gaps) and at + own < len(data) and not _APART[data[at + own - 1]]:  # a word is not cut
            gap = np.flatnonzero(_APART[data[at + own : at + own + limit]])
            own = own + int(gap[0]) + 1 if len(gap) else min(len(data) - at, own + limit)
        yield text[at : _reach(data, at + own, longest - 1)], own
        at += own
    if at < len(data):
        yield text[at:], len(data) - at


def _blocks(docs: DataFrame, longest: int) -> DataFrame:
    """``(block, lang, text, own)``: lower-cased texts of one language, deflated; ends of documents are ends of pieces."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 33

        def row(lang: str, text: bytes, own: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), pa.array([lang]), pa.array([compress(text, 1)], pa.binary()), pa.array([own], pa.int64())],
                names=["block", "lang", "text", "own"],
            )

        def close(lang: str) -> pa.RecordBatch:
            text = b"\n".join(open_.pop(lang))
            size.pop(lang)
            return row(lang, text, len(text))

        for step in steps(batches, limit=BLOCK_BYTES):
            for lang, text in zip(step.column(0).to_pylist(), texts_of(step)):
                text = text.encode("utf-8").translate(_LOWER)
                if len(text) > BLOCK_BYTES:
                    for part, own in _cuts(text, BLOCK_BYTES, longest):
                        yield row(lang, part, own)
                    continue
                if size.get(lang, 0) + len(text) > BLOCK_BYTES:
                    yield close(lang)
                open_.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if sum(size.values()) > 4 * BLOCK_BYTES:
                    yield close(max(size, key=size.__getitem__))
        for lang in list(open_):
            yield close(lang)

    return docs.mapInArrow(gather, "block long, lang string, text binary, own long")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    made = []
    for base in (_BASE, inverse):
        values = np.full(n, base, np.uint64)
        values[:1] = 1
        made.append(np.cumprod(values, dtype=np.uint64))
    return made[0], made[1]


class Block:
    """The words of a block, and the fingerprints of its n-grams."""

    def __init__(self, text: bytes, own: int, lang: str, longest: int):
        self.text = text
        self.hashes, self.starts, _ = word_places([text], space=_APART)
        data = np.frombuffer(text, np.uint8)
        inside = np.append(~_APART[data], False)
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[self.starts] if len(data) else np.empty(0, np.int32)
        self.first = int(np.searchsorted(self.starts, own))  # words from here on only end n-grams
        self.longest = longest
        self.seed = int.from_bytes(hashlib.blake2b(lang.encode("utf-8"), digest_size=8).digest(), "little")
        power, self._inverse = _powers(1 << max(1, len(self.hashes)).bit_length())
        self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * power[: len(self.hashes)], dtype=np.uint64)])

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-grams of ``n`` words, and their fingerprints."""
        count = max(0, min(self.first, len(self.hashes) - n + 1))
        at = np.arange(count)
        if n > 1:
            at = np.flatnonzero(self.piece[:count] == self.piece[n - 1 : n - 1 + count])
        salt = np.uint64((self.seed + n * _ORDER) % (1 << 64))
        return at, mix64((self._prefix[at + n] - self._prefix[at]) * self._inverse[at] ^ salt)

    def exact_words(self) -> np.ndarray:
        """A number for each word, equal where the words are, compared byte by byte."""
        order = np.argsort(self.hashes, kind="stable")
        start, size = self.starts[order], (self.ends - self.starts)[order]
        new = np.diff(self.hashes[order], prepend=~self.hashes[order[:1]]) != 0
        data = np.frombuffer(self.text, np.uint8)
        same = np.flatnonzero(~new)
        differs = size[same] != size[same - 1]
        for some in np.array_split(same[~differs], max(1, len(same) // 200_000)):
            if not len(some):
                continue
            sizes = size[some]
            first = np.cumsum(sizes) - sizes
            step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            unequal = data[np.repeat(start[some], sizes) + step] != data[np.repeat(start[some - 1], sizes) + step]
            if unequal.any():
                differs = None
                break
        ids = np.empty(len(order), np.int64)
        if differs is None or differs.any():  # different words with one hash: by the words themselves
            known: dict[bytes, int] = {}
            ids[:] = [known.setdefault(self.text[a:b], len(known)) for a, b in zip(self.starts, self.ends)]
        else:
            ids[order] = np.cumsum(new)
        return ids

    def phrase(self, at: int, n: int) -> str:
        text = self.text[self.starts[at] : self.ends[at + n - 1]].decode("utf-8", "replace")
        return " ".join(w for w in text.replace("\t", " ").split(" ") if w)

    def counted(self, frequent: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """(phrase, key, count) of the n-grams whose keys are in the sorted ``frequent``."""
        if not len(frequent):
            return
        ids = self.exact_words()
        likely = np.zeros(1 << 22, bool)
        likely[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for n in range(1, self.longest + 1):
            at, keys = self.fingerprints(n)
            keys = key48(keys)
            some = np.flatnonzero(likely[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(frequent, keys[some]), len(frequent) - 1)
            some = some[frequent[place] == keys[some]]
            at, keys = at[some], keys[some]
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.empty(0, np.int64)
            count = np.diff(np.append(new, len(keys)))
            head = np.repeat(at[new], count)
            alike = np.ones(len(at), bool)
            for j in range(n):
                alike &= ids[at + j] == ids[head + j]
            whole = np.add.reduceat(~alike, new) == 0 if len(new) else np.empty(0, bool)
            for i, key, c in zip(at[new[whole]].tolist(), keys[new[whole]].tolist(), count[whole].tolist()):
                yield self.phrase(i, n), key, c
            for first, size in zip(new[~whole], count[~whole]):  # one key, different words
                told = Counter(self.phrase(i, n) for i in at[first : first + size].tolist())
                yield from ((text, int(keys[first]), c) for text, c in told.items())


def _asked(blocks: DataFrame, longest: int, least: int, buckets: int) -> DataFrame:
    """For each block and bucket: its different keys, and their counts up to ``least``, which is all that matters."""
    kind = np.min_scalar_type(least)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(decompress(row["text"]), row["own"], row["lang"], longest)
                keys = np.concatenate([key48(block.fingerprints(n)[1]) for n in range(1, longest + 1)])
                keys.sort()
                first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.empty(0, np.int64)
                count = np.minimum(np.diff(np.append(first, len(keys))), least).astype(kind)
                keys = keys[first]
                bucket = (keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)
                cuts = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1])) if len(keys) else np.empty(0, np.int64)
                ends = np.append(cuts[1:], len(keys))
                for some in range(0, len(cuts), 256):
                    spans = list(zip(cuts[some : some + 256], ends[some : some + 256]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), pa.array([row["block"]] * len(spans), pa.int64()),
                         pa.array([_planes(keys[a:b]) for a, b in spans], pa.binary()),
                         pa.array([count[a:b].tobytes() for a, b in spans], pa.binary())],
                        names=["bucket", "block", "keys", "counts"],
                    )

    return blocks.mapInArrow(ask, "bucket long, block long, keys binary, counts binary")


def _planes(keys: np.ndarray) -> bytes:
    """48-bit keys byte by byte, highest bytes first: of sorted keys these hardly change, so they compress well."""
    return np.frombuffer(pack48(keys), np.uint8).reshape(-1, 6).T[::-1].tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return unpack48(np.frombuffer(data, np.uint8).reshape(6, -1)[::-1].T.tobytes())


def _told(asked: DataFrame, least: int) -> DataFrame:
    """``(block, keys)``: the frequent keys of each block, in one row a bucket."""
    kind = np.min_scalar_type(least)

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_from_planes(k) for k in rows["keys"]]
        keys = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        count = np.frombuffer(b"".join(rows["counts"]), kind).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        enough = np.add.reduceat(count[order], first) >= least
        wanted = np.repeat(enough, np.diff(np.append(first, len(keys))))
        keys, owner = keys[wanted], owner[wanted]
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(cuts[1:], len(keys))
        return pd.DataFrame({
            "block": rows["block"].to_numpy()[owner[cuts]],
            "keys": pd.Series([_planes(keys[a:b]) for a, b in zip(cuts, ends)], dtype=object),
        })

    return asked.groupBy("bucket").applyInPandas(tell, "block long, keys binary")


def _phrases(blocks: DataFrame, told: DataFrame, longest: int, least: int, buckets: int) -> DataFrame:
    """``(lang, phrase, n_words, f)`` with ``f >= least``; ``phrase`` null: words of a block.

    Each block sends the phrases of a bucket, and their counts, as one row; a phrase has one bucket, as it has one key.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(decompress(row["text"]), row["own"], row["lang"], longest)
                parts = [_from_planes(k) for k in row["keys"] or ()]
                frequent = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                by_bucket: dict[int, tuple[list[str], list[int]]] = {}
                for phrase, key, times in block.counted(frequent):
                    texts, counts = by_bucket.setdefault((key >> 16) * buckets >> 32, ([], []))
                    texts.append(phrase)
                    counts.append(times)
                made = [(bucket, "\n".join(texts), np.array(counts, "<i8").tobytes(), 0) for bucket, (texts, counts) in by_bucket.items()]
                made.append((row["block"] % buckets, None, None, block.first))
                for at in range(0, len(made), 256):
                    bucket, texts, counts, words = zip(*made[at : at + 256])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket, pa.int64()), pa.array([row["lang"]] * len(bucket), pa.string()), pa.array(texts, pa.string()),
                         pa.array(counts, pa.binary()), pa.array(words, pa.int64())],
                        names=["bucket", "lang", "phrases", "counts", "words"],
                    )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple, int] = {}
        for lang, texts, counts, words in zip(rows["lang"], rows["phrases"], rows["counts"], rows["words"]):
            if texts is None:
                found[lang, None] = found.get((lang, None), 0) + int(words)
                continue
            for text, times in zip(texts.split("\n"), np.frombuffer(counts, "<i8").tolist()):
                found[lang, text] = found.get((lang, text), 0) + times
        kept = [(lang, p, 0 if p is None else p.count(" ") + 1, f) for (lang, p), f in found.items() if p is None or f >= least]
        return pd.DataFrame(kept, columns=["lang", "phrase", "n_words", "f"])

    known = told.groupBy("block").agg(F.collect_list("keys").alias("keys"))
    counted = blocks.join(known, "block", "left").mapInArrow(count, "bucket long, lang string, phrases string, counts binary, words long")
    return counted.groupBy("bucket").applyInPandas(add, "lang string, phrase string, n_words int, f long")


def frequent_phrases(
    docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n_words, f)`` of all phrases with ``f >= least``, and ``(lang, n)``, the number of words."""
    ship(docs.sparkSession)
    own = docs.select(F.coalesce(name(lang), F.lit(UNKNOWN)).alias("lang"), name(text).alias("text"))
    blocks = materialize(_blocks(own, longest), "phrase-blocks")
    size = blocks.agg(F.sum("own")).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    told = _told(_asked(blocks, longest, least, buckets), least)
    counted = materialize(_phrases(blocks, told, longest, least, buckets), "phrases")
    totals = counted.filter("phrase IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    return counted.filter("phrase IS NOT NULL"), totals


def collocations(
    docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Candidates are phrases of 2 to ``longest`` words with ``a = f(phrase) >= least``.  Cut after its first k words, a
    candidate scores ``floor(1000 * a * n / (l * r))`` with l and r the counts of the two parts and n the number of
    words of the language; its lowest cut counts, ties to the smallest k.  Candidates that lie inside a longer one
    with ``100 * f(longer) >= inside_percent * a`` are dropped.  Order: score and a descending, phrase ascending by
    its UTF-8 bytes.  All numbers are exact.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they occur; other
    columns are not read.  Without rows, or candidates, there are no rows.
    """
    phrases, totals = frequent_phrases(docs, longest=longest, least=least, text=text, lang=lang)
    candidates = phrases.filter("n_words > 1").withColumn("words", F.split("phrase", " "))
    # Parts of a frequent phrase are frequent too, so all of them are among the phrases.
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"), "words"
    )
    side = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    parts = materialize(cuts.select(
        "lang", "phrase", "a", "k", F.explode(F.array(
            F.struct(F.lit("l").alias("side"), side(F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit("r").alias("side"), side(F.col("k") + 1, F.size("words") - F.col("k")).alias("part")),
        )).alias("p")
    ).select("lang", "phrase", "a", "k", "p.side", "p.part"), "phrase-parts")
    asked = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("_asked"))
    known = phrases.select("lang", F.col("phrase").alias("part"), "f")
    found = join_unique(parts, known, ["lang", "part"], spread="phrase", hot=hot_keys(asked, ["lang", "part"], "_asked", HOT_LOOKUPS))
    cut = found.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r")
    )
    score = F.expr("CAST(a AS DECIMAL(18,0)) * CAST(1000 AS DECIMAL(4,0)) * CAST(n AS DECIMAL(16,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    sizes = candidates.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    scored = join_unique(cut, totals, ["lang"], spread="phrase", hot=hot_keys(sizes, ["lang"], "_n", HOT_LOOKUPS)).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select(
        "lang", "phrase", "a", "n", "c.score", "c.l", "c.r"
    )
    inner = candidates.filter("n_words > 2").select(
        "lang", "f", "words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size")
    ).select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    longer = inner.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent)
    )
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
