"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, bands, star-shaped candidates.

One hash function deals the shingles of a document to ``bands * rows`` bins and the smallest value of each bin is
kept.  An empty bin borrows the value of a bin found by a random sequence of its own (optimal densification), so that
also short documents get independent bins.  ``rows`` bins make a band; documents with an equal band share a bucket.

Documents with equal shingle sets are collapsed first.  In a bucket, each document is paired with the smallest one
only (a star), so a bucket of n documents gives n - 1 pairs.  Pairs are confirmed on full shingle sets.  Where the
documents of a bucket then lie in several components, documents of different components are compared as well, so no
link between documents that share a bucket is lost.  These comparisons do not leave the join: a bitmap in which each
shingle flips one bit bounds the number of shingles that two sets do not share from below, and only pairs that can
still reach the similarity go on to their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlglass.llm.graph import components
from crawlglass.llm.rows import narrow, packed, steps, texts_of
from crawlglass.llm.words import mix64, shingle_sets
from crawlglass.storage import materialize

WORDS, PERCENT, BANDS, ROWS = 5, 80, 40, 5
SKETCH_BITS = 2_048
_STEP = 2_000_000
_PROBES = 256


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """For each attempt, the bin that each empty bin tries."""
    at = np.arange(_PROBES * bins, dtype=np.uint64).reshape(_PROBES, bins)
    return (mix64(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified one-permutation signatures; ``sets`` hold at least one value each."""
    own = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, values in enumerate(sets):
        bin_of = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        place, first = np.unique(bin_of, return_index=True)  # values are sorted, so the first of a bin is its smallest
        own[i, place.astype(np.int64)], full[i, place.astype(np.int64)] = values[first], True
    out, empty = own.copy(), ~full
    for tried in _probes(bins):
        doc, place = np.nonzero(empty)
        if not len(doc):
            return out
        hit = full[doc, tried[place]]
        out[doc[hit], place[hit]] = own[doc[hit], tried[place[hit]]]
        empty[doc[hit], place[hit]] = False
    for doc, place in zip(*np.nonzero(empty)):  # rarely: the next full bin to the right
        turned = np.roll(full[doc], -place)
        out[doc, place] = own[doc, (place + int(np.argmax(turned))) % bins]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the number of the band is part of it."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands))
    cut = signature.reshape(len(signature), bands, rows)
    for j in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
    return keys.view(np.int64)


def parities(values: np.ndarray) -> np.ndarray:
    """A bitmap of ``SKETCH_BITS`` bits, as longs, in which each value flips one bit.

    Two bitmaps differ in at most as many bits as their sets differ in values.
    """
    flips = np.bincount((values % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's hash, band keys (none for an empty set), bitmap."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_STEP):
            sets = shingle_sets(texts_of(step), words)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            keys = np.empty((0, bands), np.int64)
            if len(some):
                keys = band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows)
            ends = np.cumsum(np.where(sizes > 0, bands, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.ravel()))
            bits = np.concatenate([parities(x) for x in sets])
            width = SKETCH_BITS // 64
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * width, pa.int32()), pa.array(bits))
            half = [np.array([np.add.reduce(f(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                    for f in (mix64, lambda s: mix64(s ^ np.uint64(0xA0761D6478BD642F)))]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(sizes, pa.int64()), pa.array(half[0]), pa.array(half[1]), lists, bits],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "bits"],
            )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, bits array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps([batch], text="text_b", limit=_STEP // 2):
                first, second = texts_of(step, "text_a"), texts_of(step, "text_b")
                known = list(dict.fromkeys(first))
                hubs = {t: shingle_sets([t], words)[0] for t in known}
                keep = []
                for one, other in zip((hubs[t] for t in first), shingle_sets(second, words)):
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(one) + len(other) - both))
                yield step.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words, A-Z lower-cased; with fewer words, the whole
    sequence; without words, or with a null text, nothing.  Documents whose sets have a Jaccard similarity of at
    least ``percent`` / 100 are linked; ``component_id`` is the smallest id reachable.  Empty sets are linked with
    nothing.  A pair at 0.8 misses all 40 bands of 5 with a chance of about 1e-7.

    Rows with a null id are not linked: their component is null and they are kept.  Rows that repeat an id are one
    document of that id (their links count for the id, and they share its component).  No rows give no rows.
    """
    base = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialize(_signed(base, words, bands, rows), "minhash")
    linked = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    classes = linked.groupBy(*same).agg(F.min(F.struct("doc_id", "keys", "bits")).alias("least"))
    reps = classes.select(F.col("least.doc_id").alias("rep"), "n_shingles", F.explode("least.keys").alias("key"))
    crowded = reps.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    bucket = materialize(reps.join(crowded, "key"), "minhash-buckets")
    copies = linked.select("doc_id", *same).join(classes.select(*same, F.col("least.doc_id").alias("a")), same).select(
        "a", F.col("doc_id").alias("b")
    ).filter("a <> b")
    member = bucket.select("rep").distinct()
    texts = materialize(base.join(member.withColumnRenamed("rep", "doc_id"), "doc_id"), "minhash-texts")
    sizes_fit = f"least(size_a, size_b) * 100 >= greatest(size_a, size_b) * {percent}"

    # Stars: each document of a bucket with the smallest one.
    hub = bucket.groupBy("key").agg(F.min(F.struct("rep", "n_shingles")).alias("h"))
    stars = bucket.join(hub, "key").select(
        F.col("h.rep").alias("a"), F.col("rep").alias("b"), F.col("h.n_shingles").alias("size_a"), F.col("n_shingles").alias("size_b")
    ).filter("a <> b").filter(sizes_fit).select("a", "b").distinct()
    found = materialize(copies.unionAll(_confirmed(stars, texts, words, percent)), "minhash-links")
    component = materialize(components(found), "minhash-components")

    # Documents of one bucket that are still in different components.
    now = bucket.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    mixed = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    bits = linked.select(F.col("doc_id").alias("rep"), "bits", "n_shingles")
    bits = bits.join(now.join(mixed, "key", "left_semi").select("rep").distinct(), "rep", "left_semi")
    open_rows = materialize(now.join(mixed.select("key"), "key").join(bits, ["rep", "n_shingles"]), "minhash-open")
    left = open_rows.toDF(*(c if c == "key" else f"{c}_a" for c in open_rows.columns))
    right = open_rows.toDF(*(c if c == "key" else f"{c}_b" for c in open_rows.columns))
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # Similar sets differ in at most this share of all their shingles.
    able = apart * (100 + percent) <= (F.col("n_shingles_a") + F.col("n_shingles_b")) * (100 - percent)
    across = left.join(right, "key").filter((F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")))
    across = across.filter(sizes_fit.replace("size_", "n_shingles_")).filter(able)
    across = across.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    more = materialize(_confirmed(across, texts, words, percent), "minhash-more-links")
    if more.limit(1).count():
        component = materialize(components(found.unionAll(more)), "minhash-components")
    out = signed.select("doc_id", "n_shingles").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with their own columns.

    Of rows that repeat a kept id, all stay; rows with a null id stay.
    """
    gone = near_duplicates(docs, **options).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = packed(docs).join(gone, F.col("row").getField("doc_id").cast("long") == F.col("gone"), "left_anti")
    return rows.select("row.*")
