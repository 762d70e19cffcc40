"""Line deduplication by a deletion-neighbourhood join.

The edit bound is one unit inserted, deleted or replaced, at most an eighth of a line.  Lines of eight words or more are
sequences of words.  Lines of eight words or fewer, and so those of scripts without spaces, are sequences of characters
(words joined by one space) and need eight of them; in shorter ones one edit is more than an eighth, so only equal lines
are duplicates there.  Lines of exactly eight words are compared both ways.  Two lines are within the bound exactly if
their deletion neighbourhoods meet: the same line is left when the unit at one place is deleted from both (replacement),
or when one unit is deleted from the longer one (insertion).

1.  Pigeonhole: lines within the bound share their first or their last half.  Each line asks (:mod:`sharing`) which of
    its halves another line has; only lines with a shared half go on.
2.  Those lines emit their variants as hashed keys, in packed arrays by bucket.  Equal keys with one place of deletion,
    and a key equal to a whole line, are matches; each line keeps its earliest match, so a frequent key gives one
    candidate a line and not all pairs.
3.  The units of the matches are compared, and the verified ones decide.

Equal lines are found by one aggregate on a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlglass.llm.rows import narrow, packed, steps, texts_of, with_row_key
from crawlglass.llm.sharing import ASKED, answers, ask, bucket_count, key48, unpack48
from crawlglass.llm.shipping import ship
from crawlglass.llm.words import mix64, word_hashes
from crawlglass.storage import materialize

MIN_UNITS, BUCKET_BYTES = 8, 4_000_000
_STEP = 2_000_000
_VARIANTS = 1_000_000  # emitted together, so that a line of very many units is no more than that at once
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_HALF, _TAIL = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_CHARACTER = np.uint64(0x8EBC6AF09C88C6E3)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Lines:
    """The lines of a step: number of the text, number in the text, units, and sums of hashes times powers."""

    text: np.ndarray
    number: np.ndarray
    n: np.ndarray
    first: np.ndarray  # of the line's units among all units
    upto: np.ndarray  # running sum of hashes times powers, one longer than the units
    a: np.ndarray  # of the words, whatever the units
    b: np.ndarray

    def part(self, line: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Sum over the units start..stop of each line, as if they stood at its beginning."""
        at = self.first[line]
        back = _powers(_BACK, int(start.max(initial=0)) + 1)
        return (self.upto[at + stop] - self.upto[at + start]) * back[start]

    def halves(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the halves that a line within one edit may share: (keys, line of each)."""
        n, zero, keys = self.n[line], np.zeros(len(line), np.int64), []
        for m in (n // 2, (n - 1) // 2):
            size = m.astype(np.uint64)
            keys.append(mix64(self.part(line, zero, m) ^ (size * _HALF)))
            keys.append(mix64(self.part(line, n - m, n) ^ (size * _TAIL)))
        return key48(np.concatenate(keys)), np.tile(line, 4)

    def variants(self, line: np.ndarray, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, place, line): one variant for each deleted unit, and before them the whole lines at place -1.

        ``start`` and ``stop`` count deletions over all the given lines; whole lines come with the first of them.
        """
        n = self.n[line]
        ends = np.cumsum(n)
        at = np.arange(start, int(ends[-1]) if stop is None else min(stop, int(ends[-1])))
        of = np.searchsorted(ends, at, side="right")
        first = self.first[line][of]
        place = at - (ends - n)[of]
        before = self.upto[first + place] - self.upto[first]
        after = self.upto[first + n[of]] - self.upto[first + place + 1]
        left = before + after * np.uint64(_BACK)
        some = line if start == 0 else line[:0]
        whole = self.upto[self.first[some] + self.n[some]] - self.upto[self.first[some]]
        size = np.concatenate([self.n[some], n[of] - 1]).astype(np.uint64)
        keys = mix64(np.concatenate([whole, left]) + size * _HALF)
        return keys, np.concatenate([np.full(len(some), -1), place]), np.concatenate([some, line[of]])


def _sums(hashes: np.ndarray, n: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of ``n`` hashes each: the first place of each, and the running sum of hashes times powers."""
    first = np.cumsum(n) - n
    place = np.arange(len(hashes)) - np.repeat(first, n)
    weighted = hashes * _powers(base, int(n.max(initial=0)))[place]
    return first, np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])


def split(texts: list[str]) -> tuple[Lines, list[str]]:
    """All lines of ``texts``, with and without words, as sequences of words."""
    parts = [t.split("\n") for t in texts]
    count = np.array([len(p) for p in parts], np.int64)
    lines = [x for p in parts for x in p]
    hashes, n = word_hashes([x.encode("utf-8") for x in lines])
    n = n.astype(np.int64)
    first, upto = _sums(hashes, n, _BASE)
    _, more = _sums(mix64(hashes ^ _TAIL), n, _BASE ^ 0xFF51AFD7ED558CCC)
    size = n.astype(np.uint64)
    whole = lambda sums, tag: mix64((sums[first + n] - sums[first]) ^ (size * tag))
    number = np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count)
    text = np.repeat(np.arange(len(texts)), count)
    return Lines(text, number, n, first, upto, whole(upto, _HALF), whole(more, _TAIL)), lines


def by_characters(lines: Lines, written: list[str], most: int) -> tuple[Lines, list[str]]:
    """Of the lines of ``split``, those of 1 to ``most`` words as sequences of characters."""
    some = np.flatnonzero((lines.n > 0) & (lines.n <= most))
    own = [written[i] for i in some]
    joined = [" ".join(_words(x)) for x in own]
    codes = np.frombuffer("".join(joined).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = np.array([len(x) for x in joined], np.int64)
    first, upto = _sums(mix64(codes + _CHARACTER), n, _BASE)
    return Lines(lines.text[some], lines.number[some], n, first, upto, lines.a[some], lines.b[some]), own


VARIANTS = (
    "bucket int, keys binary, places binary, a binary, b binary, docs binary, numbers binary, "
    "line_a long, line_b long, text string"
)
MATCHES = "a long, b long, near_doc_id long, near_line_no int, near_a long, near_b long"


def _earliest_in_step(lines: Lines, ids: np.ndarray, least: int) -> np.ndarray:
    """The first place of each different line that is long enough, by document and number."""
    some = np.flatnonzero(lines.n >= least)
    order = some[np.lexsort((lines.number[some], ids[lines.text[some]], lines.b[some], lines.a[some]))]
    a, b = lines.a[order], lines.b[order]
    new = (np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0)
    return order[new]


def _matches(batch: pd.DataFrame) -> pd.DataFrame:
    """For each line of a bucket, its earliest match, if that is earlier than itself."""
    col = lambda c, kind: np.frombuffer(b"".join(batch[c]), kind)
    key, place = col("keys", "<u8"), col("places", "<i4")
    a, b, doc, number = col("a", "<i8"), col("b", "<i8"), col("docs", "<i8"), col("numbers", "<i4")
    order = np.lexsort((number, doc, place, key))
    key, place, a, b, doc, number = (x[order] for x in (key, place, a, b, doc, number))
    n = len(key)
    new_key = np.diff(key, prepend=~key[:1]) != 0
    new = new_key | (np.diff(place, prepend=-2) != 0)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first of the same key and place
    other = head.copy()
    other[place < 0] = -1  # equal whole lines are not matches of this kind
    # Whole lines against deletions of one word, both ways.
    group = np.cumsum(new_key) - 1
    start = np.flatnonzero(new_key)
    whole = np.where(place[start] < 0, start, -1)[group]  # sorted first in its key, earliest first
    deleted = np.full(len(start), -1)
    gone = np.flatnonzero(place >= 0)
    by_time = gone[np.lexsort((number[gone], doc[gone], group[gone]))]
    lead = np.flatnonzero(np.diff(group[by_time], prepend=-1)) if len(by_time) else by_time
    deleted[group[by_time[lead]]] = by_time[lead]
    across = np.where(place < 0, deleted[group], whole)
    me = np.concatenate([np.arange(n), np.arange(n)])
    it = np.concatenate([other, across])
    me, it = me[it >= 0], it[it >= 0]
    differs = (a[me] != a[it]) | (b[me] != b[it])
    earlier = (doc[it] < doc[me]) | ((doc[it] == doc[me]) & (number[it] < number[me]))
    me, it = me[differs & earlier], it[differs & earlier]
    return pd.DataFrame({"a": a[me], "b": b[me], "near_doc_id": doc[it], "near_line_no": number[it], "near_a": a[it], "near_b": b[it]})


def within_one(x: Sequence[str], y: Sequence[str]) -> bool:
    """Whether one unit inserted, deleted or replaced (or nothing) turns ``x`` into ``y``."""
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def _words(line: str) -> list[str]:
    return [w for w in line.translate(_SPACES).split(" ") if w]


_SPACES = {c: " " for c in range(9, 14)}


def near(x: str, y: str, min_units: int = MIN_UNITS) -> bool:
    """Whether two lines are within the edit bound (or equal)."""
    one, other = _words(x), _words(y)
    if min(len(one), len(other)) >= min_units and within_one(one, other):
        return True
    if max(len(one), len(other)) > min_units:
        return False
    x, y = " ".join(one), " ".join(other)
    return min(len(x), len(y)) >= min_units and within_one(x, y)


def near_lines(docs: DataFrame, min_units: int = MIN_UNITS) -> DataFrame:
    """a, b (hash of a line), near_doc_id, near_line_no: its earliest verified match, for lines that have one.

    ``docs`` has doc_id (not null) and text.
    """
    ship(docs.sparkSession)
    buckets = bucket_count(docs, "text", BUCKET_BYTES)

    def both_ways(step: pa.RecordBatch) -> Iterator[tuple[Lines, list[str], np.ndarray]]:
        """The lines of a step as words, then as characters, and which of them take part."""
        ids = step.column(0).to_numpy(zero_copy_only=False)
        lines, written = split(texts_of(step))
        for lines, written in ((lines, written), by_characters(lines, written, min_units)):
            some = _earliest_in_step(lines, ids, min_units)
            if len(some):
                yield lines, written, some

    def question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_STEP):
            ids = step.column(0).to_numpy(zero_copy_only=False)
            for lines, _, some in both_ways(step):
                keys, line = lines.halves(some)
                pair = np.lexsort((line, keys))  # a half that comes twice in one line asks once
                new = np.append(True, (np.diff(keys[pair]) != 0) | (np.diff(line[pair]) != 0))
                keys, line = keys[pair][new], line[pair][new]
                yield ask(keys, ids[lines.text[line]], buckets, lines.a[line])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_STEP):
            ids = step.column(0).to_numpy(zero_copy_only=False)
            wanted = [unpack48(b"".join(k)) for k in step.column(2).to_pylist()]
            for lines, written, some in both_ways(step):
                keys, line = lines.halves(some)
                mine = np.zeros(len(keys), bool)
                text = lines.text[line]
                order = np.argsort(text, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(text[order])) + 1):
                    mine[rows] = np.isin(keys[rows], wanted[text[rows[0]]])
                some = np.unique(line[mine])
                for start in range(0, int(lines.n[some].sum()), _VARIANTS):
                    yield variant_rows(lines, written, ids, some, start)

    def variant_rows(lines: Lines, written: list[str], ids: np.ndarray, some: np.ndarray, start: int) -> pa.RecordBatch:
        """Rows of ``VARIANTS``: keys by bucket; the lines themselves come with the first of their variants."""
        keys, place, line = lines.variants(some, start, start + _VARIANTS)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        blobs = [
            [values[c].astype(kind).tobytes() for c in cuts]
            for values, kind in (
                (keys, "<u8"), (place, "<i4"), (lines.a[line], "<u8"), (lines.b[line], "<u8"),
                (ids[lines.text[line]], "<i8"), (lines.number[line], "<i4"),
            )
        ]
        some = some if start == 0 else some[:0]
        n, m = len(cuts), len(some)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*(int(bucket[c[0]]) for c in cuts), *([-1] * m)], pa.int32()),
                *(pa.array([*c, *([None] * m)], pa.binary()) for c in blobs),
                pa.array([*([None] * n), *lines.a[some].view(np.int64).tolist()], pa.int64()),
                pa.array([*([None] * n), *lines.b[some].view(np.int64).tolist()], pa.int64()),
                pa.array([*([None] * n), *(written[i] for i in some)], pa.string()),
            ],
            names=["bucket", "keys", "places", "a", "b", "docs", "numbers", "line_a", "line_b", "text"],
        )

    told = answers(docs.mapInArrow(question, ASKED)).withColumnRenamed("id", "doc_id")
    rows = docs.join(told, "doc_id").select("doc_id", "text", "keys").mapInArrow(emit, VARIANTS)
    emitted = materialize(rows, "line-variants")
    matched = emitted.filter("bucket >= 0").groupBy("bucket").applyInPandas(_matches, MATCHES)
    least = matched.groupBy("a", "b").agg(F.min(F.struct("near_doc_id", "near_line_no", "near_a", "near_b")).alias("near")).select(
        "a", "b", "near.*"
    )
    # By the line itself, not by its place: rows that repeat an id have different lines at one place.
    written = emitted.filter("bucket < 0").select("line_a", "line_b", "text").dropDuplicates(["line_a", "line_b"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            right = [near(x, y, min_units) for x, y in zip(batch["text"], batch["near_text"])]
            yield batch.loc[right, ["a", "b", "near_doc_id", "near_line_no"]]

    both = least.join(written.toDF("a", "b", "text"), ["a", "b"]).join(
        written.toDF("near_a", "near_b", "near_text"), ["near_a", "near_b"]
    )
    return both.select("a", "b", "near_doc_id", "near_line_no", "text", "near_text").mapInPandas(
        verify, "a long, b long, near_doc_id long, near_line_no int"
    )


def _hashed(docs: DataFrame) -> DataFrame:
    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, limit=_STEP):
            lines, _ = split(texts_of(step))
            given = np.asarray(step.column(1).is_valid())[lines.text]
            text = pa.array(lines.text[given])
            yield pa.RecordBatch.from_arrays(
                [step.column(0).take(text), step.column(2).take(text), pa.array(lines.number[given], pa.int32()),
                 pa.array(lines.n[given], pa.int64()), pa.array(lines.a[given].view(np.int64)),
                 pa.array(lines.b[given].view(np.int64))],
                names=["doc_id", "row", "line_no", "n_words", "a", "b"],
            )

    return docs.mapInArrow(lines_of, "doc_id long, row long, line_no int, n_words long, a long, b long")


def line_classes(
    docs: DataFrame, *, min_units: int = MIN_UNITS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row a line: doc_id, line_no (from 0), n_words, first_doc_id, first_line_no, near_doc_id, near_line_no, kept.

    Lines are what ``\\n`` separates.  Lines with the same words in the same order (whatever white space parts them)
    are equal; ``first_*`` is the earliest equal line, by (doc_id, line_no).  ``near_*`` is the earliest different line
    that one edit turns into it, if that is earlier than ``first_*``: one inserted, deleted or replaced word if both have
    at least ``min_units`` words, or one such character if both have at most ``min_units`` words and at least
    ``min_units`` characters (white space as one space).  A line is kept if it is the earliest of its equals and has no
    such earlier match, whether or not the match itself is kept.

    Lines without words are always kept.  Null texts have no lines, empty texts one.  Lines of rows with a null id are
    kept and are no one's match.  Rows that repeat an id have equal places, so their lines do not remove each other.
    No rows give no rows.
    """
    base, _ = with_row_key(narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")))
    return _classes(base, min_units).drop("row")


def _classes(base: DataFrame, min_units: int) -> DataFrame:
    """The same, of (doc_id, text, row), with ``row``."""
    ship(base.sparkSession)
    lines = materialize(_hashed(base), "lines")
    taking_part = lines.filter("doc_id IS NOT NULL AND n_words > 0")
    first = taking_part.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    near = near_lines(base.filter("doc_id IS NOT NULL").select("doc_id", "text"), min_units)
    known = first.join(near, ["a", "b"], "left").select(
        "a", "b", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
        "near_doc_id", "near_line_no",
    )
    # Written, so that the join has an exchange on both sides and Spark can split a line that very many documents share.
    joined = taking_part.join(materialize(known, "line-classes"), ["a", "b"])
    own = (F.col("first_doc_id") == F.col("doc_id")) & (F.col("first_line_no") == F.col("line_no"))
    out = ["doc_id", "row", "line_no", "n_words", "first_doc_id", "first_line_no", "near_doc_id", "near_line_no", "kept"]
    rest = lines.filter("doc_id IS NULL OR n_words = 0")
    for column, kind in (("doc_id", "long"), ("line_no", "int")):
        rest = rest.withColumn(f"first_{column}", F.col(column)).withColumn(f"near_{column}", F.lit(None).cast(kind))
    return joined.withColumn("kept", own & F.col("near_doc_id").isNull()).select(out).unionAll(
        rest.withColumn("kept", F.lit(True)).select(out)
    )


def without_duplicate_lines(docs: DataFrame, *, min_units: int = MIN_UNITS) -> DataFrame:
    """``docs`` with the lines removed that :func:`line_classes` does not keep; ``n_chars`` follows the text.

    A document of which no line with words is left is dropped; others keep all their columns and order of lines.
    """
    base, repeated = with_row_key(narrow(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")))
    dropped = _classes(base, min_units).filter("NOT kept")
    gone = dropped.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone")).toDF("id", "key", "gone")
    own = F.col("row").getField("doc_id").cast("long")
    met = F.col("id") == own
    if repeated:
        met &= F.col("key") == F.xxhash64(own, F.xxhash64(F.coalesce(F.col("row").getField("text"), F.lit(""))))
    rows = packed(docs).join(gone, met, "left")
    text = F.col("row").getField("text")
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    rows = rows.select("row", "gone", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("left"))
    rows = rows.filter(F.col("gone").isNull() | F.col("left").rlike("[^ \\x09-\\x0D]"))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("gone").isNull(), F.col("row").getField("n_chars")).otherwise(
        F.length("left")) if "n_chars" in docs.columns else None}
    return rows.select(*(
        (new[c] if c in new else F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns
    ))
