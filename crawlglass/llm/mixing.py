"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Time is cut into slots; each slot carries one block of documents.  A target weight is a number ``n`` of ``h`` parts (``h``
is the sum of all ``n``, about ``RESOLUTION``).  Block ``j`` of a source is released at slot ``floor(j * h / n)`` and due
by slot ``ceil((j + 1) * h / n)``.  In each slot the released block with the earliest deadline runs.  As the weights add
up to one, every slot is filled and no deadline is missed, so at every moment each source is less than one block away
from its exact share, until its blocks run out.

The schedule is not run from its beginning.  Which blocks have run before any slot ``t`` follows from the weights alone:
all that are due by then, and of those that are released but not yet due the most urgent ones, as far as they fit: of the
blocks released at or after a slot ``u``, at most ``t - u`` can have run.  Going through ``u`` from ``t`` downwards and
putting the least urgent ones off whenever there are too many tells which they are.  So the schedule is cut into segments
of ``SEGMENT`` slots, each a row of its own, and only segments in which some document's block may run are made.

Documents find their block from running sums that are cut into many ranges of a source, so a hot source is never sorted
or summed by one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlglass.llm.rows import packed

RESOLUTION, BLOCK_CHARS, MAX_SOURCES = 1 << 28, 20_000, 4_096
LEAST, LEAST_EACH = 256, 12  # a source has at least one in LEAST parts, or in LEAST_EACH a source if that is more
SEGMENT = 512
BROADCAST_BLOCKS = 100_000  # up to so many blocks, their slots (some 300 bytes each) go to all tasks
PLAN = ["n_chars", "start", "block", "release", "deadline", "slot"]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, which are computed once a row even where a lambda function refers to them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _weights(sums: DataFrame, targets: Mapping[str | None, float] | None, resolution: int) -> DataFrame:
    """key, n: parts of a source; more than ``MAX_SOURCES`` sources are refused."""
    mass = sums.groupBy("key").agg(F.sum("mass").alias("mass"))
    if targets is None:
        weight = F.sqrt(F.col("mass").cast("double"))
    else:
        pairs = [F.lit(x) for source, value in targets.items() for x in ("null" if source is None else "=" + source, float(value))]
        known = F.try_element_at(F.create_map(*pairs), F.col("key")) if pairs else F.lit(None).cast("double")
        weight = F.when(known > 0, known).otherwise(0.0)
    shares = mass.select("key", weight.alias("weight"))
    total = shares.agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("sources"))
    share = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0)
    refused = F.raise_error(F.concat(F.col("sources").cast("string"), F.lit(f" sources; a mixture has at most {MAX_SOURCES}")))
    sources = F.when(F.col("sources") > MAX_SOURCES, refused.cast("long")).otherwise(F.col("sources"))
    least = F.greatest(F.lit(1), _div(F.lit(resolution), F.greatest(F.lit(LEAST), sources * LEAST_EACH)))
    n = F.greatest(least, F.floor(share * resolution + 0.5)).cast("long")
    # one row on the right
    return shares.join(F.broadcast(total)).select("key", n.alias("n"))


def _window(j: Column, n: Column, h: Column) -> tuple[Column, Column]:
    """Release and deadline of block ``j``."""
    return _div(j * h, n), _div((j + 1) * h + n - 1, n)


def schedule(weights: DataFrame, segments: DataFrame, slots: int = SEGMENT) -> DataFrame:
    """key, block, slot of all slots of the given segments (``segment``, a long); segment 0 has the first ``slots``.

    ``weights`` (key, n) has at most ``MAX_SOURCES`` rows and is sent to all tasks as one row.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("sources"), F.sum("n").alias("h"))
    h, t0 = F.col("h"), F.col("t0")
    rows = _once(segments.select((F.col("segment") * slots).alias("t0")).join(F.broadcast(one)),
                 due=F.transform("sources", lambda s: _div(s["n"] * t0, h)))

    def waiting(s: Column, i: Column) -> Column:
        release, deadline = _window(F.get("due", i), s["n"], h)
        return F.struct(deadline.alias("deadline"), i.alias("i"), release.alias("release"))

    rows = _once(rows, open=F.filter(F.transform("sources", waiting), lambda x, i: F.get("sources", i)["n"] * t0 % h != 0))
    rows = _once(rows, since=F.array_min(F.transform("open", lambda x: x["release"])))
    add = lambda acc, x: acc + x
    nothing = F.lit(0).cast("long")

    def fit(kept: Column, u: Column) -> Column:
        """The most urgent of the open blocks released at ``u`` or later that can have run."""
        due = F.zip_with("sources", "due", lambda s, d: F.greatest(nothing, d - _div(s["n"] * u + h - 1, h)))
        new = F.filter("open", lambda x: x["release"] == u)
        return F.slice(F.array_sort(F.concat(kept, new)), F.lit(1), (t0 - u - F.aggregate(due, nothing, add)).cast("int"))

    back = F.when(F.col("since").isNotNull(), F.sequence(t0 - 1, F.col("since"), F.lit(-1).cast("long")))
    none = F.filter("open", lambda x: F.lit(False))
    rows = _once(rows, fitting=F.aggregate(F.coalesce(back, F.array().cast("array<long>")), none, fit))
    left = (t0 - F.aggregate("due", nothing, add)).cast("int")
    rows = _once(rows, ran=F.transform(F.slice("fitting", F.lit(1), left), lambda x: x["i"]))
    rows = _once(rows, done=F.transform("due", lambda d, i: d + F.array_contains("ran", i).cast("long")))
    state = F.struct(F.col("done").alias("done"), F.array().cast("array<struct<i:int,block:bigint>>").alias("picks"))

    def step(acc: Column, t: Column) -> Column:
        def urgency(s: Column, i: Column) -> Column:
            j = F.get(acc["done"], i)
            release, deadline = _window(j, s["n"], h)
            return F.when(release <= t, F.struct(deadline.alias("deadline"), i.alias("i"), j.alias("block")))

        def chosen(pick: Column) -> Column:
            return F.struct(
                F.transform(acc["done"], lambda d, i: F.when(i == pick["i"], d + 1).otherwise(d)).alias("done"),
                F.array_append(acc["picks"], F.struct(pick["i"].alias("i"), pick["block"].alias("block"))).alias("picks"),
            )

        # The pick is passed through an array of one, so that it is evaluated once a slot.
        pick = F.array_min(F.transform("sources", urgency))
        return F.get(F.transform(F.array(pick), chosen), F.lit(0))

    picks = F.aggregate(F.sequence(t0, t0 + (slots - 1)), state, step, lambda acc: acc["picks"])
    return rows.select("sources", "t0", F.posexplode(picks).alias("at", "pick")).select(
        F.get("sources", F.col("pick.i"))["key"].alias("key"), F.col("pick.block").alias("block"),
        (F.col("t0") + F.col("at")).alias("slot"),
    )


def mix(
    docs: DataFrame,
    targets: Mapping[str | None, float] | None = None,
    *,
    resolution: int = RESOLUTION,
    block_chars: int = BLOCK_CHARS,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with all their columns, and their place in the mixture; sort by (slot, start) to read it.

    Within a source, documents come in the order of the md5 of their id (then of the id), and blocks have
    ``block_chars`` characters; each document counts one more, and belongs to the block in which it starts (a longer
    one fills the blocks it covers).  Added columns, which replace input columns of these names: ``n_chars``,
    ``start`` (characters of its source before it), ``block``, ``release``, ``deadline``, ``slot``.

    ``targets`` gives weights by source name; without it a weight is the square root of a source's characters.  Weights
    are rounded to one in ``resolution`` parts.  So that no row is ever lost, each source has at least one in 256 parts,
    or in 12 a source if that is more, also without a positive target; all weights are then brought to a sum of one.

    Null or empty texts have no characters but keep their row; null sources are a source of their own; rows with a
    null id come first; repeated rows each keep a place; equal deadlines go to the smaller source name.  No rows
    give no rows.  More than ``MAX_SOURCES`` sources are refused.
    """
    n_chars = F.coalesce(F.length(F.col("row").getField(text)), F.lit(0)).cast("long")
    own = F.col("row").getField(source)
    rows = packed(docs).select(
        "row",
        F.when(own.isNull(), "null").otherwise(F.concat(F.lit("="), own.cast("string"))).alias("key"),
        n_chars.alias("n_chars"),
        F.coalesce(F.md5(F.col("row").getField(doc_id).cast("string").cast("binary")), F.lit("")).alias("hash"),
    )
    # Ranges of a source: as many as hold about the square root of all rows each.
    count, chars = rows.agg(F.count(F.lit(1)), F.sum(F.col("n_chars") + 1)).first()
    digits = 1
    while 16 ** (2 * digits) < count:
        digits += 1
    rows = rows.withColumn("range", F.substring("hash", 1, digits))
    mass = F.col("n_chars") + 1
    sums = rows.groupBy("key", "range").agg(F.sum(mass).alias("mass"))
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("key", "range", F.coalesce(F.sum("mass").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("key", "range").orderBy("hash", F.col("row").getField(doc_id), "n_chars")
    placed = rows.join(starts, ["key", "range"]).withColumn(
        "start", F.col("first") + F.coalesce(F.sum(mass).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    weights = _weights(sums, targets, resolution)
    shares = weights.join(F.broadcast(weights.agg(F.sum("n").alias("h"))))
    # All blocks that a source has, whether or not a document starts in each.
    blocks = sums.groupBy("key").agg(F.sum("mass").alias("mass")).join(F.broadcast(shares), "key").select(
        "key", "n", "h", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("mass") - 1, F.lit(block_chars)))).alias("block")
    )
    release, deadline = _window(F.col("block"), F.col("n"), F.col("h"))
    windows = blocks.select("key", "block", release.alias("release"), deadline.alias("deadline"))
    first, last = _div(F.col("release"), F.lit(SEGMENT)), _div(F.col("deadline") - 1, F.lit(SEGMENT))
    segments = windows.select(F.explode(F.sequence(first, last)).alias("segment")).distinct()
    slots = windows.join(schedule(weights, segments), ["key", "block"])
    if (chars or 0) // block_chars + MAX_SOURCES <= BROADCAST_BLOCKS:
        slots = F.broadcast(slots)
    mixed = placed.withColumn("block", _div(F.col("start"), F.lit(block_chars))).join(slots, ["key", "block"])
    kept = [c for c in docs.columns if c not in PLAN]
    return mixed.select(*(F.col("row").getField(c).alias(c) for c in kept), *PLAN)


def in_order(docs: DataFrame, targets: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` with their own columns only, sorted into the order of the mixture."""
    row = packed(docs).select("row", *(F.col("row").getField(c).alias(c) for c in ("doc_id", "text", "source")))
    mixed = mix(row, targets, **options).repartitionByRange("slot", "start").sortWithinPartitions("slot", "start")
    return mixed.select("row.*")
