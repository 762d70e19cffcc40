"""The trie of conversations that share their first turns.

A turn is known by the digest of its role and text; the digests of a conversation's first d turns fold into the key of
its depth-d node.  Turns are numbered, and keys folded, along a range sort of narrow rows: a fold of two stretches
follows from the folds of each, so a conversation may lie in many partitions and still only one small row a partition
meets on the driver.

Conversations are then cut into blocks of ``BLOCK_TURNS`` turns.  A block is known by the keys at its two ends, and
equal blocks become one row with the number of conversations in it.  Where all conversations that reach a block's
start go through the same block, its inner turns have the members of the block, and nothing more is asked.  Only
where blocks with one start differ, their turns are grouped one by one.

Sums over a subtree need no walk.  A node belongs to its smallest member r; so the nodes of a subtree are those that
belong to one of its members, less those that r owns above.  Both are sums over blocks, as above, and running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.llm.rows import name
from crawlglass.llm.shipping import ship
from crawlglass.operators.skew import hot_keys, join_unique
from crawlglass.storage import materialize

BLOCK_TURNS, FAMILY, HEADS = 8, 20, 4
# A key with more rows than this is spread over several tasks of a join.
HOT_ROWS = 20_000
# Bytes of joined ids in one row on their way to the hash.
PIECE_BYTES = 64_000
_BASES = {"k1": 0x9E3779B97F4A7C15, "k2": 0xD1342543DE82EF95}
_KEY = ["depth", "k1", "k2"]
_WORD = r"[^\x20\x09-\x0D]+"


def _fold(base: int, values: np.ndarray, start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``x = x * base + value`` along each group, modulo 2**64; ``start``: a row's group's first row, ``place``: its own."""
    if base == 1:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[place + 1] - total[start]
    powers = np.ones((2, len(values) + 1), np.uint64)
    for row, factor in zip(powers, (base, pow(base, -1, 1 << 64))):
        row[1:] = np.cumprod(np.full(len(values), factor, np.uint64), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[1][: len(values)], dtype=np.uint64)])
    return (total[place + 1] - total[start]) * powers[0][place]


def running(df: DataFrame, group: str, order: list[str], folds: dict[str, int], label: str) -> DataFrame:
    """``df`` with ``n``, the row's number in its group from 1, and its longs in ``folds`` folded over all rows up to it.

    A fold with base 1 is a sum.  Rows are range-sorted, so a group may span partitions: each partition tells what its
    last group amounts to (one row), and rows of its first group are folded once more onto what came before.
    """
    columns = [*df.columns, "n", "part"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(batch.schema.get_field_index(group)).to_numpy()
            rows = np.arange(len(groups))
            new = np.diff(groups, prepend=groups[:1] if last == groups[0] else ~groups[:1]) != 0
            start = np.maximum.accumulate(np.where(new | (rows == 0), rows, 0))
            known = start == 0 if not new[0] else np.zeros(len(rows), bool)  # rows that go on with the last batch's group
            n = rows - start + 1 + np.where(known, held.get("n", 0), 0)
            arrays = dict(zip(batch.schema.names, batch.columns))
            for c, base in folds.items():
                folded = _fold(base, arrays[c].to_numpy().view(np.uint64), start, rows)
                if known.any():
                    folded[known] += np.uint64(held[c]) * _power(base, (rows + 1)[known])
                held[c] = int(folded[-1])
                arrays[c] = pa.array(folded.view(np.int64))
            held["n"], last = int(n[-1]), groups[-1]
            arrays["n"] = pa.array(n.astype(np.int64))
            arrays["part"] = pa.array(np.full(len(rows), part, np.int64))
            yield pa.RecordBatch.from_arrays([arrays[c] for c in columns], names=columns)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + ", n long, part long"
    sorted_ = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = materialize(sorted_.mapInArrow(local, schema), label)
    ends = stored.groupBy("part").agg(
        F.min(group).alias("first"), F.max(F.struct(group, "n", *folds)).alias("last")
    ).orderBy("part").collect()
    before: dict[int, dict] = {}
    held: dict = {}
    for end in ends:
        if held and held["group"] == end["first"]:
            before[end["part"]] = dict(held)
        own = end["last"]
        made = {"group": own[group], "n": own["n"], **{c: own[c] % (1 << 64) for c in folds}}
        if held and held["group"] == own[group]:  # a group that fills the partition goes on
            for c, base in folds.items():
                made[c] = (held[c] * pow(base, own["n"], 1 << 64) + made[c]) % (1 << 64)
            made["n"] += held["n"]
        held = made
    if not before:
        return stored.drop("part")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = dict(zip(batch.schema.names, batch.columns))
            parts, groups, n = (arrays[c].to_numpy() for c in ("part", group, "n"))
            more = np.zeros(len(n), np.int64)
            sums = {c: arrays[c].to_numpy().view(np.uint64).copy() for c in folds}
            for part in np.unique(parts).tolist():
                if part not in before:
                    continue
                known = before[part]
                some = np.flatnonzero((parts == part) & (groups == known["group"]))
                more[some] = known["n"]
                for c, base in folds.items():
                    sums[c][some] += np.uint64(known[c]) * _power(base, n[some])
            arrays["n"] = pa.array(n + more)
            arrays |= {c: pa.array(x.view(np.int64)) for c, x in sums.items()}
            yield pa.RecordBatch.from_arrays([arrays[c] for c in columns[:-1]], names=columns[:-1])

    return stored.mapInArrow(whole, schema.removesuffix(", part long"))


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo 2**64."""
    out, factor, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64)
    while left.any():
        out[(left & np.uint64(1)).astype(bool)] *= np.uint64(factor)
        left, factor = left >> np.uint64(1), factor * factor % (1 << 64)
    return out


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, d1, d2, words)`` of every row with a conversation; texts go no further."""
    text, role = F.coalesce(name("text"), F.lit("")), F.coalesce(name("role"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.filter(name("conv_id").isNotNull()).select(
        name("conv_id").cast("long").alias("conv_id"), name("turn").alias("turn"), role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )


def _halves(digest: Column) -> list[Column]:
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return [half(1).alias("k1"), half(17).alias("k2")]


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, n, k1, k2, words)``: the turns of the rebuilt conversations in order, with the keys of their nodes."""
    numbered = running(turns, "conv_id", ["turn", "role", "digest"], {}, "trie-turns")
    numbered = numbered.select("conv_id", "n", "digest", "words")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = numbered.filter((F.col("conv_id") % FAMILY == 0) & (F.col("n") < HEADS)).select(
        F.col("conv_id").alias("base"), "n", "digest", "words"
    )
    wanted = numbered.filter("n = 1").select("conv_id", base.alias("base"), taken.alias("h")).filter("h > 0")
    copied = wanted.join(heads, "base").filter("n <= h").select("conv_id", F.lit(0).alias("own"), "n", "digest", "words")
    kept = numbered.filter(F.col("n") > taken).select("conv_id", F.lit(1).alias("own"), "n", "digest", "words")
    rows = copied.unionByName(kept).select("conv_id", "own", F.col("n").alias("at"), *_halves(F.col("digest")), "words")
    return running(rows, "conv_id", ["own", "at"], _BASES, "trie-rebuilt").select("conv_id", "n", "k1", "k2", "words")


def _block_rows(rows: DataFrame, turns: int) -> DataFrame:
    """``(conv_id, start, end, turns)``: keys before and at the end of each block, and its at most ``turns`` nodes."""
    cut = rows.groupBy("conv_id", F.floor((F.col("n") - 1) / turns).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("n").alias("depth"), "k1", "k2", "words"))).alias("turns")
    )
    # The key before a block is that at the end of the block before: one row further for each conversation.
    ends = cut.select("conv_id", (F.col("block") + 1).alias("block"), F.element_at("turns", -1).alias("last"))
    met = cut.join(ends, ["conv_id", "block"], "left")
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    key = lambda c: F.struct(F.col(f"{c}.depth").alias("depth"), F.col(f"{c}.k1").alias("k1"), F.col(f"{c}.k2").alias("k2"))
    return met.withColumn("end_", F.element_at("turns", -1)).select(
        "conv_id", F.when(F.col("last").isNull(), root).otherwise(key("last")).alias("start"), key("end_").alias("end"), "turns"
    )


def _by_turn(blocks: DataFrame, *columns: str) -> DataFrame:
    """One row for each node of each block: its key, the words of its turn, the key of its parent, ``columns``."""
    return blocks.select("start", "turns", *columns, F.posexplode("turns").alias("i", "t")).select(
        "t.depth", "t.k1", "t.k2", "t.words",
        F.when(F.col("i") == 0, F.col("start")).otherwise(
            F.element_at("turns", F.greatest("i", F.lit(1))).dropFields("words")
        ).alias("parent"),
        *columns,
    )


def _grouped(blocks: DataFrame, sums: dict[str, Column], **others: Column) -> DataFrame:
    """Nodes of equal ``blocks`` taken together: turn by turn only where blocks with one start differ."""
    equal = materialize(blocks.groupBy("start", "end").agg(
        F.first("turns").alias("turns"), *(c.alias(n) for n, c in (sums | others).items())
    ), "trie-blocks")
    starts = equal.groupBy("start").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    starts = materialize(starts, "trie-branches")
    split = {"hot": hot_keys(starts, ["start"], "kinds", HOT_ROWS), "spread": "end"}
    carried = [*sums, *others]
    straight = join_unique(equal, starts.select("start"), ["start"], how="left_anti", **split)
    parted = join_unique(equal, starts.select("start"), ["start"], how="left_semi", **split)
    again = {n: F.sum(n) for n in sums} | {n: F.min(n) for n in others}
    refined = _by_turn(parted, *carried).groupBy(*_KEY).agg(
        F.first("words").alias("words"), F.first("parent").alias("parent"), *(c.alias(n) for n, c in again.items())
    )
    return _by_turn(straight, *carried).unionByName(refined)


def _ends_hash(ends: DataFrame) -> DataFrame:
    """Key and ``ends_sha256`` of every node where conversations end: their ids, ascending, joined by commas.

    Ids are range-sorted and joined in pieces, so that what one task must hash in order are bytes, not rows.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, key, held = TaskContext.get().partitionId(), 0, None, []

        def close() -> pa.RecordBatch:
            nonlocal number
            number += 1
            values = [*key, (part << 33) + number, ",".join(map(str, held))]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[*_KEY, "piece", "ids"])

        out: list[pa.RecordBatch] = []
        for batch in batches:
            for *own, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != key or len(held) >= PIECE_BYTES // 20:
                    if held:
                        out.append(close())
                    key, held = own, []
                held.append(conv)
                if len(out) >= 4_096:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
        if held:
            out.append(close())
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_KEY, "ends_sha256"]
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for *own, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=names)

    by_id = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    joined = by_id.mapInArrow(pieces, "depth long, k1 long, k2 long, piece long, ids string")
    in_order = joined.repartition(*(F.col(c) for c in _KEY)).sortWithinPartitions(*_KEY, "piece").drop("piece")
    return in_order.mapInArrow(hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from ``(conv_id, turn, role, text)``.

    Conversation c is rebuilt from the first h turns of conversation ``c - c % 20`` (all if it has fewer, none if it
    is absent) and its own turns after its first h, h being crc32 of c's digits modulo 4.  Each different sequence of
    first d turns is a node, from the root (d = 0), of which all conversations are members:
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    Turns are in order of turn (null first), then of role, then of the md5 digest of role and text.  Null role or text
    is empty; rows that repeat a turn are turns of their own; rows without conv_id belong to no conversation and are
    left out; other columns are not read.  Without rows there is no node.
    """
    ship(conversations.sparkSession)
    turns = materialize(turns_of(conversations), "trie-narrow")
    rows = materialize(rebuilt(turns), "trie-rows")
    ids = turns.select("conv_id").distinct()
    last = rows.groupBy("conv_id").agg(F.max(F.struct(F.col("n").alias("depth"), "k1", "k2")).alias("end"))
    zero = F.lit(0).cast("long")
    ends = materialize(ids.join(last, "conv_id", "left").select(
        "conv_id", *(F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in _KEY)
    ), "trie-ends")
    blocks = materialize(_block_rows(rows, block_turns), "trie-block-rows")

    found = materialize(_grouped(blocks, {"n_convs": F.count(F.lit(1))}, owner=F.min("conv_id")), "trie-found")
    root = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner")).filter("n_convs > 0").select(
        *(zero.alias(c) for c in _KEY), zero.alias("words"),
        F.lit(None).cast("struct<depth:bigint,k1:bigint,k2:bigint>").alias("parent"), "n_convs", "owner",
    )
    called = found.select("parent.*").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(found.unionByName(root).join(called, _KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "tokens": (F.col("n_convs") - 1) * F.col("words")
    }), "trie-nodes")

    # What each conversation owns: the tokens saved by its nodes, and its leaf.
    owned = nodes.groupBy("owner").agg(
        F.sum("tokens").alias("tokens"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")
    ).select(F.col("owner").alias("conv_id"), "tokens", "leaves")
    owned = materialize(owned, "trie-owned")
    many = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    carrying = join_unique(blocks, owned, ["conv_id"], spread="end", hot=hot_keys(many, ["conv_id"], "_n", HOT_ROWS))
    sums = _grouped(carrying, {"tokens": F.sum("tokens"), "leaves": F.sum("leaves")}).select(
        *_KEY, F.col("tokens").alias("all_tokens"), F.col("leaves").alias("all_leaves")
    )
    everything = owned.agg(F.sum("tokens").alias("all_tokens"), F.sum("leaves").alias("all_leaves")).select(
        *(zero.alias(c) for c in _KEY), "all_tokens", "all_leaves"
    )
    # What a node's owner owns above it.
    shared = nodes.filter("n_convs > 1").select("owner", *_KEY, "tokens", F.col("tokens").alias("above"))
    above = running(shared, "owner", ["depth"], {"above": 1}, "trie-above").select(*_KEY, (F.col("above") - F.col("tokens")).alias("above"))
    full = (
        nodes.join(sums.unionByName(everything), _KEY, "left")
        .join(above, _KEY, "left")
        .join(_ends_hash(ends), _KEY, "left")
    )
    parents = nodes.select(F.struct(*_KEY).alias("parent"), F.col("owner").alias("parent_conv_id"))
    hot = hot_keys(nodes.select(F.struct(*_KEY).alias("parent"), "n_children"), ["parent"], "n_children", HOT_ROWS)
    named = join_unique(full, parents, ["parent"], spread="k1", how="left", hot=hot)
    return named.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("all_leaves").alias("n_leaves"),
        F.when(F.col("n_convs") > 1, F.col("all_tokens") - F.col("above")).otherwise(zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
