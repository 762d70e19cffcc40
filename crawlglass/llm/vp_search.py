"""Approximate nearest neighbours by inner product with vantage-point trees, one a shard.

Inner products are made a metric: every indexed vector x gets one more component so that all have the same length R,
and a query gets a zero there.  The squared distance is then |q|**2 + R**2 - 2 * (q . x), so the nearest vector has
the largest inner product, and the triangle inequality holds.

A node of a tree has a vantage point and the median distance of its vectors to it; the nearer half is inside.  The gap
between a query's distance to the vantage point and the median bounds its distance to all vectors of the other side.
With the distance t of its worst neighbour so far, the other side is pruned if ``factor`` * gap > t.  ``factor`` 1 is
the triangle inequality and gives the exact result; larger factors prune more and may miss neighbours.  How many
depends on the vectors: with unequal lengths the new component makes all distances large, and a factor that suits unit
vectors prunes wrongly.  So recall is measured where it arises: in each shard, some queries of a block are compared
with all vectors, and the factor is lowered, down to 1, until enough of their neighbours are found.

Queries go through a shard in blocks: a node handles all queries of the block that reach it with array operations, the
nearer side first.  Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.llm.rows import narrow
from crawlglass.storage import materialize

NEIGHBOURS, FACTOR = 20, 5.0
SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 1_024, 256
RECALL, SAMPLE = 0.97, 64  # demanded of the sampled queries of a block, and their number


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    point: np.ndarray | None = None
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


def lifted(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` with one more component, all of the same length."""
    lengths = (vectors**2).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(lengths.max() - lengths, 0.0))])


def build(points: np.ndarray, leaf: int = LEAF, seed: int = 0) -> Node:
    """A vantage-point tree over the rows of ``points``; vantage points are drawn with a fixed seed."""
    draw = np.random.default_rng(seed)

    def node(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(rows=rows)
        point = points[rows[draw.integers(len(rows))]]
        distance = np.sqrt(((points[rows] - point) ** 2).sum(axis=1))
        radius = float(np.median(distance))
        near = distance <= radius
        if near.all():  # all at one distance, such as equal vectors
            return Node(rows=rows)
        return Node(None, point, radius, node(rows[near]), node(rows[~near]))

    return node(np.arange(len(points)))


def search(
    tree: Node, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (ids, inner products) of each query, -1 and -inf where there are fewer; ties to smaller ids."""
    best = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    vectors = points[:, :-1]
    asked = np.column_stack([queries, np.zeros(len(queries))])
    base = (queries**2).sum(axis=1) + (points[0] ** 2).sum() if len(points) else np.zeros(len(queries))

    def worst(q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(base[q] - 2 * best[q, -1], 0.0))

    def leaf(rows: np.ndarray, q: np.ndarray) -> None:
        scores = queries[q] @ vectors[rows].T
        scores[ids[rows][None, :] == query_ids[q][:, None]] = -np.inf
        if len(rows) > k:  # those that can be among the best k; the last kept score stands for its ties
            edge = np.maximum(np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k], best[q, -1])
        else:
            edge = best[q, -1]
        hit, column = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        if not len(hit):
            return
        some = np.unique(hit)
        who = np.concatenate([hit, np.repeat(some, k)])
        score = np.concatenate([scores[hit, column], best[q[some]].ravel()])
        name = np.concatenate([ids[rows][column], found[q[some]].ravel()])
        order = np.lexsort((name, -score, who))
        who, score, name = who[order], score[order], name[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        best[q[who[top]], place[top]], found[q[who[top]], place[top]] = score[top], name[top]

    def visit(node: Node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.rows is not None:
            for start in range(0, len(node.rows), 4_096):
                leaf(node.rows[start : start + 4_096], q)
            return
        d = np.sqrt(((asked[q] - node.point) ** 2).sum(axis=1))
        near = d <= node.radius
        visit(node.inside, q[near])
        visit(node.outside, q[near][factor * (node.radius - d[near]) <= worst(q[near]) * (1 + 1e-9)])
        visit(node.outside, q[~near])
        visit(node.inside, q[~near][factor * (d[~near] - node.radius) <= worst(q[~near]) * (1 + 1e-9)])

    if len(points):
        visit(tree, np.arange(len(queries)))
    found[np.isneginf(best)] = -1
    return found, best


def fitting_factor(
    tree: Node, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float,
    recall: float = RECALL, sample: int = SAMPLE,
) -> float:
    """The largest of ``factor``, its halves and 1 at which ``sample`` of the queries find ``recall`` of their neighbours."""
    if factor <= 1 or not len(queries) or not len(points):
        return factor
    some = np.unique(np.linspace(0, len(queries) - 1, min(sample, len(queries))).astype(np.int64))
    asked, names = queries[some], query_ids[some]
    scores = asked @ points[:, :-1].T
    scores[ids[None, :] == names[:, None]] = -np.inf
    top = -np.sort(-np.partition(scores, max(scores.shape[1] - k, 0), axis=1)[:, -k:], axis=1)
    there = top > -np.inf
    edge = np.where(there, top, np.finfo(float).max).min(axis=1)  # a neighbour is what scores no less than the last true one
    edge -= 1e-9 * np.abs(edge)
    while factor > 1:
        _, best = search(tree, points, ids, asked, names, k, factor)
        if (best >= edge[:, None]).sum() >= recall * there.sum():
            break
        factor = max(factor / 2, 1.0)
    return factor


def _usable(vectors: DataFrame, vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vector, lambda x: x != 0)
    return F.col(vector).isNotNull() & ~bad & ~zero & F.col("id").isNotNull()


def _packed(rows: DataFrame, part: Column, width: str) -> DataFrame:
    """One row for each part and length of vectors: ids and vectors as packed arrays."""

    return rows.groupBy(part.alias(width), F.size("vector").alias("n")).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))


def _arrays(rows: pa.StructArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    flat = rows.field("vector").flatten().to_numpy(zero_copy_only=False)
    return ids[order], flat.reshape(len(ids), n)[order]


def nearest(
    vectors: DataFrame, queries: Column, *, k: int = NEIGHBOURS, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, by inner product, ties to smaller ids.

    ``queries`` is a condition on column ``id``; each such row is searched among all rows but its own id.  With fewer
    candidates than ``k``, all are returned.  ``factor`` 1 gives exact neighbours; a larger one is where each shard
    starts for each block of queries, and is lowered by :func:`fitting_factor`.

    Vectors that are null, zero, or hold a null or non-finite component, and rows with a null id, take no part.
    Vectors are compared with those of their own length only.  Rows that repeat an id are one: the first of them by
    vector.  No rows give no rows.  Shards have about ``shard_rows`` vectors and query blocks ``block_rows``; every
    block meets every shard once.
    """
    rows = narrow(vectors, id=vec_id, vector=vector)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.filter(_usable(rows, "vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = materialize(rows, "vectors")
    asked = rows.filter(queries)
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    indexed = _packed(rows, spread(shards, 1), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grouped = _packed(asked, spread(blocks, 2), "block").withColumnRenamed("rows", "queries")
    met = indexed.withColumn("block", F.col("block").cast("long")).join(
        grouped.withColumn("block", F.col("block").cast("long")), ["block", "n"]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                ids, data = _arrays(batch.column("rows")[i].values, n)
                query_ids, asking = _arrays(batch.column("queries")[i].values, n)
                points = lifted(data)
                tree = build(points)
                fitting = fitting_factor(tree, points, ids, asking, query_ids, k, factor)
                found, score = search(tree, points, ids, asking, query_ids, k, fitting)
                some = found >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids, some.sum(axis=1))), pa.array(found[some]), pa.array(score[some])],
                    names=["query_id", "vec_id", "score"],
                )

    near = met.select("n", "rows", "queries").mapInArrow(look, "query_id long, vec_id long, score double")
    top = near.groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("cost"), "vec_id"))), 1, k).alias("top")
    )
    listed = top.select("query_id", F.posexplode("top").alias("place", "hit"))
    return listed.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.cost")).alias("score"),
    )
