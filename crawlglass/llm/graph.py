"""Connected components of links between documents, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crawlglass.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.unionAll(own).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (columns a, b), where component is the smallest node reachable.

    Alternating large-star and small-star steps end in stars after a number of rounds that is logarithmic in the
    longest path.  Each round is written to the shared folder, so lineage stays short and a lost executor costs one
    round at most.  A star's links are aggregated before they are shuffled.  No edges give no rows.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = materialize(edges, label), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if before == state or not state.n:
            break
        # Stars that share no node are final.
        mixed = edges.select(F.col("a").alias("b")).join(edges.select("b"), "b", "left_semi").limit(1).count()
        shared = mixed or edges.groupBy("b").count().filter("count > 1").limit(1).count()
        if not shared:
            break
        before = state
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), label)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
