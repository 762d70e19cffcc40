"""Edges that are stored once, by where they start, and followed again and again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from crawlglass.storage import materialize, materialize_bucketed

# A start's edges are cut into pieces of so many positions, so that a hub is shared by several tasks.
PIECE = 1_000


@dataclass(frozen=True)
class Edges:
    """``rows`` lie in buckets of (key, piece); ``hubs`` tells the pieces of keys that have more than one."""

    rows: DataFrame
    hubs: DataFrame
    key: str

    def follow(self, starts: DataFrame, where: str | None = None) -> DataFrame:
        """The edges (that fulfil ``where``) of ``starts``, which may repeat a key; only ``starts`` move."""
        pieces = F.coalesce("_pieces", F.lit(1)) - 1
        met = starts.join(self.hubs, self.key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces))).drop("_pieces")
        rows = self.rows if where is None else self.rows.filter(where)
        return rows.join(met, [self.key, "_piece"]).drop("_piece")


def store_edges(edges: DataFrame, key: str, label: str, pos: str = "pos", piece: int = PIECE) -> Edges:
    """``edges`` have ``key`` and ``pos``, their position among the edges of the key."""
    cut = edges.withColumn("_piece", F.floor(F.col(pos) / piece).cast("int"))
    rows = materialize_bucketed(cut, label, [key, "_piece"])
    hubs = rows.groupBy(key).agg((F.max("_piece") + 1).alias("_pieces")).filter("_pieces > 1")
    return Edges(rows, materialize(hubs, f"{label}-hubs"), key)
