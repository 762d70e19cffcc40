"""Joins and ranks that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlglass.storage import materialize

# A key with more left rows than this is split over SALTS join partitions.
HOT_ROWS = 200_000
SALTS = 64


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def hot_keys(counted: DataFrame, keys: list[str], n: str, hot_rows: int) -> DataFrame:
    """Hashes of keys with more than ``hot_rows`` rows: at most rows / hot_rows of them."""
    return counted.filter(F.col(n) > hot_rows).select(_hash(keys).alias("_key")).distinct()


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: str,
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Equi-join with a ``right`` side that has one row per key, where exact counts of the keys exist anyway.

    Rows of hot left keys (``hot``: see :func:`hot_keys`) are spread over several
    partitions by a hash of the ``spread`` column (not by a random number, so a
    recomputed task gives the same rows), and the one matching right row is
    repeated for each of them.  Only the hashes of hot keys are broadcast; there
    are at most rows / hot_rows of them.  Without counts a plain join is better:
    adaptive execution splits its skewed partitions.
    """
    flags = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salted_left = (
        left.withColumn("_key", _hash(keys))
        .join(flags, "_key", "left")
        .withColumn(
            "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
        )
        .drop("_key", "_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_right = (
        right.withColumn("_key", _hash(keys))
        .join(flags, "_key", "left")
        .withColumn("_salt", F.explode(copies))
        .drop("_key", "_hot")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a partial aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.min(row).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def with_position(df: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """Dense 0-based rank over the whole of ``df``, without a single-task window.

    A range sort numbers rows within partitions; only one count per partition
    goes to the driver.  The sorted table is written, so numbers stay fixed.
    """
    stored = materialize(
        df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), label
    )
    # upper bits: sort partition, lower 33 bits: row within it
    partition = F.shiftright("_row", 33)
    sizes = (
        stored.groupBy(partition.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()
    )
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    lookup = df.sparkSession.createDataFrame(starts, "_part bigint, _first bigint")
    local = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.join(F.broadcast(lookup), partition == F.col("_part"))
        .withColumn(name, F.col("_first") + local)
        .drop("_row", "_part", "_first")
    )


def with_group_position(df: DataFrame, groups: list[str], order: list[str], name: str, label: str) -> DataFrame:
    """Dense 0-based rank within each group; a hot group is still sorted by many tasks."""
    ranked = materialize(with_position(df, [*groups, *order], "_global", label), label)
    starts = ranked.groupBy(*groups).agg(
        F.min("_global").alias("_start"), F.count(F.lit(1)).alias("_n")
    )
    hot = hot_keys(starts, groups, "_n", HOT_ROWS)
    joined = join_unique(ranked, starts.drop("_n"), groups, spread="_global", hot=hot)
    return joined.withColumn(name, F.col("_global") - F.col("_start")).drop("_global", "_start")
