"""Cutting lineage with written tables in the cluster's shared folder.

Site-level passes read the same extracted page facts several times.  Parsing
HTML again for each pass would be the dominant cost, so the facts are written
once as Parquet (columnar: each pass then reads only its own columns) under the
folder named by ``spark.checkpoint.dir``.  The table outlives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_BUCKETED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; a local one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="crawlglass-")
    return _LOCAL_DIRS[app]


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/crawlglass/{spark.sparkContext.applicationId}"


def remove_run(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when all results are written."""
    for table in _BUCKETED.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The same, and the number of rows, which the written files tell."""
    stored = materialize(df, label)
    return stored, stored.count()


def materialize_bucketed(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Write ``df`` once, dealt out and sorted by ``keys``: joins on them find it in place and move the other side only."""
    spark = df.sparkSession
    path = new_path(spark, label)
    table = "crawlglass_" + path.rpartition("-")[2]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out by the hash that names the buckets, so that each task writes one file.
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table)
    _BUCKETED.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)
