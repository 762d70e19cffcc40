"""Run registered queries against their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.registry import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return repr(v)
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return f"rows only ({len(got[1])})"
    result = con.execute(ORACLES[name])
    want = _canonical([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} / {want[0]}"
    if got[1] != want[1]:
        only_spark = [r for r in got[1] if r not in set(want[1])][:3]
        only_sql = [r for r in want[1] if r not in set(got[1])][:3]
        return f"VALUES {len(got[1])}/{len(want[1])} spark-only {only_spark} sql-only {only_sql}"
    return f"ok ({len(got[1])})"


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    for name in sys.argv[2:] or list(QUERIES):
        start = time.time()
        try:
            outcome = compare(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {str(error)[:700]}"
        print(f"{name}: {outcome} {time.time() - start:.1f}s", flush=True)
