"""A corpus cleaned, mixed and packed: each stage reads what its predecessor wrote as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlglass.llm import language_id, line_dedup, minhash, mixing, packing
from crawlglass.llm.shipping import ship
from crawlglass.storage import new_path


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words mostly belong to one language; the model learns from all labelled documents."""
    ship(spark)
    return language_id.accepted(docs, language_id.train(docs))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals; emptied documents go."""
    ship(spark)
    return line_dedup.without_duplicate_lines(docs)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    ship(spark)
    return minhash.without_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mixture."""
    return mixing.in_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences, which follow the order of the mixture."""
    ship(spark)
    return packing.pack_mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_filter", language_filter),
    ("line_filter", line_filter),
    ("near_duplicate_filter", near_duplicate_filter),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

# Tokenizing and expectation-maximisation are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
