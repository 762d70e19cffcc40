"""Registered queries of this subpackage, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlglass.llm import (
    id_coder, language_id, line_dedup, minhash, mixing, packing, passage_quality, phrases, prefix_trie, substring_dedup, url_filter,
    vp_search, weak_quality,
)
from crawlglass.llm.queries import ORACLES
from crawlglass.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int) -> Column:
    """Remainder of the crc32 of the id's digits."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


@query
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(fold(4) != 2))
    found = language_id.identify(docs, model)
    return found.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))


@query
def op2_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_coder.token_ids(table(spark, sf_dir, "documents"))


@query
def op3_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.judge(table(spark, sf_dir, "documents"))


@query
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", *mixing.PLAN)


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_duplicates(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = passage_quality.train(docs, labels.filter(fold(3) != 1))
    return passage_quality.score(docs, model).withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False)))


@query
def op9_deletion_neighbourhood_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


@query
def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))
