"""Queries of the pipeline operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsim.llm import ann, langid, mixing, ngram_join, packing, quality, secrets, sharding, topk, url_filter
from procsim.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, width=5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", F.col("_bad").alias("bad_score"), F.col("_label").alias("label_score"), F.col("_keep").alias("keep"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    out = url_filter.filter_urls(table(spark, sf_dir, "pages"), bad)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", F.round("bad_share", 9).alias("bad_share"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


__all__ = ["ORACLES", "QUERIES", "table", "tokenizer_path"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_ngram_join": op4_ngram_join,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_langid": op9_langid,
    "op10_secrets": op10_secrets,
}
