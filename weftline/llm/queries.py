"""The operators applied to their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, media, mixing, packing, quality, secret_scan, sharding, simhash, token_counts, topk
from weftline.llm.tables import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.pictures(table(spark, sf_dir, "documents"))
    return media.tiles(made, "doc_id", F.col("media"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.of_documents(table(spark, sf_dir, "documents"), carry=["doc_id", "lang"])
    return found.withColumnRenamed("lang", "declared")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % topk.EVERY == 0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.of_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_source_mixing, op2_media_tiles, op3_token_counts, op4_best_fit_packing, op5_secret_scan, op6_simhash_dedup, op7_language_id, op8_exact_top_k, op9_quality_classifier, op10_sharding, language_id_pages)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": mixing.ORACLE_SQL, "op6_simhash_dedup": simhash.ORACLE_SQL, "op8_exact_top_k": topk.ORACLE_SQL}
