"""The registered queries of the corpus operators and, where SQL can express them, their SQL for DuckDB.

Every query applies its operator, with production parameters, to the whole table it is meant for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe_pieces, clustering, compaction, decontaminate, hyperminhash, jaccard, nearest, personal_data, resampling, substring_dedup, token_store, toxicity, url_filter
from folioflow.llm.common import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_in_documents(_read(spark, sf_dir, "documents"))


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compaction.compacted(_read(spark, sf_dir, "documents"), shared_dir(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return url_filter.judge(_read(spark, sf_dir, "pages"), labels)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), digest=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_read(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_pieces.encode_documents(_read(spark, sf_dir, "documents"), digest=True)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(_read(spark, sf_dir, "embeddings"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hyperminhash.links(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_personal_data, op2_compaction, op3_decontaminate, op4_url_filter, op5_substring_dedup, op6_toxicity, op7_jaccard_join, op8_token_store, op9_byte_bpe, op10_nearest, op11_resampling, op12_clustering, op13_hyperminhash)}


def oracle_sql() -> dict[str, str]:
    return {"op2_compaction": compaction.SQL, "op5_substring_dedup": substring_dedup.SQL, "op7_jaccard_join": jaccard.SQL, "op11_resampling": resampling.SQL, "op12_clustering": clustering.SQL, "op13_hyperminhash": hyperminhash.SQL}
