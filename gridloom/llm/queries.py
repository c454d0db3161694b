"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, language, lexical, line_dedup, media, mixing, ngram_join, quality, secret_scan, sharding, spelling, topk
from gridloom.llm.shared import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), 4, 85, 100)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths are languages within a source."""
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digest(documents(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(documents(spark, sf_dir))


#: The texts of conversation -7, which hold control strings.
HARD = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return chat.conversation_digest(turns.unionByName(added))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_spellings(documents(spark, sf_dir))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


CHAT_SQL = f"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{HARD}'
) {chat.DIGEST_SQL}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_ngram_join, op3_quality_classifier, op4_shard_documents, op5_line_dedup, op6_top_k, op7_bpe_round_trip, op8_secret_scan, op9_media_columns, op10_chat_format, op11_spelling_variants, op12_language_id, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.COMPONENTS_SQL, "op5_line_dedup": line_dedup.DIGEST_SQL, "op6_top_k": topk.TOP_K_SQL, "op8_secret_scan": secret_scan.digest_sql(), "op10_chat_format": CHAT_SQL, "op11_spelling_variants": spelling.SPELLING_SQL, "op12_language_id": language.LANGUAGE_SQL, "op13_lexical_search": lexical.SEARCH_SQL}
