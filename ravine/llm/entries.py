"""The corpus operators' queries: each reads its whole table and returns a digest of its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravine.llm import conversation_repair, decontaminate, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, prefix_trie, simhash, substring_dedup, suffix_array, token_counts, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and chunk counts of every document, and the MD5 of the text that is kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).withColumn("kept_md5", F.md5("text")).drop("text")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links and component."""
    return embedding_dedup.embedding_components(_table(spark, sf_dir, "embeddings"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores under models of the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(5) == 1, F.lit(False)))
    model = lm_scoring.train(docs.where(~F.col("held_out")))
    return lm_scoring.score(docs.select("doc_id", "held_out", "text"), model)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated paragraph that goes, with the one that stays for it."""
    return substring_dedup.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages of the benchmark, with how much of it."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of every document, and the SHA-256 of what is kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_array.remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the conversations, rebuilt with shared beginnings."""
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and its cheapest repair."""
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(conversations), conversations.select("conv_id").distinct())


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_url_filters": op13_url_filters,
}

#: DuckDB SQL for the queries that it can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op4_mix_sources": mixing.ORACLE_SQL,
    "op11_conversation_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_url_filters": url_filters.ORACLE_SQL,
}
