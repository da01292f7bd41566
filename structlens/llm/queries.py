"""The opN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, lines, minhash, mixing, oracles, quality, secrets, sharding, simhash, substring, turns, url_filter, warc

RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; listed are the URLs of the pages whose id is divisible by 100."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where("page_id % 100 = 0").select("url")
    return url_filter.filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store's newest version holds of each document, and whether its shard keeps to the target size."""
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "text_sha256", (F.col("shard_bytes") <= sharding.TARGET_BYTES).alias("in_target"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return turns.audit(conversations, turns.damage(conversations))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_mixing, op3_url_filter, op4_sharding, op5_quality, op6_secrets, op7_substring_dedup, op8_minhash, op9_warc, op10_line_dedup, op11_conversation_repair, op12_simhash, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
