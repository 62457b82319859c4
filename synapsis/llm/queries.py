"""The ten queries of this folder, as the driver runs them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, mixing, mpeg, oracle, quality, secrets, simhash, substring, token_counts, warc
from .common import Scratch

TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as MPEG audio and read back."""
    stored = mpeg.store_texts(_table(spark, sf_dir, "documents"))
    return mpeg.read_back(stored, ["doc_id", "n_bytes"])


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, digests and sizes of the metadata and conversion records of every page."""
    out = warc.page_derivatives(_table(spark, sf_dir, "pages"))
    return out.select(
        "page_id", "response_id", "target_uri", "payload_digest", "source_block_digest", "metadata_id", "conversion_id", "title", "n_links",
        F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.sha2("metadata", 256).alias("metadata_sha256"), F.sha2("conversion", 256).alias("conversion_sha256"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once 20-word windows seen earlier are removed."""
    out = substring.remove_repeated_words(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document once 200-byte strings seen elsewhere are removed."""
    out = substring.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    out = quality.repetition(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, against a ledger: the one kept in ``synapsis.secrets.ledger``, else a new one."""
    ledger = secrets.Ledger(spark, spark.conf.get("synapsis.secrets.ledger", None) or Scratch(spark, "secrets").root)
    found, _ = ledger.scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [secrets.count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(True), 256).alias("base_sha256"), secrets.listed(False).alias("spans"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_media_columns, op3_warc_derivatives, op4_substring_dedup, op5_suffix_array_dedup,
        op6_quality_rules, op7_token_counts, op8_bpe_round_trip, op9_secret_scans, op10_source_mixing,
    )
}
ORACLE_SQL = oracle.ORACLE_SQL
