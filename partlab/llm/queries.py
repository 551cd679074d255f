"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_formatting, decontamination, language_id, license_scan, lz_fingerprint, minmax_dedup, sentencepiece_codec, sharding, toxicity, url_filters
from .common import table

URL_RULES = [
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
]
SHARDS, SHARD_SLOTS = [f"shard-{i:02d}" for i in range(32)], 5003


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; every operator takes the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.groups(table(spark, sf_dir, "documents"), 85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.preference_digest(table(spark, sf_dir, "conversations"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id"), SHARDS, SHARD_SLOTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_minhash": op4_minhash,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_license_scans": op8_license_scans,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_formatting": chat_formatting.oracle(),
    "op8_license_scans": license_scan.oracle(),
    "op10_sharding": sharding.oracle(SHARDS, SHARD_SLOTS, "documents", "doc_id"),
}
