"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encaje.llm import (
    codes, decontamination, html, licenses, lm, minhash, packing, quality, secrets, sharding, suffixes,
    toxicity, trie)
from encaje.llm.common import read
from encaje.session import written

PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), cache_bytes=160 << 20).select(*PIECE)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "anomaly")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placement(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "size", "text_crc32", "'key' AS law", "shard", "slot", "grown_shard")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(read(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_nodes(read(spark, sf_dir, "conversations"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(read(spark, sf_dir, "embeddings"))
    return codes.with_label_error(written(coded, "vector-codes")).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_packing, op2_quality, op3_toxicity, op4_html, op5_secrets, op6_sharding,
        op7_decontamination, op8_minhash, op9_licenses, op10_suffixes,
        op11_trie, op12_codes, op13_lm)}
