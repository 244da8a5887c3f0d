"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, exact_topk, jaccard_join, language_id, lexical, licenses, line_crf, mixing, quality_rules, sharding, suffix_dedup, token_counts
from .common import table

TOKEN_LIMIT, TOP_K, QUERY_EVERY, SHARDS, RANKS = 1024, 20, 20, 24, 10
COUNT_FILE, CODE_FILE, PIECE_FILE = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.token_counts(docs, public_tokenizers.path(COUNT_FILE), TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, kept_as="").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n_gram=3, num=90, den=100)


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.classify(docs, field).select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed", "lost_chars")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(table(spark, sf_dir, "documents"))
    return language_id.identify(table(spark, sf_dir, "pages"), model)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), TOP_K)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.digest_documents(docs, public_tokenizers.path(CODE_FILE), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_documents(docs, public_tokenizers.path(COUNT_FILE), public_tokenizers.path(PIECE_FILE))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *sharding.sizes(F.col("text")))
    return sharding.shard_rows(docs, SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), RANKS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
