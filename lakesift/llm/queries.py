"""The registered queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import bpe, decontaminate, html_wrapper, line_dedup, masked_lm, ngram_join, quality_model, quality_rules, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(_table(spark, sf_dir, "documents"), keep=[]))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "fit_rows")


def base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can express."""
    stats = quality_rules.statistics(_table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("base_failed", quality_rules.base_failed())
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_texts(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality_rules, base_statistics, op3_ngram_jaccard, op4_decontamination, op5_byte_bpe, op6_masked_lm, op7_line_dedup, op8_toxicity, op9_quality, op10_html_wrapper)}


def oracle_sql() -> dict[str, str]:
    return {"base_statistics": quality_rules.BASE, "op3_ngram_jaccard": ngram_join.ORACLE, "op4_decontamination": decontaminate.ORACLE, "op7_line_dedup": line_dedup.ORACLE}
