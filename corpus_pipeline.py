"""Corpus pipeline: five stages over ``documents``, each written as Parquet before the next reads it.

All stages read whole texts of any length, keep columns they don't know, and give no rows for an empty table. Null and empty
texts have under 50 words, so the first stage drops them; the others would keep them. Rows without a doc_id pass the
stages that compare documents unchanged. Repeated rows are judged alike; the third stage keeps one of each doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesift.llm import bpe, common, decontaminate, line_dedup, ngram_join, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go; null languages and sources are groups of their own."""
    return quality_rules.quality_rules(docs).filter("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and so does a document that has no word left."""
    out = line_dedup.line_dedup(docs)
    return out.filter(~((F.col("n_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays, that with the least doc_id."""
    return ngram_join.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty items are in none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; the digest of what they decode to shows that nothing was lost."""
    out = bpe.encode_documents(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark_leaks), ("byte_bpe", encode)]

#: The outlier test and the encoding can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir))
    return docs
