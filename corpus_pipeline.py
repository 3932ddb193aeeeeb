"""A training-text pipeline of five stages over ``documents``, each written and read again before the next.

Rejected by quality rules: dropped. Repeated lines: removed, and the document with them where nothing else is left.
Near copies: the first document of each group stays. Benchmark passages: the document is dropped. What remains is
encoded and decoded again. A document that meets no rule passes every stage with its text unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tunefathom.llm import bpe, decontamination, jaccard_join, line_dedup, quality_rules
from tunefathom.session import apply_defaults, work_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(docs).filter("kept").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose lines get a new text and ``n_chars``; those left without a word are dropped."""
    cut = line_dedup.dedup_lines(docs)
    changed = F.size("removed") > 0
    kept = cut.filter(~changed | F.col("text").rlike(quality_rules.WORD))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, n=5, a=80, b=100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), columns).select("doc_id", *columns)


STAGES = [
    ("quality_rules", good_quality),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: The encoding has no form in SQL; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result lies as Parquet in the shared folder."""
    apply_defaults(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
