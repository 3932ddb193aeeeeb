"""The training-text operators on the driver tables, with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tunefathom.llm import (
    bpe, decontamination, importance_resampling, jaccard_join, line_dedup, quality_cnn, quality_rules, records, sharding, source_divergence, suffix_dedup,
    toxicity, url_templates,
)
from tunefathom.llm.sample import fold, labelled_sample
from tunefathom.queries.registry import Query
from tunefathom.session import apply_defaults

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, folder) under ``name``."""
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_defaults(spark)
            return build(spark, folder)
        QUERIES[name] = Query(name, run, sql)
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op6_quality_rules", quality_rules.sql())
def op6(spark, folder):
    judged = quality_rules.quality_rules(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_sharding", sharding.sql())
def op4(spark, folder):
    return sharding.assign_shards(table(spark, folder, "documents"), "doc_id").select("doc_id", "slot", "shard")


@query("op9_bpe")
def op9(spark, folder):
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), columns).select("doc_id", *columns)


@query("op10_token_records")
def op10(spark, folder):
    return records.round_trip(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op7_quality_classifier")
def op7(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    sample = labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0, quality_cnn.PER_CLASS)
    scored = quality_cnn.score_texts(docs.select("doc_id", "text"), quality_cnn.train(sample))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_toxicity")
def op8(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_url_templates", url_templates.sql())
def op5(spark, folder):
    judged = url_templates.judge_urls(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


@query("op1_decontamination")
def op1(spark, folder):
    return decontamination.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_line_dedup", line_dedup.sql())
def op2(spark, folder):
    found = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
                        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("op3_jaccard_join", jaccard_join.sql())
def op3(spark, folder):
    return jaccard_join.jaccard_components(table(spark, folder, "documents"), n=3, a=90, b=100)


@query("op11_suffix_dedup", suffix_dedup.sql())
def op11(spark, folder):
    return suffix_dedup.remove_repeated(table(spark, folder, "documents"))


@query("op12_importance_resampling", importance_resampling.sql())
def op12(spark, folder):
    return importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=25, seed=7)


@query("op13_source_divergence", source_divergence.sql())
def op13(spark, folder):
    return source_divergence.source_divergence(table(spark, folder, "documents"))
