"""Bounded samples of labelled texts for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(key: Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``per_class`` documents of each class, those of lowest hash.

    ``train`` is a condition on ``doc_id``. The chosen ids are at most ``2 * per_class`` rows, so they are broadcast
    and the documents are filtered where they are read.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(train).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.length("text") > 0)
