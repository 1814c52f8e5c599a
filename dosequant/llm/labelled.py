"""Rows to learn from: a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: At most so many labelled documents are learned from, the first by hash of their id.
MAX_TRAINING_ROWS = 20_000


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is kept for evaluation: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAINING_ROWS
) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out third.

    A document with several labels counts with the greatest; rows without an id or
    label are left out, and of several documents with one id the text that sorts first
    is learned from. So there are at most `max_rows` rows. The chosen ids are
    broadcast, and only their texts are shuffled.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
