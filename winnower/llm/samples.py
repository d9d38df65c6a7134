"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.llm.shared import settle


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, parts: int = 8) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``rows`` labelled documents, written to the shared folder.

    ``learn`` is a condition on doc_id. The rows are those of least hash of doc_id, so that the choice is
    the same in every run and independent of partitions. A document labelled more than once has its
    largest label, one with several texts the least of them. Their number bounds the broadcast. ``fold`` is an even number from 0 to 99.
    """
    known = labels.where(F.col(label).isNotNull() & learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return settle(joined.select("doc_id", "text", "label", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(100)).cast("int").alias("fold")).repartition(parts, "doc_id"))
