"""A corpus pipeline of five stages over ``documents``: filter by quality, drop repeated lines, keep one of each group
of near duplicates, drop leaks of the benchmark, mix the sources.

Each stage gets the Parquet rows that the one before kept and returns the columns of ``documents``; the last
returns the mix. Null texts are treated as the operators say; a document whose text becomes empty
by line dedup is a copy of others and goes, one that was empty before stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import decontaminate, line_dedup, mixing, near_dedup, quality_model
from winnower.llm.shared import pick, read, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, threshold=0.3).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that other documents, or they themselves, have before."""
    out = line_dedup.remove_repeated_chunks(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    docs = docs.select(*COLUMNS)
    groups = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    return pick(docs, groups.where("not kept").select("doc_id"), "left_anti").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.find_leaks(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return pick(docs, found.select("doc_id"), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: how often each document is taken, with its size and its source's target."""
    quality = F.col("quality")
    weights = read(spark, sf_dir, "labels").select("doc_id", F.when(quality == 1, 2.0).when(quality == 0, 0.5).otherwise(1.0).alias("weight"))
    return mixing.mix_sources(docs.select("doc_id", "text", "source"), weights)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mix", mix)]

#: The classifier and the alignments can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
