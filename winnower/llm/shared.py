"""Helpers of the operators: shared storage, bounded broadcasts, learned-row rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions.durable import checkpoint_root, settle

__all__ = ["checkpoint_root", "crc_remainder", "few", "free_name", "is_small", "pick", "read", "settle", "shared_path", "small_batches"]


BATCH_BYTES, SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: str = "2m") -> None:
    """Bounds the bytes of Arrow batches, so that texts don't pile up in Python workers, unless the session has a bound of its own.

    Spark reads the setting when a query runs, so it stays for the session; one that the caller set is never touched.
    """
    if spark.conf.get(BATCH_BYTES) == SPARK_DEFAULT:
        spark.conf.set(BATCH_BYTES, most)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as make it none of the columns'."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def is_small(keys: DataFrame, most_bytes: int = 16 << 20) -> bool:
    """Whether written-out keys of a few numbers each were counted and take at most so many bytes as a broadcast."""
    return keys.count() * 16 * (1 + len(keys.columns)) <= most_bytes


def few(keys: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Written-out keys, marked for broadcast if they are small."""
    return F.broadcast(keys) if is_small(keys, most_bytes) else keys


def pick(docs: DataFrame, ids: DataFrame, how: str = "left_semi", most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among the ids (``left_anti``: is not), in the one column of ``ids``.

    Up to ``most_bytes`` of ids (half a million) are broadcast, so that no text is shuffled; beyond it a shuffle join does.
    """
    ids = few(settle(ids.toDF("_id").distinct()), most_bytes)
    return docs.join(ids, docs.doc_id == ids["_id"], how)
