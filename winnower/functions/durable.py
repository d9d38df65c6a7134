"""Intermediate results on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate results, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; elsewhere its lack is an error,
    since a folder of one machine is of no use to the others.
    """
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
