"""Tables that change by partition: a change rewrites the partitions that it touches and leaves all other files as they are.

Rows lie below ``data/v=<version>/_part=<value>``; a commit is one small table of (part, version) below ``_commits/c-<number>``, whose
folder can only be made once. Readers take the rows that the last commit names, so a change is seen as a whole or not at all; of two
changes that start from the same commit one fails. Spark prunes folders by the commit's rows; old versions stay until the table is cleaned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "commit long, part string, version string, schema string"


class ConcurrentChange(RuntimeError):
    """Another change was committed first."""


def _last(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    commits = spark.read.schema(_COMMITS).json(f"{path}/_commits/*")
    n = commits.agg(F.max("commit")).first()[0]
    return n, commits.where(F.col("commit") == n)


def _rows(spark: SparkSession, path: str, live: DataFrame) -> DataFrame:
    schema = live.agg(F.max("schema")).first()[0]
    df = spark.read.schema(f"{schema}, v string, _part string").option("basePath", f"{path}/data").parquet(f"{path}/data")
    named = live.where("part is not null").select(F.col("part").alias("_part"), F.col("version").alias("v"))
    return df.join(F.broadcast(named) if named.count() < 100_000 else named, ["v", "_part"], "left_semi").drop("v")


def _write(df: DataFrame, path: str, by: str) -> tuple[str, str]:
    version = uuid.uuid4().hex
    part = F.concat(F.lit("p-"), F.coalesce(F.col(by).cast("string"), F.lit("")))  # never digits alone, which would come back as numbers
    df.withColumn("_part", part).repartition("_part", F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.partitionBy("_part").parquet(f"{path}/data/v=v-{version}")
    return f"v-{version}", ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _commit(spark: SparkSession, path: str, n: int, rows: DataFrame, schema: str) -> None:
    always = spark.createDataFrame([(None, None)], "part string, version string")  # carries the schema of a table without rows
    out = rows.select("part", "version").unionByName(always).select(F.lit(n).cast("long").alias("commit"), "part", "version", F.lit(schema).alias("schema"))
    try:
        out.coalesce(1).write.mode("errorifexists").json(f"{path}/_commits/c-{n}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise ConcurrentChange(f"commit {n} of {path} was made by another change") from e
        raise


def _written(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(part, version) of a version's folders."""
    parts = spark.read.schema("_part string").option("basePath", f"{path}/data/v={version}").parquet(f"{path}/data/v={version}").select(F.col("_part").alias("part")).distinct()
    return parts.withColumn("version", F.lit(version))


def create_table(df: DataFrame, path: str, by: str) -> None:
    """Writes ``df`` as a table in partitions of the values of ``by``."""
    version, schema = _write(df, path, by)
    _commit(df.sparkSession, path, 0, _written(df.sparkSession, path, version), schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, _last(spark, path)[1]).drop("_part")


def change_table(spark: SparkSession, path: str, by: str, keys: DataFrame, on: Sequence[str], change: Callable[[DataFrame], DataFrame]) -> int:
    """Applies ``change`` to the partitions with rows that ``keys`` meets by the columns ``on``; their number.

    ``change`` gets all rows of these partitions and returns them with the same columns; a row must not leave its partition.
    """
    n, live = _last(spark, path)
    rows = _rows(spark, path, live)
    touched = rows.join(keys.select(*on).distinct(), list(on), "left_semi").select("_part").distinct()
    touched = spark.createDataFrame([(r[0],) for r in touched.collect()], "_part string")  # names of partitions, as the commit has them
    count = touched.count()
    if not count:
        return 0
    new = change(rows.join(F.broadcast(touched), "_part", "left_semi").drop("_part"))
    version, schema = _write(new, path, by)
    kept = live.where("part is not null").join(touched.withColumnRenamed("_part", "part"), "part", "left_anti").select("part", "version")
    made = _written(spark, path, version)
    if made.join(touched.withColumnRenamed("_part", "part"), "part", "left_anti").take(1):
        raise ValueError("the change moved rows to partitions that it doesn't touch")
    _commit(spark, path, n + 1, kept.unionByName(made), schema)
    return count
