"""Running values in the order of time, for keys of any size (W-08, W-09, W-10).

Rows are dealt to ranges of (key, time, tie), so that a key with a third of all rows lies in a third of the ranges. Windows
run within a range and key; what they need from the ranges before is carried over: a range has at most one key that began in an earlier one, so there
is at most one carried row a range, and they are broadcast. The order within a key must be unique.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnower.functions.durable import settle


def ranged(df: DataFrame, key: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` in sorted ranges, written, with the number of its range as ``_part``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()))  # drawn once: ranges hang on a sample


def scan(dealt: DataFrame, key: str, order: Sequence[str], sums: Mapping[str, Column] = {}, before: Mapping[str, str] = {}, whole: Mapping[str, Column] = {}) -> DataFrame:
    """Adds to ranged rows the running sums (inclusive), values of the row before (name: column), and aggregates of the whole key.

    Whole-key aggregates are sums, counts or extremes, added up from one row for each range and key: name to (function of the
    rows, how partial values are combined).
    """
    own = W.partitionBy("_part", key).orderBy(*order)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.withColumns({f"_s_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_b_{n}": F.lag(F.struct(c)).over(own) for n, c in before.items()})
    last = F.max_by(F.struct(*(F.col(c).alias(n) for n, c in before.items())), F.struct(*order)) if before else F.lit(None)
    parts = dealt.groupBy("_part", key).agg(*(F.sum(c).alias(f"_p_{n}") for n, c in sums.items()), last.alias("_last"), F.lit(1).alias("_one"))
    earlier = W.partitionBy(key).orderBy("_part")
    carried = parts.select(
        F.col("_part").alias("_q"), F.col(key).alias("_k"), F.lag("_last").over(earlier).alias("_last"), F.lag("_one").over(earlier).alias("_one"),
        *(F.sum(f"_p_{n}").over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias(f"_c_{n}") for n in sums),
    ).where("_one is not null").drop("_one")
    out = rows.join(F.broadcast(carried), (F.col("_part") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    made = {n: F.col(f"_s_{n}") + F.coalesce(f"_c_{n}", F.lit(0)) for n in sums}
    made |= {n: F.when(F.col(f"_b_{n}").isNotNull(), F.col(f"_b_{n}")[c]).otherwise(F.col(f"_last.{n}")) for n, c in before.items()}
    out = out.withColumns(made).drop("_q", "_k", "_last", *(f"_{a}_{n}" for n in sums for a in "sc"), *(f"_b_{n}" for n in before))
    if not whole:
        return out
    partial = dealt.groupBy("_part", key).agg(*(c.alias(n) for n, (c, _) in whole.items()))
    total = partial.groupBy(F.col(key).alias("_k")).agg(*(f(n).alias(n) for n, (_, f) in whole.items()))
    return out.join(total, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def with_halo(df: DataFrame, key: str, rank: str, n: int, chunk: int = 65536) -> DataFrame:
    """Rows dealt to chunks of a key by their rank (from 1), the last ``n`` of a chunk also to the next one, as ``_chunk`` and ``_halo``.

    A window of the last n + 1 rows within (key, chunk) is then right for every row that isn't halo.
    """
    at = F.floor((F.col(rank) - 1) / chunk)
    into = F.when((F.col(rank) - 1) % chunk >= chunk - n, F.array(at, at + 1)).otherwise(F.array(at))
    return df.withColumn("_chunk", F.explode(into)).withColumn("_halo", F.col("_chunk") > at)
