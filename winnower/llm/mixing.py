"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get targets by weight; a target stops at ``max_epochs`` times its source's size and the excess
goes to the others by weight. A source gives every document as many complete times as its target holds,
then a fraction once more: each document draws an exponential key, divided by its quality weight, and the
documents of least keys are taken up to the rest of the budget.

The order within a source is never made in one task. Keys are cut on a logarithmic scale, between the least and
the largest of a source, into ``bins`` equal bins; sizes are added up per bin, and the running sum over bins
finds the one that the budget ends in. Bins below it are taken whole, and it alone is cut finer the same
way, until it is ordered exactly. With two levels of 4096 bins the last step sees about one document in a million
of a source, whatever the size of its weights.

Targets are computed over one row per source, in windows over all of them: sources are collections by name, a
million of them fit in one task.

Defined results: every row of the documents gives one row; a null text has size 0; a null source is a source, ordered last;
a quality weight that is missing, not positive or not finite is 1; rows that repeat are documents of their own and, having
equal keys, are taken in the order of size (rows equal in all of these are interchangeable); a source without words has target 0
and takes each document once; other columns are ignored; an empty table gives no rows.
The keys come from the md5 of ``seed`` and doc_id, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnower.llm.shared import settle


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    budget_percent: int = 100
    max_epochs: int = 3
    bins: int = 4096
    levels: int = 2
    seed: str = ""


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")  # the size of a null hangs on the session


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    Sources in the order of cap by weight: all up to the first whose cap is above the level that the rest
    of the budget gives by weight are full. The windows run over one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": F.element_at(F.array(*(F.lit(float(w)) for w in mix.weights)), (F.col("rank") % len(mix.weights) + 1).cast("int")), "cap": F.col("source_size") * mix.max_epochs})
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * (mix.budget_percent / 100)
    left = ranked.withColumns({"level": (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))})
    left = left.withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    return left.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double"))).alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: str = "") -> Column:
    """Efraimidis-Spirakis: an exponential variate over the weight; small keys go first."""
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 1) / 2.0**52
    return -F.log(draw) / weight


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source per row of ``docs`` (doc_id, text, source).

    ``weights`` (doc_id, weight) has quality weights, the largest counts if a document has several.
    They meet the sizes of the documents, not their texts.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"))
    weight = F.lit(1.0)
    if weights is not None:
        best = weights.groupBy(F.col("doc_id").alias("w_id")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        base = base.join(best, base.doc_id == best.w_id, "left")
        weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(1.0)
    base = base.select("doc_id", "source", "size", sampling_key(F.col("doc_id"), weight, mix.seed).alias("key"))
    # The logarithm never falls as the key grows, so bins of it are ranges of keys.
    base = settle(base.withColumn("place", F.log(F.least(F.greatest("key", F.lit(1e-300)), F.lit(1e300)))))
    ranges = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("place").alias("low"), F.max("place").alias("high"))
    plan = targets(ranges.select("source", "source_size"), mix).join(ranges.select(F.col("source").alias("s"), "low", "high"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("room", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = settle(plan.select("source", "source_size", "target", "epochs", "room", "low", ((F.col("high") - F.col("low")) / mix.bins).alias("step")))

    # Level by level, one row per source: the bin that its budget ends in (none: no bin does), and what is left for it.
    for k in range(mix.levels):
        sums = _marked(base, plan, k, mix).where("more is null").groupBy("source", F.col(f"bin{k}").alias("bin")).agg(F.sum("size").alias("size"))
        upto = sums.withColumn("upto", F.sum("size").over(W.partitionBy("source").orderBy("bin")))
        ended = upto.join(plan.select(F.col("source").alias("s"), "room"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("room"))
        ended = ended.groupBy("s").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"))).alias("x"))
        plan = plan.join(ended, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        plan = plan.withColumns({f"low{k}": F.col("low"), f"step{k}": F.col("step"), f"end{k}": F.col("x.bin"), "room": F.col("room") - F.coalesce("x.before", F.lit(0))})
        plan = settle(plan.withColumns({"low": F.col("low") + F.coalesce("x.bin", F.lit(0)) * F.col("step"), "step": F.col("step") / mix.bins}).drop("x"))
    marked = _marked(base, plan, mix.levels, mix)
    run = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    last = marked.where("more is null").withColumn("more", (F.sum("size").over(run) <= F.col("room")).cast("long"))
    out = marked.where("more is not null").unionByName(last)
    copies = F.col("epochs") + F.col("more")
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"), "source")


def _marked(base: DataFrame, plan: DataFrame, levels: int, mix: Mix) -> DataFrame:
    """The documents with their source's plan, their bin at every level, and more: 1 or 0 if the first ``levels`` levels
    say that the fraction takes them or not, null if they lie in the bin where the budget ends."""
    joined = base.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    more = F.lit(None).cast("long")
    for k in range(levels + 1):
        low, step = (F.col(f"low{k}"), F.col(f"step{k}")) if k < levels else (F.col("low"), F.col("step"))
        at = F.floor((F.col("place") - low) / F.when(step > 0, step))
        joined = joined.withColumn(f"bin{k}", F.coalesce(F.greatest(F.least(at, F.lit(mix.bins - 1)), F.lit(0)), F.lit(0)).cast("long"))
        if k < levels:
            here = F.when(F.col(f"end{k}").isNull() | (F.col(f"bin{k}") < F.col(f"end{k}")), 1).when(F.col(f"bin{k}") > F.col(f"end{k}"), 0)
            more = F.coalesce(more, here)
    return joined.withColumn("more", more.cast("long"))
