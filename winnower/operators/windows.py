"""Ranks, running values and a distributed global rank (W-01 to W-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnower.functions.durable import settle
from winnower.functions.exprs import ratio
from winnower.operators.scans import ranged, scan, with_halo


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Numbers all rows from 0 in the order of unique columns, without one task that sees them all.

    Rows are dealt to sorted ranges; ranks run inside each range and start after the rows of the ranges before,
    of which there is one number each. Ranges follow values, so equal keys must be few.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))  # the ranges must not be drawn twice
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def keep_best(groups: DataFrame) -> DataFrame:
    """From item_id, cluster_id, kind, image_path, file_size, width, height: action keep for one of a group, remove for the others."""
    score = F.when(F.col("kind") == "similar", F.col("file_size") + 0.001 * F.col("width") * F.col("height")).otherwise(0.0)
    best = F.row_number().over(W.partitionBy("cluster_id").orderBy(score.desc(), "image_path"))
    return groups.withColumn("action", F.when((best == 1) | (F.col("kind") == "singleton"), "keep").otherwise("remove"))


def keep_best_scored(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Score of size, pixels, name and closeness to the centroid of the cluster's vectors; the best is kept."""
    m = members.join(vectors.select("item_id", "embedding"), "item_id", "left")
    parts = m.where("embedding is not null").select("cluster_id", F.posexplode("embedding").alias("k", "x")).groupBy("cluster_id", "k").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    centre = parts.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centre"), F.max("n").alias("n"))
    m = m.join(centre, "cluster_id", "left")
    gap = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    near = F.when(F.col("n") >= 2, 0.5 * (1 - F.least(gap, F.lit(1.0)))).otherwise(0.0)
    marked = F.lower("filename").rlike(r"copy|duplicate|\(1\)")
    score = 0.2 * F.least(F.col("file_size") / 1048576, F.lit(10.0)) + 0.3 * F.least(F.col("width") * F.col("height") / 1e6, F.lit(50.0)) - F.when(marked, 2.0).otherwise(0.0) + F.coalesce(near, F.lit(0.0))
    m = m.withColumn("score", F.round(score, 9))
    best = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("score"), "item_id"))
    return m.select("cluster_id", "item_id", "score", F.when(best == 1, "keep").otherwise("remove").alias("action"))


def keep_medoid(pairs: DataFrame, members: DataFrame, identical: float = 0.95, near: float = 0.90) -> DataFrame:
    """From pairs (cluster_id, a, b, similarity) and members (item_id, file_size): the item of highest mean similarity is kept."""
    both = pairs.select("cluster_id", F.explode(F.array("a", "b")).alias("item_id"), "similarity")  # not a union: the pairs are made once
    means = both.groupBy("cluster_id", "item_id").agg(F.avg("similarity").alias("mean"))
    return keep_medoid_of_means(means, pairs.groupBy("cluster_id").agg(F.max("similarity").alias("most")), members, identical, near)


def keep_medoid_of_means(means: DataFrame, most: DataFrame, members: DataFrame, identical: float = 0.95, near: float = 0.90) -> DataFrame:
    """The same from each item's mean similarity (cluster_id, item_id, mean) and each cluster's largest (cluster_id, most).

    The item to keep is the largest of a struct, so that a cluster is aggregated in parts and no window sees it whole.
    """
    rows = means.select("cluster_id", "item_id", F.round("mean", 9).alias("mean")).join(members, "item_id")
    rows = rows.withColumn("_rank", F.struct("mean", "file_size", (-F.col("item_id")).alias("i")))
    best = rows.groupBy("cluster_id").agg(F.max("_rank").alias("_best")).join(most, "cluster_id")
    action = F.when(F.col("most") <= near, "review").when(F.col("_rank").eqNullSafe(F.col("_best")), "keep").when(F.col("most") > identical, "remove").otherwise("review")
    return rows.join(best, "cluster_id").select("cluster_id", "item_id", "mean", action.alias("action"))


def prune_checkpoints(checkpoints: DataFrame, n: int = 5) -> DataFrame:
    """The checkpoints beyond the n newest of their session."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")))
    return checkpoints.withColumn("age", rank).where(F.col("age") > n)


def assign_folders(approved: DataFrame, per: int = 200, order: Sequence[str] = ("image_path", "item_id")) -> DataFrame:
    return global_rank(approved, order, "k").withColumn("folder", (F.floor(F.col("k") / per) + 1).cast("long")).drop("k")


def assign_subfolders(approved: DataFrame, per: int = 200, parent: str = "source_folder", most_broadcast: int = 100_000) -> DataFrame:
    """The parent itself up to ``per`` items, else numbered batches of it; a large parent is spread over many tasks.

    Only parents of more than ``per`` items have a row of their own. They are counted: up to ``most_broadcast`` are broadcast, more meet the items in a shuffle join.
    """
    ranked = global_rank(approved, (parent, "image_path", "item_id"), "_k")
    large = settle(ranked.groupBy(F.col(parent).alias("_parent")).agg(F.min("_k").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > per).drop("_n"))
    near = F.broadcast(large) if large.count() <= most_broadcast else large
    df = ranked.join(near, F.col(parent).eqNullSafe(F.col("_parent")), "left")
    batch = (F.floor((F.col("_k") - F.col("_first")) / per) + 1).cast("int")
    return df.withColumn("folder", F.when(F.col("_first").isNull(), F.col(parent)).otherwise(F.format_string("%s_batch_%03d", F.col(parent), batch))).drop("_k", "_parent", "_first")


def resolve_names(items: DataFrame, folder: str = "folder") -> DataFrame:
    """new_name, unique in its folder: the first keeps the name, others get _1, _2 …; repeated until no generated name collides."""
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    names = F.row_number().over(W.partitionBy(folder, "filename").orderBy("item_id")) - 1
    made = lambda k: F.when(k == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("_"), k.cast("string"), ext))
    df = items.withColumn("_k", names).withColumn("new_name", made(F.col("_k")))
    while True:  # ends: generated names collide with given ones only, and their numbers grow
        again = F.row_number().over(W.partitionBy(folder, "new_name").orderBy(F.when(F.col("new_name") == F.col("filename"), 0).otherwise(1), "item_id"))
        df = df.withColumn("_again", again)
        if not df.where("_again > 1").take(1):
            break
        most = F.max("_k").over(W.partitionBy(folder, "filename"))
        extra = F.row_number().over(W.partitionBy(folder, "filename").orderBy((F.col("_again") > 1).desc(), "item_id"))
        df = df.withColumn("_k", F.when(F.col("_again") > 1, most + extra).otherwise(F.col("_k"))).withColumn("new_name", made(F.col("_k")))
        df = settle(df)
    return df.drop("_k", "_again")


_ORDER = ("ts", "event_id")


def running_totals(progress: DataFrame, partitions: int | None = None) -> DataFrame:
    """Counts so far of each event's session; a session of any size is spread over ranges of time."""
    n = lambda d: F.when(F.col("decision") == d, 1).otherwise(0)
    dealt = ranged(progress, "session_id", _ORDER, partitions)
    df = scan(dealt, "session_id", _ORDER, {"processed": F.lit(1), "approved": n("approved"), "rejected": n("rejected")}, whole={"of": (F.count("*"), F.sum)})
    return df.withColumns({"percentage": 100 * F.col("processed") / F.col("of"), "approve_rate": ratio(F.col("approved"), F.col("processed"))}).drop("_part")


def moving_speed(progress: DataFrame, n: int = 10, partitions: int | None = None, chunk: int = 65536) -> DataFrame:
    """Mean of the last n values of 1 / Δt in seconds, values of Δt = 0 left out; time left at that speed.

    Events get their rank among the timed ones of their session from two scans, and are dealt to chunks of ranks for the mean.
    """
    dealt = ranged(progress.select("event_id", "session_id", "ts"), "session_id", _ORDER, partitions)
    first = scan(dealt, "session_id", _ORDER, {"processed": F.lit(1)}, {"before": "ts"}, {"of": (F.count("*"), F.sum)})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = settle(first.withColumn("dt", (micros("ts") - micros("before")) / 1e6).where("dt > 0"))
    ranked = with_halo(scan(timed, "session_id", _ORDER, {"_rank": F.lit(1)}), "session_id", "_rank", n - 1, chunk)
    w = W.partitionBy("session_id", "_chunk").orderBy("_rank").rowsBetween(-(n - 1), 0)
    out = ranked.withColumn("speed", F.avg(1 / F.col("dt")).over(w)).where("not _halo")
    return out.select("event_id", "session_id", "ts", "speed", ((F.col("of") - F.col("processed")) / F.col("speed")).alias("eta"))


#: Progress marks.
PERCENTS, COUNTS = (25, 50, 75, 90), (100, 500, 1000, 5000, 10000, 25000)


def due_milestones(processed: Column, total: Column, hours: Column) -> Column:
    """All marks that a state has passed: array of keys."""
    marks = [F.when(processed * 100 >= total * p, F.lit(f"percent_{p}")) for p in PERCENTS] + [F.when(processed >= c, F.lit(f"count_{c}")) for c in COUNTS]
    hourly = F.transform(F.when(hours >= 1, F.sequence(F.lit(1), hours)).otherwise(F.array().cast("array<int>")), lambda h: F.concat(F.lit("hour_"), h.cast("string")))
    return F.concat(F.array_compact(F.array(*marks)), hourly)


def milestones(progress: DataFrame, partitions: int | None = None) -> DataFrame:
    """The first event at which a session passes each mark."""
    dealt = ranged(progress.select("event_id", "session_id", "ts"), "session_id", _ORDER, partitions)
    df = scan(dealt, "session_id", _ORDER, {"k": F.lit(1)}, {"before": "ts"}, {"n": (F.count("*"), F.sum), "start": (F.min("ts"), F.min)})
    hours = lambda t: F.floor((F.unix_timestamp(t) - F.unix_timestamp("start")) / 3600).cast("int")
    new_hours = F.transform(F.when(hours("ts") > F.coalesce(hours("before"), F.lit(0)), F.sequence(F.coalesce(hours("before"), F.lit(0)) + 1, hours("ts"))).otherwise(F.array().cast("array<int>")), lambda h: F.concat(F.lit("hour_"), h.cast("string")))
    fresh = lambda now, before, key: F.when(now & ~before, F.lit(key))
    k, n = F.col("k"), F.col("n")
    marks = [fresh(k * 100 >= n * p, (k - 1) * 100 >= n * p, f"percent_{p}") for p in PERCENTS] + [fresh(k == c, F.lit(False), f"count_{c}") for c in COUNTS]
    return df.select("session_id", "event_id", "ts", F.explode(F.concat(F.array_compact(F.array(*marks)), new_hours)).alias("milestone"))


def last_n(df: DataFrame, n: int, key: str = "session_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    return df.withColumn("_age", F.row_number().over(W.partitionBy(key).orderBy(F.desc(time), F.desc(tie)))).where(F.col("_age") <= n).drop("_age")


def batch_index(items: DataFrame, size: int, order: Sequence[str] = ("image_path", "item_id")) -> DataFrame:
    return global_rank(items, order, "i").withColumns({"batch": F.floor(F.col("i") / size).cast("long"), "offset": F.col("i") % size})


def current_counters(progress: DataFrame, now: Column) -> DataFrame:
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    df = progress.groupBy("session_id").agg(F.count("*").alias("processed"), (F.unix_timestamp(now) - F.unix_timestamp(F.min("ts"))).alias("elapsed"), last.alias("last"))
    return df.select("session_id", "processed", ratio(F.col("processed"), F.col("elapsed")).alias("rate"), F.col("last.event_id").alias("last_event"), F.col("last.event_type").alias("last_type"))
