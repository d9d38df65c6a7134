"""Running values of sessions of any size against plain windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnower.operators import scans
from winnower.operators import windows as O


def events(spark, n=6000):
    """Half of the events are of session 1; the seventh of every ten has the time of the one before."""
    session = F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 500 == 1, None).otherwise(F.col("id") % 40)
    ts = (F.lit(1_700_000_000) + F.floor(F.col("id") / 20) * 60 + F.when(F.col("id") % 20 < 14, F.col("id") % 20).otherwise(13)).cast("timestamp")
    decision = F.when(F.col("id") % 3 == 0, "approved").when(F.col("id") % 3 == 1, "rejected")
    return spark.range(n).select(F.col("id").alias("event_id"), session.cast("long").alias("session_id"), ts.alias("ts"), decision.alias("decision"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_a_hot_session_is_spread(spark):
    dealt = scans.ranged(events(spark), "session_id", ("ts", "event_id"), 48)
    assert dealt.where("session_id = 1").select("_part").distinct().count() >= 20
    assert dealt.groupBy("_part").count().agg(F.max("count")).first()[0] < 6000 / 10


def test_running_totals(spark):
    e = events(spark)
    w = W.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    want = e.select("event_id", F.count("*").over(w), F.sum((F.col("decision") == "approved").cast("int")).over(w), F.count("*").over(W.partitionBy("session_id")))
    got = O.running_totals(e, partitions=48).select("event_id", "processed", "approved", "of")
    assert [r[:2] + r[3:] for r in rows(got)] == [r[:2] + r[3:] for r in rows(want)]
    assert {r[0]: r[2] or 0 for r in rows(got)} == {r[0]: r[2] or 0 for r in rows(want)}


def test_moving_speed(spark):
    e = events(spark)
    w = W.partitionBy("session_id").orderBy("ts", "event_id")
    timed = e.withColumn("dt", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6).where("dt > 0")
    want = timed.select("event_id", F.round(F.avg(1 / F.col("dt")).over(w.rowsBetween(-9, 0)), 9))
    got = O.moving_speed(e, partitions=48, chunk=64).select("event_id", F.round("speed", 9))
    assert rows(got) == rows(want)


def test_milestones_once_each(spark):
    got = O.milestones(events(spark), partitions=48)
    assert got.groupBy("session_id", "milestone").count().where("count > 1").count() == 0
    first = got.where("session_id = 1 and milestone = 'count_500'").first()
    w = W.partitionBy("session_id").orderBy("ts", "event_id")
    assert first.event_id == events(spark).withColumn("k", F.row_number().over(w)).where("session_id = 1 and k = 500").first().event_id
    assert O.milestones(events(spark).where("false")).count() == O.moving_speed(events(spark).where("false")).count() == 0


def test_subfolders_by_broadcast_and_by_shuffle(spark):
    """Large, exactly full and small folders, and items without one."""
    sizes = {"large": 11, "full": 4, "small": 1, None: 6}
    rows = [(f"{f}-{k:02}", f"/{k:02}", f) for f, n in sizes.items() for k in range(n)]
    items = spark.createDataFrame(rows, "item_id string, image_path string, source_folder string")
    name = lambda f, k: f if sizes[f] <= 4 else f"{'null' if f is None else f}_batch_{k // 4 + 1:03}"
    want = {i: name(f, int(p[1:])) for i, p, f in rows}
    for most in (100_000, 0):
        got = O.assign_subfolders(items, 4, most_broadcast=most)
        assert got.columns == [*items.columns, "folder"] and {r.item_id: r.folder for r in got.collect()} == want
        assert got.count() == len(rows)
    assert O.assign_subfolders(items.limit(0), 4).collect() == []
