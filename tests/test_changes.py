"""Tables that change by partition, committed batches, batches of a user's function, resumption."""

from __future__ import annotations

import glob
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.functions import rules
from winnower.operators import lifecycle as L
from winnower.operators import results as R
from winnower.plans import registry
from winnower.plans.catalog import QUERIES
from winnower.sources import files, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def parquet(path):
    return {f for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def sample(spark, n=40):
    return spark.range(n).select(F.col("id").alias("item_id"), (F.col("id") % 4).alias("session_id"), F.lit("pending").alias("final_decision"))


def test_a_change_leaves_other_files(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_table(sample(spark), path, "session_id")
    before = parquet(path)
    keys = spark.createDataFrame([(1,), (5,)], "item_id long")
    n = tables.change_table(spark, path, "session_id", keys, ["item_id"], lambda d: d.withColumn("final_decision", F.when(F.col("item_id").isin(1, 5), "rejected").otherwise(F.col("final_decision"))))
    assert n == 1 and before <= parquet(path)
    new = parquet(path) - before
    assert new and all("_part=p-1/" in f for f in new)
    got = {r.item_id: r.final_decision for r in tables.read_table(spark, path).collect()}
    assert len(got) == 40 and {i for i, d in got.items() if d == "rejected"} == {1, 5}
    assert tables.change_table(spark, path, "session_id", keys.where("false"), ["item_id"], lambda d: d) == 0
    with pytest.raises(ValueError):
        tables.change_table(spark, path, "session_id", keys, ["item_id"], lambda d: d.withColumn("session_id", F.lit(77).cast("long")))
    assert tables.read_table(spark, path).count() == 40  # the refused change isn't seen


def test_of_two_changes_one_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_table(sample(spark), path, "session_id")
    key = spark.createDataFrame([(1,)], "item_id long")

    def slow(d):
        L.purge_table(spark, path, spark.createDataFrame([(2,)], "id long"))  # another one commits meanwhile
        return d

    with pytest.raises(tables.ConcurrentChange):
        tables.change_table(spark, path, "session_id", key, ["item_id"], slow)
    assert {r.session_id for r in tables.read_table(spark, path).collect()} == {0, 1, 3}


def test_purge_down_to_nothing_and_status(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_table(sample(spark), path, "session_id")
    assert L.purge_table(spark, path, spark.range(4)) == 4
    assert tables.read_table(spark, path).count() == 0
    path = str(tmp_path / "s")
    sessions = spark.createDataFrame([(i, "a" if i < 3 else "b", "running") for i in range(6)], "id long, region string, status string")
    tables.create_table(sessions, path, "region")
    assert L.set_status_table(spark, path, "pause", spark.createDataFrame([(1,), (99,)], "id long"), "region") == 1
    assert {r.id for r in tables.read_table(spark, path).where("status = 'paused'").collect()} == {1}


def test_batches_are_committed_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    df = sample(spark)
    assert files.save_results(df, path, "7") and not files.save_results(df, path, "7")
    assert rows(files.load_results(spark, path).select(*df.columns)) == rows(df)
    with pytest.raises(ValueError):
        files.save_results(df.where("item_id > 3"), path, "7")
    with pytest.raises(ValueError):
        files.save_results(df, path, "../x")
    monkeypatch.setattr(files, "_digest", lambda d: 1 / 0)  # the job dies between writing and committing
    with pytest.raises(ZeroDivisionError):
        files.save_results(df, path, "8")
    monkeypatch.undo()
    assert len([d for d in os.listdir(f"{path}/data") if d.startswith("batch=")]) == 2
    assert files.load_results(spark, path).count() == 40 and files.committed(spark, path).count() == 1
    assert files.save_results(df.withColumn("item_id", F.col("item_id") + 100), path, "8")
    assert files.load_results(spark, path).count() == 80 and files.load_results(spark, path, 3).count() == 20


def test_files_do_not_grow_with_sessions(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.range(0, 600, 1, 6).select(F.col("id").alias("item_id"), (F.col("id") % 300).alias("session_id"))
    files.save_results(df, path, "1")
    assert 1 < len(parquet(path)) <= files.BUCKETS
    assert rows(files.load_results(spark, path).select(*df.columns)) == rows(df)
    assert rows(files.load_results(spark, path, 7).select("item_id")) == [(307,), (7,)]


def test_a_batch_is_saved_again_with_the_same_rows(spark, sf_dir, monkeypatch):
    """Though the results come out differently every time they are made."""
    flip = F.udf(lambda: random.choice("ab"), "string").asNondeterministic()
    monkeypatch.setattr(registry, "view", lambda *_: spark.range(400).select(F.col("id").alias("item_id"), (F.col("id") % 8).alias("session_id"), flip().alias("final_decision")))
    assert QUERIES["s08_save_load_results"](spark, sf_dir).count() == 50


def test_a_failing_batch_is_halved(spark):
    calls = spark.sparkContext.accumulator(0)

    def invert(pdf):
        calls.add(1)
        if (pdf["x"] == 0).any():
            raise ZeroDivisionError("no inverse")
        return pd.DataFrame({"y": 1 / pdf["x"]})

    schema = T.StructType([T.StructField("y", T.DoubleType())])
    df = spark.range(64).select(F.col("id").alias("item_id"), F.when(F.col("id") % 32 == 5, 0.0).otherwise(2.0).alias("x")).coalesce(1)
    got = {r.item_id: (r.status, r.error, r.y) for r in L.apply_batches(df, invert, schema).collect()}
    assert got == {i: ("error", "ZeroDivisionError: no inverse", None) if i % 32 == 5 else ("ok", None, 0.5) for i in range(64)}
    assert calls.value <= 2 * 2 * 6 + 2
    calls.value = 0
    assert L.apply_batches(df.where("x > 0"), invert, schema).where("status = 'ok'").count() == 62 and calls.value == 1
    short = L.apply_batches(df.where("item_id = 1"), lambda pdf: pdf.iloc[:0].rename(columns={"x": "y"}), schema).first()
    assert short.status == "error" and "0 rows made of 1" in short.error
    assert L.apply_batches(df.where("false"), invert, schema).count() == 0


def test_batches_with_many_bad_rows(spark):
    from pyspark.sql import types as T

    calls = spark.sparkContext.accumulator(0)

    def fn(pdf):
        calls.add(1)
        if (pdf["x"] % 10 == 0).any():
            raise ValueError("bad")
        return (pdf["x"] + 2**60 + 1).to_frame("y")

    df = spark.range(1000).select(F.col("id").alias("item_id"), F.col("id").alias("x")).coalesce(1)
    got = {r.item_id: (r.status, r.y) for r in L.apply_batches(df, fn, T.StructType([T.StructField("y", T.LongType())])).collect()}
    assert got == {i: ("ok", i + 2**60 + 1) if i % 10 else ("error", None) for i in range(1000)}
    assert calls.value == 727  # 847 with a call for both halves of every failed batch


def test_resumption(spark):
    sessions = spark.createDataFrame([(1, "failed", 9, 9, 0, "x"), (2, "failed", 9, 9, 0, "x")], "id long, status string, processed_images long, approved_images long, rejected_images long, error_message string")
    results = spark.createDataFrame([(s, i, "approved" if i % 2 else "rejected") for s in (1, 2) for i in range(10)], "session_id long, index long, final_decision string")
    point = spark.createDataFrame([(1, 9, 6)], "session_id long, processed_count long, batch_start long")
    for option, left, counters in (("continue", 10, (9, 9, 0)), ("restart_batch", 6, (6, 3, 3)), ("fresh_start", 0, (0, 0, 0))):
        s, r = L.resume_sessions(sessions, results, point, option)
        by = {x.id: x for x in s.collect()}
        assert (by[1].processed_images, by[1].approved_images, by[1].rejected_images) == counters and (by[1].status, by[1].error_message) == ("running", None)
        assert (by[2].status, by[2].processed_images, by[2].error_message) == ("failed", 9, "x")
        assert r.where("session_id = 1").count() == left and r.where("session_id = 2").count() == 10
    with pytest.raises(ValueError):
        L.resume_sessions(sessions, results, point, "other")


def test_states_and_structures(spark):
    states = spark.createDataFrame([(1, 5, None), (1, 6, None), (9, 5, None)], "session_id long, processed long, stored string")
    h = rules.state_hash("session_id", "processed")
    states = states.withColumn("stored", F.when(F.col("processed") == 5, h))
    got = rules.state_valid(states, spark.createDataFrame([(1,)], "id long"), "stored", "session_id", "processed").collect()
    assert sorted((r.session_id, r.processed, r.valid) for r in got) == [(1, 5, True), (1, 6, False), (9, 5, False)]
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert tuple(R.structure_valid(names("1", "2", "x"), names("2")).first()) == (1, 0, False)
    assert tuple(R.structure_valid(names("1", "x"), names("1")).first()) == (0, 0, True)


def test_variants(spark):
    raw = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": "x", "b": [1, 2]}'), (3, "{broken"), (4, None)], "id long, raw string")
    got = files.decode_variants(raw, "raw").select("id", *files.variant_fields("raw", {"a": ("$.a", "long"), "b": ("$.b[1]", "long")}))
    assert rows(got) == [(1, 1, None), (2, None, 2), (3, None, None), (4, None, None)]
    assert "b: ARRAY<BIGINT>" in files.merged_schema(files.decode_variants(raw, "raw"), "raw").first()[0]
