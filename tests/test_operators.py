"""Operators that SQL can't say, on hand-made rows."""

from __future__ import annotations

import datetime
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.functions import rules, scores
from winnower.operators import aggregates, lifecycle, results, similarity, windows
from winnower.sources import files, raster
from winnower.streaming import streams


def write_png(path, rgb: np.ndarray) -> None:
    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(1)
    plain = np.full((40, 60, 3), 128, np.uint8)
    write_png(root / "a" / "one.png", plain)
    write_png(root / "a" / "two.PNG", rng.integers(0, 256, (64, 64, 3), dtype=np.uint8))
    edge = np.zeros((32, 32, 3), np.uint8)
    edge[:, 16:] = 255
    write_png(root / "b" / "c" / "edge.png", edge)
    (root / "b" / "fake.jpg").write_text("not an image")
    (root / "b" / "empty.png").write_text("")
    (root / "note.txt").write_text("x")
    return str(root)


def test_scan_images(spark, tree):
    found = files.scan_images(spark, tree).collect()
    assert [r.item_id.split("/")[-1] for r in found] == ["one.png", "two.PNG", "edge.png"]
    assert [(r.height, r.width, r.channels) for r in found] == [(40, 60, 3), (64, 64, 3), (32, 32, 3)]
    assert files.count_inputs(spark, tree) == 4  # Spark lists no empty files
    assert files.count_inputs(spark, tree + "/missing") == 0
    meta = files.image_metadata(files.scan_images(spark, tree)).collect()
    assert {r.filename: r.extension for r in meta}["two.PNG"] == ".png"


def test_quality_metrics(spark, tree):
    df = raster.quality_metrics(files.scan_images(spark, tree))
    m = {r.item_id.split("/")[-1]: r for r in df.collect()}
    assert m["one.png"].sharpness == 0 and m["one.png"].noise == 0 and abs(m["one.png"].brightness - 128 / 255) < 1e-9
    assert m["edge.png"].sharpness > 1000 and m["edge.png"].over_pct == 0.5 and m["edge.png"].under_pct == 0.5
    assert m["two.PNG"].noise > 0.05 and not m["two.PNG"].passed
    bad = raster.quality_metrics(files.scan_images(spark, tree, drop_invalid=False)).where("not decoded").collect()
    assert [(r.noise, r.passed) for r in bad] == [(1.0, False)]


def test_pixels_agree_with_arrays(spark, tree):
    images = files.scan_images(spark, tree).where(F.col("item_id").endswith("edge.png"))
    pixels = raster.pixel_table(images).select("item_id", "y", "x", F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).alias("gray"))
    own = raster.quality_metrics(images).first()
    assert abs(raster.pixel_sharpness(pixels, 32, 32).first().sharpness - own.sharpness) < 1e-6
    assert abs(raster.pixel_metrics(pixels).first().contrast - own.contrast) < 1e-9


def test_perceptual_hashes(spark, tree):
    rows = similarity.perceptual_hashes(files.scan_images(spark, tree)).collect()
    assert all(len(h) == 16 for r in rows for h in (r.phash, r.dhash, r.ahash))
    edge = next(r for r in rows if r.item_id.endswith("edge.png"))
    assert edge.ahash == "0f" * 8


def test_hash_distance(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abce"), ("abcd", "efab"), ("", ""), ("abc", "abcd"), (None, "a")], "a string, b string")
    assert [r.d for r in df.select(similarity.hash_distance("a", "b").alias("d")).collect()] == [0, 1, 4, float("inf"), float("inf"), float("inf")]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), (None, [1.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(similarity.cosine("a", "b").alias("c")).collect()] == [1, 0, 0, 0]


def random_graph(n, p, seed):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_leaders(spark, seed):
    n, edges = 40, random_graph(40, 0.04, seed)
    pairs = spark.createDataFrame(edges, "a long, b long")
    items = spark.range(n).select(F.col("id").alias("item_id"))
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.item_id: r.component for r in similarity.connected_components(pairs).collect()}
    assert all(got[i] == label[i] for i in got) and set(got) == {x for e in edges for x in e}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(n)}
    leader = {}
    for i in range(n):
        if i not in leader:
            leader[i] = i
            leader |= {j: i for j in near[i] if j > i and j not in leader}
    assert {r.item_id: r.leader for r in similarity.leader_groups(pairs, items).collect()} == leader


def test_dbscan_default_is_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    items = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 7, 8)], "item_id long")
    assert {r.item_id: r.cluster_id for r in similarity.dbscan(pairs, items).collect()} == {1: 2, 2: 2, 3: 2, 5: 0, 7: 8, 8: 8}


def test_hash_pairs_collapse_copies(spark):
    rows = [(i, "0123456789abcdef", "f" * 16, "0" * 16) for i in range(50)] + [(60, "0123456789abcdee", "1" * 16, "2" * 16)]
    got = similarity.hash_pairs(spark.createDataFrame(rows, "item_id long, phash string, dhash string, ahash string")).collect()
    assert sorted((r.a, r.b, r.distance) for r in got) == [(0, i, 0.0) for i in range(1, 50)] + [(0, 60, 1.0)]


def test_global_rank(spark):
    df = windows.global_rank(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), ["x"])
    assert all(r.x == r.rank for r in df.collect())


def test_folders(spark):
    df = spark.createDataFrame([(i, f"/p/{i}") for i in range(7)], "item_id long, image_path string")
    counts = windows.assign_folders(df, 3).groupBy("folder").count().orderBy("folder").collect()
    assert [r["count"] for r in counts] == [3, 3, 1]


def test_resolve_names_with_taken_names(spark):
    df = spark.createDataFrame([(1, "f", "a.jpg"), (2, "f", "a.jpg"), (3, "f", "a_1.jpg"), (4, "g", "a.jpg"), (5, "f", "b")], "item_id long, folder string, filename string")
    got = {r.item_id: r.new_name for r in windows.resolve_names(df).collect()}
    assert got[1] == "a.jpg" and got[3] == "a_1.jpg" and got[4] == "a.jpg" and got[5] == "b" and got[2] not in ("a.jpg", "a_1.jpg")


def test_select_analyses():
    assert results.select_analyses({"quality": 1, "defect": 2}, ["quality"]) == {"quality": 1}
    with pytest.raises(ValueError, match="unknown"):
        results.select_analyses({}, ["colour"])


def test_validate_thresholds():
    assert rules.validate_thresholds({"quality": 0.5, "weights": (0.35, 0.25, 0.2, 0.15, 0.05)}) == []
    assert len(rules.validate_thresholds({"quality": 2, "weights": (0.5, 0.5, 0.5, 0, 0)})) == 2


def test_threshold_config():
    c = similarity.threshold_config("strict", {"eps": 0.1, "similar": 7, "min_cluster_size": 3, "other": 1})
    assert (c["eps"], c["similar"], c["min_cluster_size"]) == (0.1, 0.85, 3) and "other" not in c


def test_perfect_item(spark):
    row = spark.createDataFrame([(0.85, 0.1, 0, 1.0, 2048000, 2560, 1440)], "overall double, anomaly double, similarity_group int, compliance double, file_size long, width int, height int")
    r = row.withColumns(scores.component_scores()).first()
    assert r.similarity_score == 1 and r.compliance_score == 1 and min(r.quality_score, r.defect_score, r.technical_score, r.overall_score) > 0.8


def test_three_decisions(spark):
    df = spark.createDataFrame([("approved", 0.9, 0.9), ("rejected", 0.1, 0.2), ("review_required", 0.5, 0.5)], "decision string, quality_score double, overall_score double")
    r = aggregates.decision_aggregate(df).first()
    assert (r.total, r.approved, r.rejected, r.review_required) == (3, 1, 1, 1) and abs(r.approval_rate - 1 / 3) < 1e-12
    assert aggregates.decision_aggregate(df.limit(0)).first().approval_rate == 0


def test_safe_apply(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "item_id long, x double")
    schema = T.StructType([T.StructField("y", T.DoubleType())])
    good, bad = lifecycle.safe_apply(df, [("inverse", lambda r: {"y": 1 / r["x"]}, schema), ("double", lambda r: {"y": 2 * r["x"]}, schema)])
    assert [r.y for r in good["inverse"].collect()] == [0.5] and good["double"].count() == 2
    assert [(r.item_id, r.function) for r in bad.collect()] == [(2, "inverse")]


def test_relevance(spark):
    df = spark.createDataFrame([(["blue", "sky"],), (["gun", "sky"],), ([],)], "t array<string>")
    assert [r.v for r in df.select(rules.keyword_relevance(F.col("t")).alias("v")).collect()] == [1.0, 0.5, 0.0]


def test_unknown_project_and_groups(spark):
    sessions = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, project_id long")
    projects = spark.createDataFrame([(10, "first")], "id long, name string")
    assert {r.id: r.project_name for r in results.sessions_with_project(sessions, projects).collect()} == {1: "first", 2: "Unknown", 3: "Unknown"}
    items, clusters = spark.range(3).select(F.col("id").alias("item_id")), spark.createDataFrame([(1, 4)], "item_id long, cluster_id long")
    assert {r.item_id: r.similarity_group for r in results.with_groups(items, clusters).collect()} == {0: 0, 1: 4, 2: 0}


def test_missing_session_is_unsafe(spark):
    sessions = spark.createDataFrame([(1, 2, 1, 1, 5)], "id long, processed_images long, approved_images long, rejected_images long, start_index long")
    done = spark.createDataFrame([(1, "approved"), (1, "rejected"), (9, "approved")], "session_id long, final_decision string")
    got = {r.id: (r.issues, r.safe) for r in aggregates.integrity_counts(sessions, done).collect()}
    assert got == {1: (["index_beyond_results"], False), 9: (["missing_session"], False)}


def test_names_are_unique_after_long_chains(spark):
    rows = [(0, "out", "a.jpg"), (1, "out", "a.jpg")] + [(k + 1, "out", f"a_{k}.jpg") for k in range(1, 14)]
    got = {r.item_id: r.new_name for r in windows.resolve_names(spark.createDataFrame(rows, "item_id long, folder string, filename string")).collect()}
    assert len(set(got.values())) == len(rows) and got[0] == "a.jpg" and got[1] == "a_14.jpg" and all(got[k + 1] == f"a_{k}.jpg" for k in range(1, 14))


def test_a_large_folder_takes_many_tasks(spark):
    rows = [(i, None if i % 9 == 0 else "big" if i % 9 < 8 else "small", f"p{i * 7 % 1000:03d}") for i in range(270)]
    out = windows.assign_subfolders(spark.createDataFrame(rows, "item_id long, source_folder string, image_path string"), 40)
    want = {}
    for folder in (None, "big", "small"):
        own = sorted((p, i) for i, f, p in rows if f == folder)
        want |= {i: folder if len(own) <= 40 else f"{folder}_batch_{k // 40 + 1:03d}" for k, (_, i) in enumerate(own)}
    assert {r.item_id: r.folder for r in out.collect()} == want and "_part" not in out.columns
    assert "windowspecdefinition(source_folder" not in out._jdf.queryExecution().executedPlan().toString()


def test_session_state_ends(spark, tmp_path):
    """State goes when a session completes and a day of event time after its last event; a session that goes on begins anew."""
    schema = "session_id long, event_id long, ts timestamp, event_type string, decision string"
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    parts = [[(1, 1, at(0), "view", "approved"), (1, 2, at(1), "complete", "none"), (2, 3, at(0), "view", "none")], [(1, 4, at(2), "view", "approved"), (3, 5, at(3000), "complete", "none")], [(2, 6, at(3001), "complete", "none"), (1, 7, at(3002), "complete", "none")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for name, make in (("done", streams.completion_stream), ("progress", streams.progress_stream), ("marks", streams.checkpoint_stream)):
        mode = "update" if name == "progress" else "append"
        for k in range(len(parts)):  # a run for each part, with the state of the one before
            events = spark.readStream.schema(schema).parquet(str(tmp_path / f"in/[0-{k}]"))
            streams.write_batches(make(events), str(tmp_path / f"{name}/out"), str(tmp_path / f"{name}/state"), mode)
        state = spark.read.format("statestore").option("stateVarName", "counters").load(str(tmp_path / f"{name}/state"))
        assert state.count() == 0, (name, state.collect())
    done = spark.read.parquet(str(tmp_path / "done/out")).collect()
    assert sorted((r.session_id, r.event_id, r.processed, r.approved) for r in done) == [(1, 2, 2, 1), (1, 7, 1, 0), (2, 6, 1, 0), (3, 5, 1, 0)]


def test_stale_stream(spark, tmp_path):
    schema = "session_id long, event_id long, ts timestamp, event_type string, decision string"
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    rows = [(1, 1, at(0), "view", None), (1, 2, at(3), "view", None), (2, 3, at(0), "complete", None), (3, 4, at(9), "view", None), (4, 5, at(1), "view", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    streams.write_batches(streams.stale_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.session_id, r.event_id, r.last_seen) for r in got) == [(1, 2, at(3)), (4, 5, at(1))]


def test_hash_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(12)]

    def near(h: str) -> str:
        digits = list(h)
        for _ in range(rng.randrange(8)):
            digits[rng.randrange(16)] = rng.choice("0123456789abcdef")
        return "".join(digits)

    rows = [(i, *(near(rng.choice(base)) for _ in range(3))) for i in range(120)]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and (d := min(sum(x != y for x, y in zip(p, q, strict=True)) for p, q in zip(a[1:], b[1:], strict=True))) <= 5:
                want[a[0], b[0]] = d
    got = similarity.hash_pairs(spark.createDataFrame(rows, "item_id long, phash string, dhash string, ahash string")).collect()
    assert {(r.a, r.b): r.distance for r in got} == want and len(want) > 100


def test_score_statistics_of_odd_tables(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(rng.choice([None, 0.5, rng.random()]), 1.0 if i < 3 else None) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r.score: r for r in aggregates.score_statistics(df, ["a", "b"]).collect()}
    for k, name in enumerate("ab"):
        x = [r[k] for r in rows if r[k] is not None]
        assert np.allclose([got[name].q25, got[name].median, got[name].q75, got[name].mean, got[name]["std"]], [*np.percentile(x, [25, 50, 75]), np.mean(x), np.std(x, ddof=1)])
    assert aggregates.score_statistics(df.limit(0), ["a"]).count() == 0


def test_medoid_makes_its_pairs_once(spark):
    """A union of two readings of the pairs failed where Spark split one of them (unequal numbers of partitions)."""
    pairs = spark.createDataFrame([(1, 1, 2, 0.9), (1, 1, 3, 0.97), (1, 2, 3, 0.8)], "cluster_id long, a long, b long, similarity double")
    df = windows.keep_medoid(pairs, spark.range(4).select(F.col("id").alias("item_id"), F.lit(5).alias("file_size")))
    assert {r.item_id: (r.mean, r.action) for r in df.collect()} == {1: (0.935, "keep"), 2: (0.85, "remove"), 3: (0.885, "remove")}
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
