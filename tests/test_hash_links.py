"""Links between classes of equal hashes against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from winnower.operators import similarity as S

KIND = "item_id long, phash string, dhash string, ahash string"


def test_links_join_what_pairs_join(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(25)]

    def near(h):
        digits = list(h)
        for _ in range(rng.choice([0, 0, 0, 2, 5, 6, 9])):
            digits[rng.randrange(16)] = rng.choice("0123456789abcdef")
        return "".join(digits)

    rows = [(i, near(rng.choice(base)), near(rng.choice(base + ["".join(rng.choice("0123456789abcdef") for _ in range(16))])), f"{rng.getrandbits(64):016x}") for i in range(150)]
    df = spark.createDataFrame(rows, KIND)
    links = S.hash_links(df)
    groups = lambda d: sorted(map(tuple, S.connected_components(d.select("a", "b")).collect()))
    assert groups(links) == groups(S.hash_pairs(df)) and links.where("a >= b").count() == 0
    d = {r[0]: r[1:] for r in rows}
    diff = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    assert all(r.distance == min(diff(x, y) for x, y in zip(d[r.a], d[r.b], strict=True)) or r.distance <= 5 for r in links.collect())


def test_a_hot_hash_gives_rows_in_proportion(spark):
    hashes = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit("0" * 16).alias("phash"), F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("dhash"), F.substring(F.md5((F.col("id") + 7).cast("string")), 1, 16).alias("ahash"))
    assert S.hash_links(hashes).where("a = 0 and distance = 0").count() == 19_999
    assert S.hash_links(hashes).count() < 30_000
    assert S.hash_links(hashes.where("false")).count() == 0


@pytest.mark.parametrize(("digits", "many"), [("0123456789abcdef", False), ("0123456789abcdef", True), ("0123456789xyzABC", False)])
def test_pairs_against_all(spark, monkeypatch, digits, many):
    monkeypatch.setattr(S, "_MANY", 0 if many else 10**9)
    rng = random.Random(4)
    base = ["".join(rng.choice(digits) for _ in range(16)) for _ in range(8)]

    def near(h):
        out = list(h)
        for i in rng.sample(range(16), rng.choice([0, 1, 4, 5, 5, 6, 16])):
            out[i] = rng.choice(digits)
        return "".join(out)

    rows = [(i, near(rng.choice(base)), near(rng.choice(base)), near(rng.choice(base))) for i in range(120)]
    got = S.hash_pairs(spark.createDataFrame(rows, KIND))
    diff = lambda x, y: min(sum(p != q for p, q in zip(*z, strict=True)) for z in zip(x[1:], y[1:], strict=True))
    want = {(x[0], y[0]): diff(x, y) for x in rows for y in rows if x[0] < y[0] and diff(x, y) <= 5}
    assert sorted((r.a, r.b, r.distance) for r in got.collect()) == sorted((*k, v) for k, v in want.items())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # a pair is made once, not once for each key that it shares
    assert ("lambda" in plan) == ("x" in digits)
