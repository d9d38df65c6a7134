"""The metric index against all pairs in numpy, and what it compares."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnower.operators import metric as M
from winnower.operators import similarity as S

KIND = "vec_id long, cluster_id long, embedding array<double>"


def frame(spark, x, cluster=None, parts=4):
    rows = [(i, int(cluster[i]) if cluster is not None else 0, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, KIND).repartition(parts)


def clustered(n=20, each=100, dims=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.concatenate([c + spread * rng.normal(size=(each, dims)) for c in centres])


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    return {(i, j): cos[i, j] for i, j in zip(*np.nonzero(cos >= least)) if i < j}


def test_pairs_of_clustered_vectors(spark):
    x = clustered()
    index = M.Index(size=64, pivots=64, sample=512)
    got = {(r.a, r.b): r.cosine for r in M.cosine_pairs(frame(spark, x), 0.9, index=index).collect()}
    want = brute(x, 0.9)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    tasks = M.compared(frame(spark, x), 0.9, index=index).collect()
    assert sum(t.products for t in tasks) < len(x) ** 2 / 10
    assert sum(t.copies for t in tasks) < len(x) * len(x) / 64  # not a copy for every block
    assert max(t.copies for t in tasks) < 4 * 64


def test_a_dense_cell_is_split(spark):
    x = clustered(1, 1500, spread=0.001)
    tasks = M.compared(frame(spark, x), 0.99, index=M.Index(size=128, pivots=8)).collect()
    assert len(tasks) >= 60 and max(t.copies for t in tasks) < 4 * 128


def test_vectors_without_clusters_fall_back_to_blocks(spark):
    x = np.random.default_rng(3).normal(size=(600, 32))
    got = {(r.a, r.b) for r in M.cosine_pairs(frame(spark, x), 0.3, index=M.Index(size=100)).collect()}
    assert got == set(brute(x, 0.3))
    assert len({t.cell for t in M.compared(frame(spark, x), 0.3, index=M.Index(size=100)).collect()}) == 1


def test_copies_zeros_and_nulls(spark):
    x = [[1.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], *[[1.0, 0.0]] * 3000, [1.0, 0.1]]
    df = frame(spark, x)
    rows = M.cosine_pairs(df, 0.9).collect()
    assert len(rows) == 3001  # a link for each copy, and one pair
    assert {(r.a, r.b) for r in rows} == {(0, i) for i in range(4, 3005)}
    got = {r.item_id: r.cluster_id for r in M.density_clusters(df, 0.9, 5).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 3004)] == [1, 0, 0, 0, 1, 1] and len(got) == len(x)
    empty = df.where("false")
    assert M.cosine_pairs(empty, 0.9).count() == M.density_clusters(empty, 0.9).count() == 0


@pytest.mark.parametrize("samples", [2, 4, 8])
def test_density_clusters_against_pairs(spark, samples):
    rng = np.random.default_rng(samples)
    x = np.concatenate([clustered(8, 40, 6, 0.12, samples), rng.normal(size=(80, 6))])
    df, least = frame(spark, x), 0.97
    want = S.dbscan(M.cosine_pairs(df, least), df.select(F.col("vec_id").alias("item_id")), samples)
    got = M.density_clusters(df, least, samples, index=M.Index(size=32, pivots=32))
    rows = lambda d: sorted((r.item_id, r.cluster_id) for r in d.collect())
    assert rows(got) == rows(want)
    assert len({c for _, c in rows(got)}) > 2


def test_blocks_grow_with_the_vectors_and_products_stay_small():
    index = M.Index()
    assert [index.block(n, 64) for n in (500, 10_000, 100_000, 10**6, 10**8)] == [1024, 1250, 12_500, 32_768, 32_768]
    assert all(index.block(10**8, d) * d <= 1 << 21 for d in (64, 512, 2048))
    assert all(index.step(n) * n <= 1 << 21 for n in (4096, 10_000, 32_768))


def test_density_tasks_hold_no_matrix_of_their_blocks():
    import tracemalloc

    x = np.random.default_rng(5).normal(size=(12_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    n = M._neighbours(x[:6000], x[6000:], np.ones(6000, np.int64), 0.5, 3, False, M.Index())
    parent = M._local_components(x[:6000], x[6000:], 0.5, False, M.Index())
    assert tracemalloc.get_traced_memory()[1] < 120 << 20  # the matrix of neighbours as numbers has 288 MB
    tracemalloc.stop()
    hits = (x[:50] @ x[6000:].T >= 0.5).sum(1)
    assert (np.minimum(n[:50], 3) == np.minimum(hits, 3)).all() and len(set(parent.tolist())) == 1


def sequential(n, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(max(a, b), []).append(min(a, b))
    leader = {}
    for i in range(n):
        leads = [x for x in near.get(i, ()) if leader[x] == x]
        leader[i] = min(leads, default=i)
    return leader


@pytest.mark.parametrize(("kind", "bound"), [("chain", 200_000), ("chain", 700), ("mixed", 900)])
def test_leader_groups(spark, kind, bound):
    rng = np.random.default_rng(7)
    n = 5000 if kind == "chain" and bound > 700 else 1200
    pairs = [(i, i + 1) for i in range(n - 1)] if kind == "chain" else [(int(a), int(a + 1 + b)) for a, b in zip(rng.integers(0, n - 40, 2000), rng.integers(0, 30, 2000))] + [(i, i + 1) for i in range(600)]
    got = S.leader_groups(spark.createDataFrame(pairs, "a long, b long"), spark.range(n).withColumnRenamed("id", "item_id"), bound)
    assert {r.item_id: r.leader for r in got.collect()} == sequential(n, set(pairs))


@pytest.mark.parametrize(("kind", "first"), [("dense", 100), ("dense", 4096), ("sparse", 50), ("mixed", 60)])
def test_cosine_leaders_list_no_pairs_of_dense_vectors(spark, monkeypatch, kind, first):
    rng = np.random.default_rng(11)
    x = {"dense": rng.normal(size=(900, 6)), "sparse": rng.normal(size=(500, 60)), "mixed": np.concatenate([clustered(3, 150, 40, 0.05), rng.normal(size=(150, 40))])}[kind]
    least = 0.6
    want = sequential(len(x), brute(x, least))
    rows = [*x, None, np.zeros(x.shape[1]), x[3], x[3]]
    want |= {len(x): len(x), len(x) + 1: len(x) + 1, len(x) + 2: want[3], len(x) + 3: want[3]}
    listed = []
    pairs = M.cosine_pairs
    monkeypatch.setattr(M, "cosine_pairs", lambda *a, **k: listed.append(1) or pairs(*a, **k))
    got = {r.item_id: r.leader for r in M.cosine_leaders(frame(spark, rows), least, index=M.Index(first=first)).collect()}
    assert got == want
    assert kind == "mixed" or bool(listed) == (kind == "sparse")
    assert M.cosine_leaders(frame(spark, rows).where("false"), least).count() == 0


def test_statistics_without_pairs(spark):
    x = clustered(3, 300, spread=0.3)
    cluster = np.repeat([5, 6, 7], 300)
    cluster[-1] = 99  # alone
    df = frame(spark, x, cluster)
    means, items = M.mean_cosines(df)
    stats = {r.cluster_id: r for r in M.cluster_cosines(df, index=M.Index(size=100)).collect()}
    mean, item = {r.cluster_id: r for r in means.collect()}, {r.item_id: r.mean for r in items.collect()}
    assert mean[99].avg is None and item[899] is None and 99 not in stats
    for c in (5, 6, 7):
        at = np.flatnonzero(cluster == c)
        u = x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)
        cos = u @ u.T
        pairs = cos[np.triu_indices(len(at), 1)]
        assert abs(mean[c].avg - pairs.mean()) < 1e-9 and mean[c].n == len(at)
        assert np.allclose([item[i] for i in at], (cos.sum(1) - 1) / (len(at) - 1))
        s = stats[c]
        assert np.allclose([s.avg, s.max, s.min, s.variance], [pairs.mean(), pairs.max(), pairs.min(), pairs.var()])
        assert [s.identical, s.near_duplicate, s.similar] == [(pairs >= 0.95).sum(), ((pairs >= 0.9) & (pairs < 0.95)).sum(), ((pairs >= 0.75) & (pairs < 0.9)).sum()]
        assert s.n_pairs == len(pairs) == s.identical + s.near_duplicate + s.similar + s.somewhat_similar
