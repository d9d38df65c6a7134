"""Cosine joins, density clusters and statistics of groups over a metric index (SIM-06, SIM-08, SIM-10, A-20, W-03, SIM-15).

Distinct vectors belong to the cell of their nearest pivot; pivots are spread over a bounded sample (farthest first). Angles obey the triangle
inequality, so a vector x of cell p has partners within an angle a in cell q only if
    angle(x, q) <= angle(x, p) + 2 a   and   angle(x, q) <= a + the largest angle of q's members to q.
Only then is it a guest of q, and for every two cells only one of them sends guests. On clustered vectors few cells meet; on
vectors without clusters the index would prune nothing, so the number of pivots (down to one, which is plain blocks against blocks) is the one of least
estimated work on the sample. The result is exact with any.

A cell's members and guests are cut into blocks of at most ``size`` vectors and 16 MB, an eighth of all vectors if that is less (from 1024 on); every task compares two blocks, so a cell that holds a third of all vectors becomes as many
tasks as its pairs need, and a copy of a vector goes to the blocks that can hold a partner, not to all.

Equal vectors are one class under their least id, with the number of its members; null vectors and those of norm 0 have no partners.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.functions.durable import settle
from winnower.functions.exprs import ratio
from winnower.operators.components import connected_components
from winnower.operators.similarity import PRESETS, dot, leader_groups

_SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Most vectors a block, most pivots, vectors of the sample that pivots come from, rows of a product at a time, and vectors that a round of leaders decides first."""

    size: int = 32768
    pivots: int = 512
    sample: int = 4096
    tile: int = 512
    first: int = 4096

    def block(self, n: int, dims: int) -> int:
        """Vectors a block for n of them: copies grow with the number of blocks, tasks with its square."""
        return max(1, min(self.size, max(1024, -(-n // 8)), max(256, (1 << 21) // dims)))

    def step(self, others: int) -> int:
        """Rows of a product at a time: 16 MB of them, whatever the other side has."""
        return max(1, self.tile * 4096 // max(others, 4096))


def classes(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(id, v, copies) of the distinct non-zero vectors, of length 1, and (a, b): each further member b of the class of a. Both are written."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("raw"))
    each = rows.groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("norm", F.sqrt(dot(F.col("raw"), F.col("raw")))).where(F.col("norm") > 0)
    each = settle(each.select("id", F.transform("raw", lambda x: x / F.col("norm")).alias("v"), "copies", F.when(F.col("copies") > 1, F.col("raw")).alias("raw")))
    several = each.where("copies > 1").select("raw", F.col("id").alias("a"))
    links = settle(several.join(rows, "raw").where("id <> a").select("a", F.col("id").alias("b")))
    return each.drop("raw"), links


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ p.T, -1, 1))


def _spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots, each farthest from those before it."""
    picked, far = [0], _angles(sample, sample[:1])[:, 0]
    while len(picked) < min(most, len(sample)) and far.max() > _SLACK:
        picked.append(int(far.argmax()))
        far = np.minimum(far, _angles(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def _guests(own: np.ndarray, cell: np.ndarray, to: np.ndarray, radius: np.ndarray, within: float) -> np.ndarray:
    """Which vectors (rows) are guests of which cells (columns)."""
    k = np.arange(to.shape[1])
    sends = np.where((cell[:, None] + k) % 2 == 0, cell[:, None] < k, cell[:, None] > k)
    return sends & (to <= own[:, None] + 2 * within + _SLACK) & (to <= within + radius + _SLACK)


def _best(sample: np.ndarray, pivots: np.ndarray, n: int, within: float, size: int) -> np.ndarray:
    """The leading pivots with the least work for n vectors: products of pairs, and copies at the price of some thousand products."""
    work, count = [], sorted({1, *(k for k in (4, 16, 64, 256, 512, 1024) if k < len(pivots)), len(pivots)})
    scale = n / len(sample)
    for k in count:
        to = _angles(sample, pivots[:k])
        cell, own = to.argmin(1), to.min(1)
        radius = np.zeros(k)
        np.maximum.at(radius, cell, own)
        home = np.bincount(cell, minlength=k) * scale
        guest = _guests(own, cell, to, radius, within).sum(0) * scale
        blocks, others = np.ceil(home / size), np.ceil(guest / size)
        work.append((home * guest + home**2 / 2 + 4000 * (home * (blocks + others) + guest * blocks)).sum())
    return pivots[: count[int(np.argmin(work))]]


def _meetings(each: DataFrame, within: float, index: Index) -> DataFrame | None:
    """Vectors as (cell, i, j, side, id, v, …), one copy for each task (cell, i, j) that compares its block i (side 0) with block j (side 1; with itself if i = j)."""
    n = each.count()
    if not n:
        return None
    sample = each.orderBy(F.xxhash64("id"), "id").limit(index.sample).select("v").toArrow()
    sample = _matrix(sample["v"])
    size = index.block(n, sample.shape[1])
    pivots = _best(sample, _spread(sample, index.pivots), n, within, size)
    names, spark = each.columns, each.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches):
        for batch in batches:
            to = _angles(_matrix(batch.column("v")), shared.value)
            yield pa.record_batch([pa.array(to.argmin(1)), pa.array(to.min(1))], names=["cell", "angle"])

    sizes = {r.cell: (r.n, r.radius) for r in each.select("v").mapInArrow(nearest, "cell long, angle double").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    radius = np.array([sizes.get(k, (0, -np.inf))[1] for k in range(len(pivots))])

    def placed(with_vectors: bool) -> Callable:
        def run(batches):
            for batch in batches:
                to = _angles(_matrix(batch.column("v")), shared.value)
                cell = to.argmin(1)
                row, at = np.nonzero(_guests(to.min(1), cell, to, radius, within))
                row, at, guest = np.concatenate([np.arange(len(cell)), row]), np.concatenate([cell, at]), np.repeat([False, True], [len(cell), len(row)])
                made = [pa.array(at), pa.array(guest)]
                yield pa.record_batch([*made, *(batch.column(c).take(pa.array(row)) for c in names)], names=["cell", "guest", *names]) if with_vectors else pa.record_batch(made, names=["cell", "guest"])

        return run

    kinds = ", ".join(f"{n} {t}" for n, t in each.dtypes)
    guests = {r.cell: r.n for r in each.select("v").mapInArrow(placed(False), "cell long, guest boolean").where("guest").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    blocks = [(k, -(-sizes[k][0] // size), -(-guests.get(k, 0) // size)) for k in sizes]  # one row a pivot
    plan = F.broadcast(spark.createDataFrame(blocks, "cell long, h long, g long"))
    rows = each.mapInArrow(placed(True), f"cell long, guest boolean, {kinds}").join(plan, "cell")
    b = F.pmod(F.xxhash64(F.lit("block"), "id"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("h")))
    left = F.transform(F.sequence(b, F.col("h") + F.col("g") - 1), lambda j: F.struct(b.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    before = F.transform(F.when(b > 0, F.sequence(F.lit(0).cast("long"), b - 1)).otherwise(F.array().cast("array<long>")), lambda i: F.struct(i.alias("i"), b.alias("j"), F.lit(1).alias("side")))
    visits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("h") - 1), lambda i: F.struct(i.alias("i"), (F.col("h") + b).alias("j"), F.lit(1).alias("side")))
    tasks = rows.withColumn("t", F.explode(F.when(F.col("guest"), visits).otherwise(F.concat(left, before))))
    return tasks.select("cell", "t.i", "t.j", "t.side", *names)


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Block i and block j of a task; the same one if it is compared with itself."""
    side = table["side"].to_numpy()
    left = table.filter(pa.array(side == 0))
    return left, left if table["i"][0] == table["j"][0] else table.filter(pa.array(side == 1))


def cosine_pairs(vectors: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", index: Index = Index()) -> DataFrame:
    """(a, b, cosine): all pairs of distinct vectors, by the least ids of their classes, at ``least`` (above 0) or more, a < b, and (least id, member, 1.0) for all further members of a class."""
    if least <= 0:
        raise ValueError("the least cosine must be positive")
    each, links = classes(vectors, key, column)
    same = links.withColumn("cosine", F.lit(1.0))
    meet = _meetings(each, float(np.arccos(min(least, 1.0))), index)
    if meet is None:
        return same

    def compare(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        ia, ib, x, y = left["id"].to_numpy(), right["id"].to_numpy(), _matrix(left["v"]), _matrix(right["v"])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = index.step(len(ib))
        for s in range(0, len(ia) if len(ib) else 0, step):
            cos = x[s : s + step] @ y.T
            r, c = np.nonzero(cos >= least)
            p, q, cos = ia[s + r], ib[c], cos[r, c]
            keep = p < q if left is right else np.ones(len(p), bool)
            found.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], cos[keep]))
        a, b, cos = (np.concatenate(z) for z in zip(*found))
        return pa.table({"a": a, "b": b, "cosine": cos})

    return meet.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long, cosine double").unionByName(same)


def _led(x: np.ndarray, least: float) -> np.ndarray:
    """For vectors in the order of ids the position of each one's leader, itself if it leads."""
    near = np.concatenate([x[s : s + 512] @ x.T >= least for s in range(0, len(x), 512)])
    leader = np.arange(len(x))
    leads = np.zeros(len(x), bool)
    for i in range(len(x)):
        hit = near[i, :i] & leads[:i]
        leads[i] = not hit.any()
        leader[i] = i if leads[i] else int(hit.argmax())
    return leader


def cosine_leaders(vectors: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", index: Index = Index()) -> DataFrame:
    """(item_id, leader) as ``leader_groups`` gives it for all pairs at ``least`` or more: copies have their class's leader.

    A round decides the ``first`` open vectors of least ids among themselves (on the driver, which gets no more than these) and broadcasts those that lead;
    all other open vectors follow the least of them within reach. What a round leaves open has no leader so far, so the next one starts afresh, and no pairs are listed:
    a vector meets the leaders alone. Where a round decides less than a quarter of what is open, the vectors have few neighbours, and the rest goes by its pairs.
    """
    if least <= 0:
        raise ValueError("the least cosine must be positive")
    each, links = classes(vectors, key, column)
    spark = each.sparkSession
    start = each.select("id", "v", F.lit(None).cast("long").alias("leader"))
    open_, decided, left = start, [], start.count()
    while left:
        bound = open_.select("id").orderBy("id").limit(index.first).agg(F.max("id")).first()[0]
        block = open_.where(F.col("id") <= bound).select("id", "v").toArrow().sort_by("id")
        ids, x = block["id"].to_numpy(), _matrix(block["v"])
        led = _led(x, least)
        lead = led == np.arange(len(ids))
        shared = spark.sparkContext.broadcast((ids, ids[led], ids[lead], x[lead]))

        def follow(batches, shared=shared):
            ids, own, leads, x = shared.value
            for batch in batches:
                mine, v = batch.column("id").to_numpy(), _matrix(batch.column("v"))
                leader = np.full(len(mine), -1)
                at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                known = ids[at] == mine
                for s in range(0, len(mine), index.tile):
                    near = v[s : s + index.tile] @ x.T >= least
                    leader[s : s + index.tile] = near.argmax(1)
                    known[s : s + index.tile] |= near.any(1)
                leader = np.where(ids[at] == mine, own[at], leads[leader])
                keep = pa.array(known)
                yield pa.record_batch([batch.column("id"), pa.compute.if_else(keep, pa.scalar(None, batch.column("v").type), batch.column("v")), pa.array(leader, mask=~known)], names=["id", "v", "leader"])

        now = settle(open_.mapInArrow(follow, start.schema))
        decided.append(now.where("leader is not null").select(F.col("id").alias("item_id"), "leader"))
        open_, before = now.where("leader is null"), left
        left = open_.count()
        if left and before - left < before / 4:
            pairs = settle(cosine_pairs(open_, least, "id", "v", index).select("a", "b"))
            decided.append(settle(leader_groups(pairs, open_.select(F.col("id").alias("item_id")))))
            break
    items = vectors.select(F.col(key).cast("long").alias("item_id"))
    copies = links.select(F.col("a").alias("item_id"), "b")
    led = decided[0] if decided else items.where("false").select("item_id", F.col("item_id").alias("leader"))
    for more in decided[1:]:
        led = led.unionByName(more)
    led = led.unionByName(copies.join(led, "item_id").select(F.col("b").alias("item_id"), "leader"))
    return items.join(led, "item_id", "left").select("item_id", F.coalesce("leader", "item_id").alias("leader"))


def compared(vectors: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", index: Index = Index()) -> DataFrame:
    """(cell, i, j, copies, products) of the tasks that the join consists of: what it costs."""
    meet = _meetings(classes(vectors, key, column)[0], float(np.arccos(min(least, 1.0))), index)
    left, right = F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)
    return meet.groupBy("cell", "i", "j").agg(F.count("*").alias("copies"), F.when(F.col("i") == F.col("j"), left * (left - 1) / 2).otherwise(left * right).cast("long").alias("products"))


def _neighbours(x: np.ndarray, y: np.ndarray, copies: np.ndarray, least: float, enough: int, same: bool, index: Index) -> np.ndarray:
    """For each of x the members of y within reach, those of itself left out; from ``enough`` on a vector isn't counted any further."""
    n, todo = np.zeros(len(x), np.int64), np.arange(len(x))
    for c in range(0, len(y), 4096):
        for s in range(0, len(todo), index.tile):
            rows = todo[s : s + index.tile]
            hit = x[rows] @ y[c : c + 4096].T >= least
            if same:
                own = (rows >= c) & (rows < c + 4096)
                hit[np.flatnonzero(own), rows[own] - c] = False
            n[rows] += np.count_nonzero(hit, axis=1)
            extra = np.flatnonzero(copies[c : c + 4096] > 1)
            if len(extra):
                n[rows] += hit[:, extra] @ (copies[c + extra] - 1)
        todo = todo[n[todo] < enough]
        if not len(todo):
            break
    return n


def _join(parent: np.ndarray, rows: slice, cols: slice, hit: np.ndarray) -> np.ndarray:
    """Components after the links of ``hit``, each under its first vertex."""
    while True:
        low, far = parent.copy(), len(parent) + 1
        low[rows] = np.minimum(low[rows], np.where(hit, parent[cols][None], far).min(1, initial=far))
        low[cols] = np.minimum(low[cols], np.where(hit, parent[rows][:, None], far).min(0, initial=far))
        new = parent.copy()
        np.minimum.at(new, parent, low)  # roots hook to the least label seen from their component
        new = np.minimum(new, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == parent).all():
            return parent
        parent = new


def _local_components(x: np.ndarray, y: np.ndarray, least: float, same: bool, index: Index) -> np.ndarray:
    """For the vertices of both sides (of one, if ``same``) the first vertex of their component; what is one component already isn't compared."""
    n, m = len(x), len(y)
    parent, right = np.arange(n if same else n + m), slice(0, m) if same else slice(n, n + m)
    step = index.step(m)
    for s in range(0, n if m else 0, step):
        rows = slice(s, min(s + step, n))
        if (parent[rows] != parent[s]).any() or (parent[right] != parent[s]).any():
            parent = _join(parent, rows, right, x[rows] @ y.T >= least)
    return parent


def density_clusters(vectors: DataFrame, least: float, min_samples: int = 2, key: str = "vec_id", column: str = "embedding", index: Index = Index()) -> DataFrame:
    """(item_id, cluster_id) of all vectors without a table of pairs: clusters are numbered by their least core item + 1, 0 is noise.

    An item is core if ``min_samples`` items, itself included, have a cosine of ``least`` or more with it. Tasks count neighbours as far as that takes, then
    connect the core items within their two blocks and send one link an item to its local component's first one; links merge by
    large-star and small-star. Other items join the cluster of their least core neighbour. Null and zero vectors are noise.
    """
    each, links = classes(vectors, key, column)
    items = vectors.select(F.col(key).cast("long").alias("item_id"))
    within = float(np.arccos(min(least, 1.0)))
    meet = _meetings(each, within, index)
    if meet is None:
        return items.withColumn("cluster_id", F.lit(0).cast("long"))

    def degrees(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        x, y = _matrix(left["v"]), _matrix(right["v"])
        sides = [(left, x, right, y)] if left is right else [(left, x, right, y), (right, y, left, x)]
        sides = [z for z in sides if len(left) and len(right)]
        sums = [(a["id"].to_numpy(), _neighbours(u, v, b["copies"].to_numpy(), least, min_samples, left is right, index)) for a, u, b, v in sides]
        ids, n = zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *sums)
        return pa.table({"id": np.concatenate(ids), "n": np.concatenate(n)})

    counts = meet.groupBy("cell", "i", "j").applyInArrow(degrees, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    marked = settle(each.join(counts, "id", "left").select("id", "v", (F.col("copies") + F.coalesce("n", F.lit(0)) >= min_samples).alias("core")))

    def local(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        ids, core, vectors = [t["id"].to_numpy() for t in (left, right)], [t["core"].to_numpy(zero_copy_only=False) for t in (left, right)], [_matrix(t["v"]) for t in (left, right)]
        nodes = ids[0][core[0]] if left is right else np.concatenate([x[c] for x, c in zip(ids, core)])
        root = nodes[_local_components(vectors[0][core[0]], vectors[1][core[1]], least, left is right, index)] if len(nodes) else nodes
        joined = root != nodes
        a, b, kind = [nodes[joined]], [root[joined]], [np.zeros(int(joined.sum()), bool)]
        big = np.iinfo(np.int64).max
        for mine, other in ((0, 1), (1, 0))[: 1 if left is right else 2]:
            outer, x = ids[mine][~core[mine]], vectors[mine][~core[mine]]
            cores, y = ids[other][core[other]], vectors[other][core[other]]
            step = index.step(len(cores))
            for s in range(0, len(outer) if len(cores) else 0, step):
                first = np.where(x[s : s + step] @ y.T >= least, cores[None], big).min(1, initial=big)
                hit = first < big
                a.append(outer[s : s + step][hit]), b.append(first[hit]), kind.append(np.ones(int(hit.sum()), bool))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "border": np.concatenate(kind)})

    found = settle(_meetings(marked, within, index).groupBy("cell", "i", "j").applyInArrow(local, "a long, b long, border boolean"))
    parts = connected_components(found.where("not border").select("a", "b")).select(F.col("node").alias("id"), "component")
    core = settle(marked.where("core").select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    border = found.where("border").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).join(core.withColumnRenamed("id", "b"), "b").select("id", "component")
    labels = core.unionByName(border)
    copies = links.join(labels, links.a == labels.id).select(F.col("b").alias("id"), "component")
    labels = labels.unionByName(copies).withColumnRenamed("id", "item_id")
    return items.join(labels, "item_id", "left").select("item_id", F.coalesce(F.col("component") + 1, F.lit(0)).alias("cluster_id"))


def _unit(vectors: DataFrame, key: str, column: str) -> DataFrame:
    raw = vectors.where(F.col(column).isNotNull() & F.col("cluster_id").isNotNull()).select("cluster_id", F.col(key).cast("long").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("raw"))
    return raw.withColumn("norm", F.sqrt(dot(F.col("raw"), F.col("raw")))).where(F.col("norm") > 0).select("cluster_id", "id", F.transform("raw", lambda x: x / F.col("norm")).alias("v"))


def _sums(unit: DataFrame) -> DataFrame:
    """(cluster_id, n, total): the sum of each cluster's unit vectors, from partial sums of each batch."""

    def partial(batches):
        for batch in batches:
            v = _matrix(batch.column("v"))
            clusters, own = np.unique(batch.column("cluster_id").to_numpy(), return_inverse=True)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(clusters)))
            sums = np.add.reduceat(v[order], cuts) if len(v) else v
            yield pa.record_batch([pa.array(clusters), pa.array(np.bincount(own, minlength=len(clusters))), pa.array(list(sums), pa.list_(pa.float64()))], names=["cluster_id", "n", "s"])

    rows = unit.select("cluster_id", "v").mapInArrow(partial, "cluster_id long, n long, s array<double>")
    parts = rows.select("cluster_id", "n", F.posexplode("s").alias("k", "x")).groupBy("cluster_id", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return parts.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("total"))


def mean_cosines(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(cluster_id, n, avg): the mean cosine over a cluster's pairs, and (cluster_id, item_id, mean): that of each item with the others.

    With unit vectors v and their sum S these are (S·S - n) / (n (n - 1)) and (v·S - 1) / (n - 1): one aggregate with partial sums, whatever
    the size of a cluster; null for a cluster of one. ``vectors`` has cluster_id (long), the key and the vectors.
    """
    unit = _unit(vectors, key, column)
    sums = settle(_sums(unit))
    n = F.col("n")
    clusters = sums.select("cluster_id", "n", F.when(n > 1, (dot(F.col("total"), F.col("total")) - n) / (n * (n - 1))).alias("avg"))
    items = unit.join(sums, "cluster_id").select("cluster_id", F.col("id").alias("item_id"), F.when(n > 1, (dot(F.col("v"), F.col("total")) - 1) / (n - 1)).alias("mean"))
    return clusters, items


def cluster_cosines(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", index: Index = Index(), levels: dict[str, float] = PRESETS["balanced"]) -> DataFrame:
    """(cluster_id, n_pairs, avg, max, min, variance, identical, near_duplicate, similar, somewhat_similar) over all pairs of a cluster's vectors.

    Clusters are cut into blocks of ``size``; a task compares two blocks and gives one row of sums and extremes, so that a cluster of a million items is
    some thirty thousand rows and never a list of pairs. Items with equal vectors are pairs like others.
    """
    unit = settle(_unit(vectors, key, column))
    blocks = unit.groupBy("cluster_id").agg(F.ceil(F.count("*") / min(index.size, 4096)).alias("h"))
    b = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("h"))
    left = F.transform(F.sequence(b, F.col("h") - 1), lambda j: F.struct(b.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    before = F.transform(F.when(b > 0, F.sequence(F.lit(0).cast("long"), b - 1)).otherwise(F.array().cast("array<long>")), lambda i: F.struct(i.alias("i"), b.alias("j"), F.lit(1).alias("side")))
    tasks = unit.join(blocks, "cluster_id").withColumn("t", F.explode(F.concat(left, before))).select("cluster_id", "t.i", "t.j", "t.side", "v")
    names = ["identical", "near_duplicate", "similar"]

    def measure(table: pa.Table) -> pa.Table:
        left, right = _sides(table)
        x, y = _matrix(left["v"]), _matrix(right["v"])
        n, total, squares, most, least, above = 0, 0.0, 0.0, None, None, np.zeros(3, np.int64)
        for s in range(0, len(x) if len(y) else 0, index.tile):
            cos = x[s : s + index.tile] @ y.T
            cos = cos[np.arange(len(cos))[:, None] + s < np.arange(len(y))] if left is right else cos.ravel()
            if len(cos):
                n, total, squares = n + len(cos), total + cos.sum(), squares + (cos * cos).sum()
                most, least = max(most if most is not None else -2.0, cos.max()), min(least if least is not None else 2.0, cos.min())
                above += [(cos >= levels[k]).sum() for k in names]
        return pa.table({"cluster_id": table["cluster_id"][:1], "n": [n], "total": [total], "squares": [squares], "most": pa.array([most], pa.float64()), "least": pa.array([least], pa.float64()), **{f"to_{k}": [int(v)] for k, v in zip(names, above)}})

    out = "cluster_id long, n long, total double, squares double, most double, least double, " + ", ".join(f"to_{k} long" for k in names)
    rows = tasks.groupBy("cluster_id", "i", "j").applyInArrow(measure, out).groupBy("cluster_id").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares", *(f"to_{k}" for k in names))), F.max("most").alias("max"), F.min("least").alias("min"))
    avg = ratio(F.col("total"), F.col("n"))
    counts = {"identical": F.col("to_identical"), "near_duplicate": F.col("to_near_duplicate") - F.col("to_identical"), "similar": F.col("to_similar") - F.col("to_near_duplicate"), "somewhat_similar": F.col("n") - F.col("to_similar")}
    return rows.where("n > 0").select("cluster_id", F.col("n").alias("n_pairs"), avg.alias("avg"), "max", "min", F.greatest(F.col("squares") / F.col("n") - avg * avg, F.lit(0.0)).alias("variance"), *(c.alias(k) for k, c in counts.items()))
