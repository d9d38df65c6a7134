"""Similarity of items and their grouping (SIM-02 to SIM-16).

Pairs of hashes come from joins on equal pieces (pairs of vectors: ``metric``); groups from rounds of joins that end when nothing changes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.durable import settle
from winnower.functions.exprs import col
from winnower.operators import components
from winnower.operators.scans import ranged, scan

#: Thresholds of the presets.
PRESETS = {
    "strict": {"clip": 0.95, "visual": 0.90, "identical": 0.98, "near_duplicate": 0.95, "similar": 0.85, "eps": 0.2},
    "balanced": {"clip": 0.90, "visual": 0.85, "identical": 0.95, "near_duplicate": 0.90, "similar": 0.75, "eps": 0.3},
    "lenient": {"clip": 0.85, "visual": 0.80, "identical": 0.90, "near_duplicate": 0.85, "similar": 0.70, "eps": 0.4},
}


def hash_distance(a, b, bits: bool = False) -> Column:
    """Number of differing hex digits (or bits); infinite for empty hashes or unequal lengths."""
    a, b = col(a), col(b)
    digits = lambda c: F.split(c, "")
    value = lambda c: F.conv(c, 16, 10).cast("int")
    each = F.zip_with(digits(a), digits(b), lambda x, y: F.bit_count(value(x).bitwiseXOR(value(y))) if bits else F.when(x != y, 1).otherwise(0))
    fits = (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(F.coalesce(fits, F.lit(False)), F.aggregate(each, F.lit(0), lambda s, x: s + x).cast("double")).otherwise(F.lit(float("inf")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 if a vector is null or of norm 0."""
    a, b = col(a), col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def standard_scale(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(x - mean) / population deviation per dimension; a constant dimension is only centred. The statistics are one row."""
    each = vectors.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = F.sort_array(F.collect_list(F.struct("k", "m", "s")))
    stats = each.agg(rows.alias("r")).select(F.transform("r", lambda x: F.struct(x["m"].alias("m"), F.when(x["s"] > 0, x["s"]).otherwise(1.0).alias("s"))).alias("_stats"))
    return vectors.crossJoin(F.broadcast(stats)).withColumn(column, F.zip_with(column, "_stats", lambda x, t: (x - t["m"]) / t["s"])).drop("_stats")


def l2_normalize(v) -> Column:
    norm = F.sqrt(dot(col(v), col(v)))
    return F.transform(col(v), lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def fuse(clip, visual, w: float = 0.7) -> Column:
    return F.concat(F.transform(l2_normalize(clip), lambda x: x * w), F.transform(l2_normalize(visual), lambda x: x * (1 - w)))


def _coded(df: DataFrame, kinds: tuple[str, ...], length: int) -> tuple[DataFrame, bool]:
    """The hashes as numbers if all are of sixteen lower-case hex digits, or else as they are; and whether they are numbers."""
    whole = lambda k: F.coalesce(F.col(k).rlike("^[0-9a-f]{16}$"), F.lit(False))
    if length != 16 or not df.where(~functools.reduce(Column.__and__, map(whole, kinds))).isEmpty():
        return df, False
    half = lambda k, at: F.conv(F.substring(k, at, 8), 16, 10).cast("long")
    return df.withColumns({k: F.shiftleft(half(k, 1), 32).bitwiseOR(half(k, 9)) for k in kinds}), True


def _differ(a: str, b: str, plain: bool) -> Column:
    """``hash_distance`` in digits, of numbers by their bits."""
    if not plain:
        return hash_distance(a, b)
    x = F.col(a).bitwiseXOR(F.col(b))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))).cast("double")


def _near(rows: DataFrame, h: str, t: int, length: int, equal: int, plain: bool, many: bool) -> DataFrame:
    """Pairs of rows, once in either order, whose hashes ``h`` differ in at most t digits: the columns of ``rows``, and those of the other with _2 added.

    A hash is cut into t + ``equal`` pieces; at most t differing digits leave ``equal`` pieces alike. With the pieces dealt to ``equal`` - 1 parts two of them
    lie in one part, so two pieces of a part are a key: 12 keys of four digits at five of sixteen digits. ``many`` takes every choice of ``equal``
    pieces: 56 keys of six digits, more rows for fewer chance meetings. A pair counts for the first key that its hashes share.
    """
    n = min(length, t + equal)
    cuts = [round(i * length / n) for i in range(n + 1)]
    size = n - t if n > t else 1
    choices = list(itertools.combinations(range(n), size))
    if size > 1 and not many:
        choices = [c for part in np.array_split(np.arange(n), size - 1) for c in itertools.combinations(part.tolist(), 2)]
    if plain:
        bits = lambda i: ((1 << 4 * (cuts[i + 1] - cuts[i])) - 1) << 4 * (length - cuts[i + 1])
        masks = [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in (sum(map(bits, c)) for c in choices)]
        keys, shared = [F.col(h).bitwiseAND(m) for m in masks], [F.col(h).bitwiseXOR(F.col(f"{h}_2")).bitwiseAND(m) == 0 for m in masks]
    else:
        piece = lambda x, i: F.substring(x, cuts[i] + 1, cuts[i + 1] - cuts[i])
        keys = [F.struct(*(piece(h, i) for i in c)) for c in choices]
        shared = [functools.reduce(Column.__and__, (piece(h, i) == piece(f"{h}_2", i) for i in c)) for c in choices]
    each = rows.select(*rows.columns, F.posexplode(F.array(*(F.xxhash64(F.lit(j), k) for j, k in enumerate(keys)))).alias("_j", "_key"))
    other = each.select(*(F.col(c).alias(f"{c}_2") for c in rows.columns), F.col("_j").alias("_j_2"), "_key")
    first = F.coalesce(*(F.when(x, F.lit(j)) for j, x in enumerate(shared)))
    met = each.join(other, "_key").where((F.col("_j") - F.col("_j_2") == 0) & (_differ(h, f"{h}_2", plain) <= t) & (first == F.col("_j")))
    return met.drop("_key", "_j", "_j_2")


#: From so many hashes on, chance meetings at keys of four digits cost more than the rows of all keys of six.
_MANY = 16_000_000


def hash_pairs(hashes: DataFrame, t: int = 5, kinds: tuple[str, ...] = ("phash", "dhash", "ahash"), length: int = 16, equal: int = 3) -> DataFrame:
    """(a, b, distance): pairs of which some hash differs in at most t digits, with the least distance.

    Pairs meet by equal pieces of a hash (``_near``) and count for the first kind that is near. Items of equal hashes are one
    class first, so that large groups of copies don't multiply; pairs inside a class are given as links to its
    least item, at distance 0.
    """
    table = settle(hashes.groupBy(*kinds).agg(F.min("item_id").alias("node")))
    coded, plain = _coded(table, kinds, length)
    many = table.count() > _MANY
    apart = [_differ(k, f"{k}_2", plain) for k in kinds]
    pairs = hashes.join(table, list(kinds)).where("item_id <> node").select(F.col("node").alias("a"), F.col("item_id").alias("b"), F.lit(0.0).alias("distance"))
    for k, kind in enumerate(kinds):
        near = _near(coded, kind, t, length, equal, plain, many).where(functools.reduce(Column.__and__, (d > t for d in apart[:k]), F.col("node") < F.col("node_2")))
        pairs = pairs.unionByName(near.select(F.col("node").alias("a"), F.col("node_2").alias("b"), F.least(*apart, F.lit(float("inf"))).alias("distance")))
    return pairs


def hash_links(hashes: DataFrame, t: int = 5, kinds: tuple[str, ...] = ("phash", "dhash", "ahash"), length: int = 16, equal: int = 3) -> DataFrame:
    """(a, b, distance): the links of ``hash_pairs`` between classes, which groups of any size leave few.

    Items of one equal hash are a class of that kind, under their least item, and linked to it at distance 0. Classes whose hashes differ in at most t
    digits are linked by their least items, found by equal pieces as in ``hash_pairs``. Two items are a pair, or reach each other by way of their
    classes, just if ``hash_pairs`` has them.
    """
    each = hashes.select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(kind).alias("h")) for k, kind in enumerate(kinds)))).alias("x")).select("item_id", "x.*").where("h is not null")
    table = settle(each.groupBy("kind", "h").agg(F.min("item_id").alias("node")))
    links = each.join(table, ["kind", "h"]).where("item_id <> node").select(F.col("node").alias("a"), F.col("item_id").alias("b"), F.lit(0.0).alias("distance"))
    coded, plain = _coded(table, ("h",), length)
    many = table.count() > _MANY * len(kinds)
    for k in range(len(kinds)):
        near = _near(coded.where(F.col("kind") == k).select("node", "h"), "h", t, length, equal, plain, many).where("h < h_2")
        links = links.unionByName(near.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"), _differ("h", "h_2", plain).alias("distance")))
    return links.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def similarity_level(s, t: Mapping[str, float] = PRESETS["balanced"]) -> Column:
    return F.when(col(s) >= t["identical"], "identical").when(col(s) >= t["near_duplicate"], "near_duplicate").when(col(s) >= t["similar"], "similar").otherwise("somewhat_similar")


def connected_components(edges: DataFrame) -> DataFrame:
    """(item_id, component) of all items of the edges (a, b), the component being its least item."""
    return components.connected_components(edges).withColumnRenamed("node", "item_id")


def dbscan(pairs: DataFrame, items: DataFrame, min_samples: int = 2) -> DataFrame:
    """(item_id, cluster_id) from pairs (a, b) within eps: clusters are numbered by their least core item + 1, 0 is noise.

    An item is core if it has min_samples neighbours, itself included; core items that are pairs are connected; others
    join the cluster of their least core neighbour.
    """
    both = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    core = settle(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select("a"))
    inner = both.join(core, "a").join(core.select(F.col("a").alias("b")), "b")
    labels = core.select(F.col("a").alias("item_id")).join(connected_components(inner.where("a < b")), "item_id", "left").select("item_id", F.coalesce("component", "item_id").alias("component"))
    labels = settle(labels)
    border = both.join(core, "a", "left_anti").join(labels.withColumnRenamed("item_id", "b"), "b").groupBy(F.col("a").alias("item_id")).agg(F.min_by("component", "b").alias("component"))
    return items.select("item_id").join(labels.unionByName(border), "item_id", "left").select("item_id", F.coalesce(F.col("component") + 1, F.lit(0)).alias("cluster_id"))


def leader_groups(pairs: DataFrame, items: DataFrame, bound: int = 200_000) -> DataFrame:
    """(item_id, leader): going through items in order, one without a group leads all later free items that pair with it.

    Decisions hang on smaller items only. A round decides every item whose smaller neighbours are decided, or that has a leading neighbour below all open ones;
    most items are decided in a few rounds. When a round decides less than a tenth of the open items, what is open are chains: components of
    at most ``bound`` open links are then finished in one task each, and from larger ones the least items with so many links, in one task; then rounds go on.
    Each turn ends at least that many links or a whole round, so there is no bound on their number.
    """
    down = settle(pairs.select(F.greatest("a", "b").alias("item_id"), F.least("a", "b").alias("low")).where("item_id <> low").distinct())
    state = settle(items.select("item_id", F.lit(None).cast("long").alias("leader")))
    left = state.count()
    while left:
        before, open_before = left, state
        near = down.join(state.withColumnRenamed("item_id", "low"), "low").groupBy("item_id").agg(F.min(F.when(F.col("leader") == F.col("low"), F.col("low"))).alias("leads"), F.count_if(F.col("leader").isNull()).alias("open"), F.min(F.when(F.col("leader").isNull(), F.col("low"))).alias("first_open"))
        joined = open_before.join(near, "item_id", "left")
        follows = F.when(F.col("leads").isNotNull() & F.coalesce(F.col("leads") < F.col("first_open"), F.lit(True)), F.col("leads"))
        free = (F.coalesce("open", F.lit(0)) == 0) & F.col("leads").isNull()
        state = settle(joined.select("item_id", F.coalesce("leader", follows, F.when(free, F.col("item_id"))).alias("leader")))
        left = state.where("leader is null").count()
        if left and before - left < before / 10:
            state = settle(_finish_chains(down, state, bound))
            left = state.where("leader is null").count()
    return state


def _finish_chains(down: DataFrame, state: DataFrame, bound: int) -> DataFrame:
    """Decides open items that no outer neighbour touches any more: whole components of open links, or the least items of a large one."""
    free = state.where("leader is null").select("item_id")
    inner = settle(down.join(free, "item_id").join(free.withColumnRenamed("item_id", "low"), "low").select("item_id", "low"))
    # Decided neighbours that lead may still be followed: the least one goes with each item to its task.
    led = state.where("leader = item_id").select(F.col("item_id").alias("low"))
    outer = settle(down.join(free, "item_id").join(led, "low").groupBy("item_id").agg(F.min("low").alias("outer")))
    parts = components.connected_components(inner.select(F.col("item_id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "item_id")
    links = settle(inner.join(parts, "item_id"))
    sizes = links.groupBy("component").agg(F.count("*").alias("n"))
    small = links.join(sizes.where(F.col("n") <= bound).select("component"), "component")
    large = links.join(sizes.where(F.col("n") > bound).select("component"), "component")
    # The least items of a large component, with at most ``bound`` links: counted in ranges of items.
    counts = large.groupBy("component", "item_id").agg(F.count("*").alias("n"))
    first = scan(ranged(counts, "component", ("item_id",)), "component", ("item_id",), {"upto": F.col("n")}).where(F.col("upto") <= bound).select("component", "item_id")
    todo = small.select("component", "item_id", "low").unionByName(large.join(first, ["component", "item_id"]).select("component", "item_id", "low"))
    todo = todo.join(outer, "item_id", "left").join(outer.select(F.col("item_id").alias("low"), F.col("outer").alias("outer_low")), "low", "left")
    done = todo.select("component", "item_id", "low", "outer", "outer_low").groupBy("component").applyInArrow(_decided, "item_id long, leader long")
    return state.join(done.withColumnRenamed("leader", "now"), "item_id", "left").select("item_id", F.coalesce("leader", "now").alias("leader"))


def _decided(links: pa.Table) -> pa.Table:
    """Leaders of the items of a component's open links, in the order of items; ``outer`` is the least leader among an item's decided neighbours."""
    links = links.sort_by([("item_id", "ascending"), ("low", "ascending")])
    items, lows = links["item_id"].to_numpy(), links["low"].to_numpy()
    led_by = dict(zip(lows.tolist(), links["outer_low"].to_pylist(), strict=True)) | dict(zip(items.tolist(), links["outer"].to_pylist(), strict=True))
    cuts = np.append(np.flatnonzero(np.r_[True, items[1:] != items[:-1]]), len(items))
    # Items without an open smaller neighbour come first: only what is decided binds them.
    leader = {x: x if led_by[x] is None else led_by[x] for x in set(lows.tolist()) - set(items.tolist())}
    for s, e in zip(cuts, cuts[1:]):
        item = int(items[s])
        near = [x for x in lows[s:e].tolist() if leader[x] == x] + [x for x in (led_by[item],) if x is not None]
        leader[item] = min(near, default=item)
    return pa.table({"item_id": pa.array(leader.keys(), pa.int64()), "leader": pa.array(leader.values(), pa.int64())})


def classify_groups(pairs: DataFrame) -> DataFrame:
    """From pairs (cluster_id, distance, cosine): duplicate if the mean distance is below 3 or the mean cosine above 0.95."""
    return classify_means(pairs.groupBy("cluster_id").agg(F.avg("distance").alias("distance"), F.avg("cosine").alias("cosine")))


def classify_means(df: DataFrame) -> DataFrame:
    """The same from one row a cluster with the mean distance and the mean cosine, null where there is none."""
    return df.withColumn("kind", F.when(F.coalesce(F.col("distance") < 3, F.lit(False)) | F.coalesce(F.col("cosine") > 0.95, F.lit(False)), "duplicate").otherwise("similar"))


def recommend(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """From pairs (a, b, distance, cosine): remove, review or keep per item, and the ids that are similar."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance", "cosine"))
    near = (F.col("distance") <= 5) | (F.col("cosine") >= 0.85)
    same = (F.col("distance") < 3) | (F.col("cosine") > 0.95)
    per = both.groupBy(F.col("a").alias("item_id")).agg(F.max(same).alias("same"), F.max(near).alias("near"), F.sort_array(F.collect_set(F.when(near, F.col("b")))).alias("similar"))
    df = items.select("item_id").join(per, "item_id", "left")
    return df.select("item_id", F.when(F.col("same"), "remove").when(F.col("near"), "review").otherwise("keep").alias("action"), F.coalesce("similar", F.array().cast("array<long>")).alias("similar"))


def graded_actions(groups: DataFrame, t: Mapping[str, float] = PRESETS["balanced"]) -> DataFrame:
    """From members with size, avg (similarity of the group) and best (whether it is the kept one)."""
    a = F.col("avg")
    rest = F.when(a >= t["identical"], F.when(F.col("best"), "keep_best").otherwise("remove_identical")).when(a >= t["near_duplicate"], F.when(F.col("best"), "keep_best").otherwise("review_duplicate")).when(a >= t["similar"], "review_similar").otherwise("keep_different")
    return groups.withColumn("action", F.when(F.col("size") == 1, "keep_unique").otherwise(rest))


def cluster_quality(clusters: DataFrame, pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(cluster_id, size, quality) of clusters with enough mean cosine; alone 1.0, without vectors 0.5."""
    return quality_of_means(clusters, pairs.groupBy("cluster_id").agg(F.avg("cosine").alias("mean")), least)


def quality_of_means(clusters: DataFrame, means: DataFrame, least: float = 0.7) -> DataFrame:
    """The same from the mean cosine of each cluster (cluster_id, mean)."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    df = sizes.join(means, "cluster_id", "left")
    return df.select("cluster_id", "size", F.when(F.col("size") == 1, 1.0).otherwise(F.coalesce("mean", F.lit(0.5))).alias("quality")).where(F.col("quality") >= least)


def threshold_config(use_case: str = "balanced", overrides: Mapping[str, object] | None = None) -> dict[str, object]:
    """A preset with valid overrides: min_cluster_size an int of 1 to 10, others numbers of 0 to 1; the rest is ignored."""
    out: dict[str, object] = dict(PRESETS.get(use_case, PRESETS["balanced"])) | {"min_cluster_size": 2}
    for k, v in (overrides or {}).items():
        number = isinstance(v, int | float) and not isinstance(v, bool)
        if k == "min_cluster_size" and isinstance(v, int) and number and 1 <= v <= 10 or k in out and k != "min_cluster_size" and number and 0 <= v <= 1:
            out[k] = v
    return out


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """item_id, phash, dhash, ahash of decoded images (item_id, height, width, channels, data), 16 hex digits each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *hash_image(np.frombuffer(d, np.uint8).reshape(h, w, c))) for i, h, w, c, d in zip(pdf["item_id"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True)]
            yield pd.DataFrame(rows, columns=["item_id", "phash", "dhash", "ahash"])

    return images.select("item_id", "height", "width", "channels", "data").mapInPandas(run, "item_id string, phash string, dhash string, ahash string")


def _shrink(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over an even grid."""
    rows = np.linspace(0, gray.shape[0], h + 1).astype(int)
    cols = np.linspace(0, gray.shape[1], w + 1).astype(int)
    return np.array([[gray[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:])] for a, b in zip(rows, rows[1:])])


def hash_image(bgr: np.ndarray) -> tuple[str, str, str]:
    px = bgr.astype(np.float64)
    gray = px[:, :, 0] if px.shape[2] == 1 else 0.299 * px[:, :, 2] + 0.587 * px[:, :, 1] + 0.114 * px[:, :, 0]
    hex16 = lambda bits: f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"
    n = 32
    k = np.arange(n)
    dct = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    low = (dct @ _shrink(gray, n, n) @ dct.T)[:8, :8]
    eight, nine = _shrink(gray, 8, 8), _shrink(gray, 8, 9)
    above = lambda a, b: np.round(a, 9) > np.round(b, 9)  # noqa: E731  ties must not hang on the order of sums
    return hex16(above(low, np.median(low))), hex16(above(nine[:, 1:], nine[:, :-1])), hex16(above(eight, eight.mean()))
