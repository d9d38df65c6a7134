"""Near-duplicate groups: MinHash banding, verification on signatures and full sets, star components.

A document's set holds its distinct word shingles (five words by default; a shorter text is one
shingle of all its words; no words, an empty set). Documents are linked if the Jaccard similarity
of their sets reaches the threshold, and a group is a connected component of the links.

How no link between different texts is lost, without all pairs of a group:

* Equal sets collapse to one class with its least doc_id first, whatever their number.
* Many universal-hash minima per class are cut into bands; classes that agree in a band share a
  bucket. Bands are as long as they can be if a pair at the threshold is to miss all buckets with
  probability below 1e-6: 30 of 6 at 0.85, 36 of 5 at 0.80.
* Each bucket proposes only links to two centres, its least and its largest member. Proposed pairs
  pass a signature estimate and are then confirmed on the full sets. Components are taken.
* A bucket whose members now lie in one component has nothing to add: more links in it can't
  change the result. For members of buckets with several components the rest is exact: two sets that
  reach the threshold share a shingle among the first few of both, in one common order of all shingles.
  In the order of rarity these few are mostly shingles of one document alone. Pairs are joined by shingle
  and class of sizes, and only if what follows the shingle can suffice for both sizes, so that pages of one template with
  too much text of their own meet nobody, whatever their number. At each shingle one component has most documents;
  pairs within it are never joined. Pairs across components pass the signature estimate, are confirmed on full sets, and
  components are taken once more.

Defined results: a null or wordless text has an empty set, links with nothing and stays alone; a null
doc_id is a component of its own; rows that repeat a doc_id share a component; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.shared import pick, settle, small_batches
from winnower.operators.components import connected_components

_STEP = (np.random.default_rng(5).integers(1, 2**62, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, signature binary, bands array<long>"


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters: shingle length in words, similarity threshold in percent, bands and rows of the signature (0: by the threshold).

    ``slack`` is how far below the threshold a signature's estimate may lie before the pair is dropped
    unconfirmed; 0.17 is over six standard deviations at 180 minima. ``growth`` is the ratio of sizes that a size
    class of the exact search spans.
    """

    words: int = 5
    percent: int = 80
    bands: int = 0
    rows: int = 0
    slack: float = 0.17
    growth: float = 1.05

    def __post_init__(self) -> None:
        if not self.rows:
            object.__setattr__(self, "rows", next((r for r in range(12, 1, -1) if self.missed(180 // r, r) < 1e-6), 1))
        if not self.bands:
            object.__setattr__(self, "bands", 180 // self.rows)

    def missed(self, bands: int, rows: int) -> float:
        """The probability that a pair at the threshold agrees in no band."""
        return (1 - (self.percent / 100) ** rows) ** bands

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(11)
        k = self.bands * self.rows
        return (rng.integers(0, 2**31, k, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def _shingles(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and for each text the index of its first one (n+1 entries)."""
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, bounds)
    hashes = tb.word_hashes(data, starts, ends)
    counts = np.diff(first)
    sums = np.zeros(len(hashes), np.uint64)
    for k in range(length):
        if k < len(hashes):
            sums[: len(hashes) - k] += hashes[k:] * _STEP[k]
    out = tb.mix(sums)
    own = tb.owner(first)
    whole = np.arange(len(hashes)) + length <= first[1:][own] if len(own) else np.zeros(0, bool)
    for i in np.flatnonzero((counts > 0) & (counts < length)):  # one shingle of all words
        lo, hi = first[i], first[i + 1]
        out[lo] = tb.mix(np.array([(hashes[lo:hi] * _STEP[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64))[0]
        whole[lo] = True
    return out[whole], np.concatenate([[0], np.cumsum(np.bincount(own[whole], minlength=len(counts)))]).astype(np.int64)


def _features(p: NearDuplicates):
    mult, add = p.multipliers()
    k = p.bands * p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.random.default_rng(13).integers(1, 2**63, (p.bands, p.rows), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(1)):
                x, first = _shingles(data, bounds, p.words)
                counts = np.diff(first)
                full = np.flatnonzero(counts)
                minima = np.zeros((len(full), k), np.uint32)
                short = (x >> np.uint64(32)).astype(np.uint32)
                if len(full):
                    at = first[:-1][full]
                    for j in range(k):
                        minima[:, j] = np.minimum.reduceat(short * mult[j] + add[j], at)
                n, d1, d2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                for i in full:
                    own = np.unique(x[first[i] : first[i + 1]])
                    n[i], d1[i], d2[i] = len(own), own.sum(dtype=np.uint64), np.bitwise_xor.reduce(tb.mix(own * np.uint64(0x9E3779B97F4A7C15)))
                keys = tb.mix((minima.reshape(-1, p.bands, p.rows).astype(np.uint64) * salts).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64))
                keys = (keys & ~np.uint64(1)) | (np.arange(p.bands, dtype=np.uint64) & np.uint64(1))
                signature, bands = [None] * (hi - lo), [None] * (hi - lo)
                low = tb.mix(minima.astype(np.uint64)).astype(np.uint8)
                for r, i in enumerate(full):
                    signature[i], bands[i] = low[r].tobytes(), keys[r].view(np.int64)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "signature", "bands"],
                )

    return run


def _agree(p: NearDuplicates):
    """Keeps the pairs whose signatures agree in so many places that the threshold is in reach."""
    least = (p.percent / 100 - p.slack) * p.bands * p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = p.bands * p.rows
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, width) for i in (2, 3)]
            keep = (sides[0] == sides[1]).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _sets(p: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(1)):
                x, first = _shingles(data, bounds, p.words)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([np.unique(x[s:e]).view(np.int64) for s, e in zip(first, first[1:])], pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _full_sets(docs: DataFrame, ids: DataFrame, p: NearDuplicates) -> DataFrame:
    """(node, shingles) of the named documents. The ids are broadcast if they are few, else joined by shuffle."""
    texts = pick(docs, ids).select("doc_id", "text")
    return settle(texts.mapInArrow(_sets(p), "node long, shingles array<long>").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """Of the pairs (a, b) those whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("xa", "xb")).cast("long").alias("k"), (F.size("xa") + F.size("xb")).cast("long").alias("n"))
    return shared.where(F.col("k") * 100 >= (F.col("n") - F.col("k")) * p.percent).select("a", "b")


def _proposed(pairs: DataFrame, classes: DataFrame, p: NearDuplicates) -> DataFrame:
    """Of the pairs (a, b) those that sizes and signatures don't rule out."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    able = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent
    return pairs.join(side("a"), "a").join(side("b"), "b").where(able).select("a", "b", "sa", "sb").mapInArrow(_agree(p), "a long, b long")


def _heads(named: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """(node, component, n, x, most): the first shingles of each set, in the order of rarity, and the largest partner that they allow.

    Of n shingles in a common order, sets that reach the threshold share one among the first
    n - ceil(n * percent / 100) + 1 of each. Shingles of one document alone come first and match nothing.
    At the first shingle that two sets share, what follows it in either must suffice for the threshold: sets of n and m
    shingles have to share (n + m) * percent / (100 + percent) of them.
    """
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    common = each.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(common, "x").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))
    alone = F.col("n") - F.size("xs")
    first = F.col("n") - F.ceil(F.col("n") * p.percent / 100) + 1 - alone
    heads = ranked.where(first > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("xs", F.lit(1), first.cast("int"))["x"]).alias("i", "x"))
    left = (F.col("n") - F.col("alone") - F.col("i")).cast("long")
    most = F.floor((left * (100 + p.percent) - F.col("n") * p.percent) / p.percent)
    return heads.select("node", "n", "x", F.least(most, F.floor(F.col("n") * 100 / p.percent)).alias("most")).where(F.col("most") * 100 >= F.col("n") * p.percent).join(named, "node")


def _by_rare_shingles(named: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """Pairs (a, b) across components, among which are all that reach the threshold.

    The smaller set of a pair is joined to the size classes that it allows, the larger one to its own, and neither may be too large
    for the other. A pair within the component that has most documents at a shingle is never joined.
    """
    heads = settle(_heads(named, sets, p))
    count = heads.groupBy("x", "component").agg(F.count("*").alias("c"))
    main = count.groupBy("x").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("k")).where("k > 1")
    rest = settle(heads.join(main, "x").select("node", "n", "x", "most", "component", (F.col("component") == F.col("main")).alias("in_main")))
    at = lambda n: F.floor(F.log(n) / math.log(p.growth)).cast("long")
    side = lambda df, k, *more: df.select("x", *more, *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "most", "component")))
    small = lambda df: side(df.where("most >= n"), "a", F.explode(F.sequence(at(F.col("n")), at(F.col("most")))).alias("class"))
    large = lambda df: side(df, "b", at(F.col("n")).alias("class"))
    fits = (F.col("component_a") != F.col("component_b")) & F.col("n_b").between(F.col("n_a"), F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    pairs = small(rest.where("not in_main")).join(large(rest), ["x", "class"]).unionByName(small(rest.where("in_main")).join(large(rest.where("not in_main")), ["x", "class"]))
    return pairs.where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = settle(docs.mapInArrow(_features(p), FEATURES))
    digest = ["d1", "d2", "n_shingles"]
    nodes = features.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("node"))
    known = settle(features.select("doc_id", *digest).join(nodes, digest, "left").select("doc_id", "n_shingles", "node"))
    classes = known.where("doc_id = node").select("node").distinct()
    classes = settle(features.where("n_shingles > 0").join(classes, features.doc_id == classes.node, "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "signature", "bands").dropDuplicates(["node"]))

    members = classes.select("node", F.explode("bands").alias("key"))  # the last bit of a key says which end is the centre
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    buckets = settle(members.join(ends, "key"))
    starred = buckets.select(F.when(F.col("key").bitwiseAND(1) == 0, F.col("low")).otherwise(F.col("high")).alias("c"), "node").where("c <> node")
    pairs = settle(_proposed(starred.select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct(), classes, p))
    ends_of = lambda x: x.select(F.col("a").alias("node")).union(x.select(F.col("b").alias("node"))).distinct()
    links = settle(_confirmed(pairs, _full_sets(docs, ends_of(pairs), p), p))
    labels = settle(connected_components(links))

    # What is left: members of one bucket that lie in different components.
    named = buckets.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = settle(named.join(mixed, "key").select("node", "component").distinct())
    sets = _full_sets(docs, rest.select("node"), p)
    more = settle(_confirmed(settle(_proposed(_by_rare_shingles(rest, sets, p), classes, p)), sets, p))
    if more.take(1):
        labels = settle(connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    named = known.join(labels, known.node == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("component", known.node, "doc_id").alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
