"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are lower-cased by Spark and folded to letters and digits with single spaces between. An item is cut
into overlapping windows. If a window of m characters stands in a text with at most e edits, the two
share at least (m - q + 1) - q * e of their q-grams, and their diagonals (place in the text less place in
the window) lie within e of each other. So:

* One scan of the texts keeps the stretches that hold so many q-grams of any window close together, told by a
  bitmap of the benchmark's q-grams, one for whole windows and one for shorter ones. The two are all that is broadcast or reaches the
  driver: each has 16 bits for each q-gram and at most 2^``most_bits`` bits (32 MB, so 64 MB in all), beyond which more stretches pass
  and nothing is lost. Stretches are cut into overlapping slices of bounded length.
* Slices and windows are joined by q-gram. The q-grams that stand in more than ``hot`` windows are left out of the join, the commonest
  first and no more of a window than it can spare; the others have to be shared in the number that is left.
* Each candidate pair counts its shared q-grams in diagonal bands that overlap by half; bands that reach the count are
  aligned (semi-global edit distance within the band), and those within the budget are leaks.

No step loses a window within its edit budget. The benchmark stays in tables of Spark, windows of equal text are one; tasks hold
one batch of texts or of bounded slices, also where a text repeats one letter a million times.

Defined results: null texts or items hold nothing; items of fewer than ``q`` folded characters can't be told
from chance and match nothing; rows that repeat a doc_id are one document, and those without one are one as well; other columns are
ignored; empty tables give no rows; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.shared import settle, small_batches
from winnower.llm.token_blocks import slot_bits


@dataclass(frozen=True)
class Search:
    """q-gram length, window length and step in characters, edits allowed in a hundred characters."""

    q: int = 10
    window: int = 100
    step: int = 25
    edit_percent: int = 6
    slice: int = 2048
    hot: int = 8
    most_bits: int = 28

    def edits(self, m: int) -> int:
        return min(m * self.edit_percent // 100, max(0, (m - self.q) // self.q))

    def need(self, m: int) -> int:
        """How many q-grams a window of ``m`` characters shares at least with a text that holds it."""
        return m - self.q + 1 - self.q * self.edits(m)

    @property
    def half_band(self) -> int:
        return 2 * self.edits(self.window) + 1

    @property
    def reach(self) -> int:
        """No window within its budget spans more characters of a text."""
        return self.window + self.edits(self.window)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
for _i in range(26):
    _FOLD[[ord("a") + _i, ord("A") + _i]] = ord("a") + _i


def fold(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their bounds, and the place of each in the original bytes."""
    text = _FOLD[data]
    keep = text != 32
    after = np.zeros(len(text), bool)
    after[1:] = keep[:-1]
    inner = bounds[:-1][bounds[:-1] < len(text)]
    after[inner] = False
    at = np.flatnonzero(keep | after)
    return text[at], np.searchsorted(at, bounds), at


def _grams(text: np.ndarray, q: int) -> np.ndarray:
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums, at = tb.prefix_sums(text), np.arange(n)
    return tb.span_hashes(sums, at, at + q)


def align(text: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, patterns: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern anywhere in its band of ``width`` diagonals from ``begin``, and where it ends.

    ``low`` and ``high`` bound each text; the band's cells outside of it are out of reach.
    """
    far = 1 << 20
    k = np.arange(width)
    at = begin[:, None] + k
    cost = np.where((at >= low[:, None]) & (at <= high[:, None]), 0, far)
    best, end = np.full(len(begin), far), np.zeros(len(begin), np.int64)
    for j in range(int(sizes.max(initial=0))):
        at = begin[:, None] + j + k  # the character that this cell takes
        inside = (at >= low[:, None]) & (at < high[:, None])
        char = text[np.clip(at, 0, len(text) - 1)]
        new = np.where(inside, cost + (char != patterns[:, j, None]), far)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new = np.minimum.accumulate(new - k, axis=1) + k
        cost = new
        done = sizes == j + 1
        if done.any():
            best[done], end[done] = cost[done].min(axis=1), begin[done] + j + 1 + cost[done].argmin(axis=1)
    return best, end


def windows(folded: np.ndarray, s: Search) -> list[np.ndarray]:
    """The windows of a folded item, the last one ending with it; none if it is shorter than a q-gram."""
    m = len(folded)
    if m < s.q:
        return []
    return [folded[at : at + s.window] for at in ([0] if m <= s.window else [*range(0, m - s.window, s.step), m - s.window])]


def _windows(s: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(1)):
                text, edges, _ = fold(data, bounds)
                cut = [windows(text[b:e], s) for b, e in zip(edges, edges[1:], strict=False)]
                ids = np.repeat(np.arange(lo, hi), [len(x) for x in cut])
                yield pa.record_batch([batch.column(0).take(pa.array(ids)), pa.array([w.tobytes() for x in cut for w in x], pa.binary())], names=["item_id", "w"])

    return run


def _counted_grams(s: Search, bits=None):
    """(id, gram, times) of the q-grams of each binary, all or those in the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(raw, np.uint8)
                g = _grams(fold(data, np.array([0, len(data)]))[0], s.q)
                g = g if bits is None else g[_inside(bits.value[0], g) | _inside(bits.value[1], g)]
                g, times = np.unique(g, return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(g), i)), pa.array(g.view(np.int64)), pa.array(times.astype(np.int32))], names=["id", "g", "times"])

    return run


def _inside(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether the bitmap, of 64-bit words, has the grams' leading bits."""
    at = (grams >> np.uint64(64 - 6 - int(len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def _bitmaps(grams: DataFrame, bits: int, s: Search) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of 2^``bits`` bits of the grams of whole windows and of shorter ones, packed by tasks: the driver gets their bytes alone."""
    half = F.when(F.col("m") < s.window, F.lit(1 << bits)).otherwise(F.lit(0))
    slot = half.bitwiseOR(F.shiftrightunsigned("g", 64 - bits).cast("int"))
    both = slot_bits(grams.select(slot.alias("slot")), bits + 1)[: 1 << (bits - 2)].view(np.uint64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def dense(place: np.ndarray, doc: np.ndarray, need: int, edges: np.ndarray, s: Search) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches around ``need`` places of one text that fit in the reach of a window."""
    k = max(need, 1) - 1
    n = max(0, len(place) - k)
    first, last = place[:n], place[k:]
    good = (last - first <= s.reach - s.q) & (doc[:n] == doc[k:])
    first, last, doc = first[good], last[good], doc[:n][good]
    return np.maximum(last + s.q - s.reach - 2, edges[doc]), np.minimum(first + s.reach + 2, edges[doc + 1])


def stretches(text: np.ndarray, edges: np.ndarray, bits: tuple[np.ndarray, np.ndarray], need: tuple[int, int], s: Search) -> list[tuple[int, int]]:
    """Slices of some folded texts that together hold every stretch with enough q-grams of the bitmaps (of whole windows, of shorter ones)."""
    found: list[list[np.ndarray]] = [[], []]
    block = 1 << 18
    for at in range(0, max(1, len(text) - s.q + 1), block):
        g = _grams(text[at : at + block + s.q - 1], s.q)
        for k in (0, 1):
            found[k].append(np.flatnonzero(_inside(bits[k], g)) + at)
    begins, ends = [], []
    for k in (0, 1):
        place = np.concatenate(found[k])
        doc = np.searchsorted(edges, place, "right") - 1
        own = place + s.q <= edges[doc + 1]
        b, e = dense(place[own], doc[own], need[k], edges, s)
        begins.append(b)
        ends.append(e)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.lexsort((end, begin))
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] >= end[:-1]
    begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1] if len(end) else end
    out = []
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        while True:
            out.append((b, min(e, b + s.slice)))
            if b + s.slice >= e:
                break
            b += s.slice - 2 * s.reach
    return out


def _scan(bits, need: tuple[int, int], s: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, bounds in tb.chunks(batch.column(1)):
                text, edges, original = fold(data, bounds)
                parts = stretches(text, edges, bits.value, need, s)
                if parts:
                    begin = original[np.array([b for b, _ in parts])]
                    end = original[np.array([e for _, e in parts]) - 1] + 1
                    doc = np.searchsorted(bounds, begin, "right") - 1
                    raw = [data[b:e].tobytes() for b, e in zip(begin, end, strict=True)]
                    ends: dict[tuple[int, bytes], list[int]] = {}  # of equal slices of a text the first and the last say all
                    for i, x in enumerate(zip(doc.tolist(), raw, strict=True)):
                        ends.setdefault(x, [i, i])[1] = i
                    kept = np.array(sorted({i for x in ends.values() for i in x}))
                    yield pa.record_batch([batch.column(0).take(pa.array(lo + doc[kept])), pa.array((begin - bounds[doc])[kept]), pa.array([raw[i] for i in kept], pa.binary())], names=["doc_id", "base", "part"])

    return run


def verify(parts: list[bytes], patterns: list[bytes], s: Search) -> Iterator[tuple[int, int, int, int]]:
    """(pair, edits, begin, end in bytes of the part) of each pair of a slice and a window that the slice holds."""
    raw = [np.frombuffer(x, np.uint8) for x in parts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    text, edges, original = fold(np.concatenate(raw), bounds)
    half, rows, bands = s.half_band, [], []
    for i, w in enumerate(patterns):
        own = _grams(np.frombuffer(w, np.uint8), s.q)
        order = np.argsort(own, kind="stable")
        g = _grams(text[edges[i] : edges[i + 1]], s.q)
        first, end = np.searchsorted(own[order], g, "left"), np.searchsorted(own[order], g, "right")
        n = end - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        band = (np.repeat(np.arange(len(g)), n) - order[at] + s.window) // half
        band, n = np.unique(np.concatenate([band, band - 1]), return_counts=True)  # a band is two halves; they overlap
        band = band[(n >= s.need(len(w))) & (band >= 0)]
        rows.append(np.full(len(band), i))
        bands.append(band)
    row, band = np.concatenate(rows), np.concatenate(bands)
    if not len(row):
        return
    sizes = np.array([len(w) for w in patterns])
    shown = np.zeros((len(patterns), s.window), np.uint8)
    for i, w in enumerate(patterns):
        shown[i, : len(w)] = np.frombuffer(w, np.uint8)
    slack = s.edits(s.window)
    edits, end = align(text, edges[row], edges[row + 1], edges[row] + band * half - s.window - slack, shown[row], sizes[row], 2 * half + 2 * slack + 1)
    for i, x, e in zip(row.tolist(), edits.tolist(), end.tolist(), strict=True):
        if x <= s.edits(int(sizes[i])):
            lo = max(e - int(sizes[i]), int(edges[i]))
            yield i, x, int(original[lo] - bounds[i]), int(original[min(e, int(edges[i + 1])) - 1] + 1 - bounds[i])


def _verified(s: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = list(verify(part.column(3).to_pylist(), part.column(4).to_pylist(), s))
                if rows:
                    i, edits, begin, end = (np.array(x) for x in zip(*rows, strict=True))
                    base = part.column(1).to_numpy()[i]
                    yield pa.record_batch([part.column(0).take(pa.array(i)), part.column(2).take(pa.array(i)), pa.array(edits.astype(np.int32)), pa.array(base + begin), pa.array(base + end)], names=["doc_id", "class", "edits", "begin", "end"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: Search = Search()) -> DataFrame:
    """One row per document and benchmark item of which it holds a window: how many windows, the item's windows, the least edits, the span in UTF-8 bytes of the lower-cased text."""
    spark = docs.sparkSession
    small_batches(spark)
    lower = F.lower(F.col("text").cast("string")).alias("text")
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), lower)
    cut = settle(items.mapInArrow(_windows(s), "item_id long, w binary").groupBy("item_id", "w").agg(F.count("*").alias("times")))
    classes = settle(cut.select("w").distinct().withColumn("class", F.monotonically_increasing_id()))
    grams = settle(classes.select("class", "w").mapInArrow(_counted_grams(s), "class long, g long, times int").join(classes.select("class", F.octet_length("w").alias("m")), "class"))

    # Shorter windows need fewer q-grams, so they have a bitmap of their own.
    facts = grams.agg(F.count("*").alias("n"), F.min("m").alias("least")).first()
    need = (s.need(s.window), min([s.window, *(s.need(m) for m in range(facts["least"] or s.window, s.window))]))
    bits = int(min(s.most_bits, max(16, np.ceil(np.log2(facts["n"] + 1)) + 4)))
    shared = spark.sparkContext.broadcast(_bitmaps(grams, bits, s))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower)
    slices = settle(rows.mapInArrow(_scan(shared, need, s), "doc_id long, base long, part binary").withColumn("slice", F.monotonically_increasing_id()))

    # Of each window as many of its common q-grams are left out as it can spare; the rest of its need is what is left.
    common = grams.groupBy("g").agg(F.count("*").alias("f")).where(F.col("f") > s.hot)
    spare = F.col("m") - s.q + 1 - s.q * F.least(F.floor(F.col("m") * s.edit_percent / 100), F.greatest(F.floor((F.col("m") - s.q) / s.q), F.lit(0)))
    ranked = grams.join(common, "g", "left").withColumn("need", spare.cast("long"))
    upto = F.sum("times").over(W.partitionBy("class").orderBy(F.desc_nulls_last("f"), "g"))
    ranked = ranked.withColumn("out", F.col("f").isNotNull() & (upto < F.col("need")))
    left = F.col("need") - F.coalesce(F.sum(F.when(F.col("out"), F.col("times"))).over(W.partitionBy("class")), F.lit(0))
    index = ranked.withColumn("left", left).where("not out").select("g", "class", F.col("times").alias("most"), "left")
    met = slices.select("slice", "part").mapInArrow(_counted_grams(s, shared), "slice long, g long, times int").join(index, "g")
    pairs = met.groupBy("slice", "class", "left").agg(F.sum(F.least("times", "most")).alias("n")).where("n >= left").select("slice", "class")
    found = pairs.join(slices, "slice").join(classes, "class").select("doc_id", "base", "class", "part", "w").mapInArrow(_verified(s), "doc_id long, class long, edits int, begin long, end long")
    spans = [F.min("edits").alias("edits"), F.min("begin").alias("begin"), F.max("end").alias("end")]
    found = found.groupBy("doc_id", "class").agg(*spans).join(cut.join(classes, "w").select("item_id", "class", "times"), "class")
    found = found.groupBy("doc_id", "item_id").agg(F.sum("times").cast("int").alias("windows"), *spans)
    of_item = cut.groupBy("item_id").agg(F.sum("times").cast("int").alias("item_windows"))
    return found.join(of_item, "item_id").select("doc_id", "item_id", "windows", "item_windows", "edits", "begin", "end")
