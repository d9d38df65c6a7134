"""Importance resampling to a target distribution: documents are drawn by how much likelier their n-grams are in the target.

N-grams of up to ``longest`` words are hashed to buckets (crc32). From the counts of all documents and of all target texts each bucket has a
gain, an array that is broadcast (eight bytes a bucket), and a document's weight is the floored mean gain of its n-grams. The score adds Gumbel noise that follows
from ``seed`` and doc_id, so that the highest scores are a draw without replacement, the same in every run.

The cutoff is found by weighted median-of-medians selection. Keys (score descending, doc_id, position) are sorted once within each partition and written
with their place in it. A round takes the median of what remains of each partition, and of these medians the one in the middle by the
partitions' remaining sizes: at least a quarter of what remains lies on either side, so each round discards at least that, and
counting which places lie before the pivot says which side. Driver and closures hold one range of places for each partition. When few keys remain, or the pivot has
the wanted rank, the cutoff is exact. Only the keys up to it are sorted globally, by ranges, to be numbered.

Defined results: every row gives one row, repeated ones too; a null text has no features and weight 0; a null doc_id counts as empty text in the hash and comes after
the others at equal scores; rows with equal doc_id and score are drawn in the order of n_features, and are interchangeable beyond it; other columns are ignored,
whatever their names; an empty table gives no rows; without target texts the target's counts are 0. Very long texts are cut into slices
for hashing, so that a task holds some thirty bytes for each of their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.shared import shared_path, small_batches
from winnower.operators.windows import global_rank


@dataclass(frozen=True)
class Resampling:
    longest: int = 1
    buckets: int = 10000
    seed: str = "2024"
    least_words: int = 20
    percent: int = 10
    finish: int = 4096


_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_LONG = 48


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of spans of bytes: byte by byte for all spans that are that long, one by one for the few long ones."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size, starts = size[order], starts[order]
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -_LONG))
    for t in range(int(size[long]) if long < len(size) else 0):
        live = crc[long : int(np.searchsorted(-size, -t))]
        live[:] = _CRC[(live ^ data[starts[long : long + len(live)] + t]) & 0xFF] ^ (live >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]])
    out = np.empty(len(crc), np.uint32)
    out[order] = crc
    return out


def features(data: np.ndarray, bounds: np.ndarray, fit: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text of each, and the number of words of each text."""
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, bounds, _WORD[data])
    own = tb.owner(first)
    found, whose = [crc32_of_spans(data, starts, ends)], [own]
    if fit.longest > 1:
        # Longer runs are joined by one space: their words are copied next to each other with one behind each.
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - lengths - 1
        plain = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
        plain[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
        for k in range(2, fit.longest + 1):
            i = np.flatnonzero(own[k - 1 :] == own[: len(own) - k + 1])
            found.append(crc32_of_spans(plain, at[i], at[i + k - 1] + lengths[i + k - 1]))
            whose.append(own[i])
    return (np.concatenate(found) % np.uint32(fit.buckets)).astype(np.int64), np.concatenate(whose), np.diff(first)


def bucket_counts(texts: DataFrame, fit: Resampling = Resampling()) -> DataFrame:
    """(bucket, n) over all rows of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(fit.buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in tb.chunks(batch.column(0)):
                total += np.bincount(features(data, bounds, fit)[0], minlength=fit.buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, fit: Resampling = Resampling()) -> np.ndarray:
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) for each bucket: ``buckets`` rows come to the driver."""
    small_batches(docs.sparkSession)
    s, t = np.zeros(fit.buckets), np.zeros(fit.buckets)
    for into, texts in ((s, docs), (t, target)):
        for r in bucket_counts(texts, fit).collect():
            into[r.bucket] = r.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + fit.buckets) / ((s + 1) * (t.sum() + fit.buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, fit: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(1)):
                at, own, words = features(data, bounds, fit)
                n = np.bincount(own, minlength=hi - lo)
                sums = np.bincount(own, shared.value[at], hi - lo).astype(np.int64)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(n), pa.array(sums // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{fit.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


#: Sorted ascending, the first is the first drawn; ``place`` makes keys unique.
KEY = ["low", "late", "doc_id", "n_features", "part", "place"]


def cutoff(keys: DataFrame, rank: int, finish: int = 4096) -> tuple:
    """The key with ``rank`` - 1 keys before it. ``keys`` has the columns of KEY, sorted by them within each part, places from 0."""
    spark = keys.sparkSession
    key = F.struct(*KEY)
    ranges = {r.part: (0, r.n) for r in keys.groupBy("part").agg(F.count("*").alias("n")).collect()}
    while True:
        left = sum(hi - lo for lo, hi in ranges.values())
        rows = [(part, lo, hi) for part, (lo, hi) in ranges.items() if lo < hi]
        open_parts = keys.join(F.broadcast(spark.createDataFrame(rows, "part long, lo long, hi long")), "part")
        if left <= finish:
            rest = open_parts.where("place >= lo and place < hi").select(*KEY).orderBy(*KEY).collect()
            return tuple(rest[rank - 1])
        medians = open_parts.where("place = (lo + hi) div 2").select(*KEY, (F.col("hi") - F.col("lo")).alias("size")).collect()
        medians.sort(key=lambda r: tuple((x is not None, x or 0) for x in r[:-1]))
        half, at = -left / 2, 0
        while (half := half + medians[at].size) < 0:
            at += 1
        pivot = tuple(medians[at])[:-1]
        before = {r.part: r.n for r in open_parts.where("place >= lo and place < hi").groupBy("part").agg(F.count_if(key < _literal(pivot)).alias("n")).collect()}
        n = sum(before.values())
        if n == rank - 1:
            return pivot
        if n >= rank:  # the cutoff lies before the pivot
            ranges = {p: (lo, lo + before.get(p, 0)) for p, (lo, hi) in ranges.items()}
        else:
            own = pivot[KEY.index("part")]
            ranges = {p: (lo + before.get(p, 0) + (p == own), hi) for p, (lo, hi) in ranges.items()}
            rank -= n + 1


def _literal(key: tuple):
    kinds = {"late": "boolean"}
    return F.struct(*(F.lit(x).cast(kinds.get(name, "long")).alias(name) for name, x in zip(KEY, key, strict=True)))


def resample(docs: DataFrame, target: DataFrame, fit: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each row of ``docs`` (doc_id, text); ``target`` has a column text."""
    scored = weigh(docs, gains(docs, target, fit), fit)
    spark = docs.sparkSession
    free = F.col("n_words") >= fit.least_words
    keys = scored.withColumns({"low": -F.col("score"), "late": F.col("doc_id").isNull(), "free": free})
    keys = keys.sortWithinPartitions(F.desc("free"), "low", "late", "doc_id", "n_features")
    keys = keys.withColumns({"part": F.spark_partition_id().cast("long"), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    path = shared_path(spark, "resampling-keys")
    keys.drop("n_words", "score").write.parquet(path)
    keys = spark.read.schema("doc_id long, n_features long, weight long, low long, late boolean, free boolean, part long, place long").parquet(path)
    able = keys.where("free")
    drawn = able.count() * fit.percent // 100
    out = lambda df, rank: df.select("doc_id", "n_features", "weight", (-F.col("low")).alias("score"), rank.alias("rank"))
    none = F.lit(None).cast("long")
    if not drawn:
        return out(keys, none)
    last = _literal(cutoff(able, drawn, fit.finish))
    wins = F.col("free") & (F.struct(*KEY) <= last)
    winners = global_rank(keys.where(wins).select(*KEY, "weight"), KEY, "rank")
    return out(winners, (F.col("rank") + 1).cast("long")).unionByName(out(keys.where(~wins), none))
