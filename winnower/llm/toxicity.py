"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits in lower case. Features of a text are its distinct words, word pairs and
pairs with one word between, hashed to ``Fit.size`` coordinates. Each coordinate has its own learning
rate, and L1 keeps most weights at exactly zero, so that the model is a short list of coordinates and
weights: small to broadcast, whatever the size of the corpus.

The fit sees at most ``Fit.rows`` labelled documents (a bounded sample), dealt to ``Fit.shards`` shards by hash of doc_id.
In each of ``Fit.epochs`` rounds every shard is gone through in a fixed order from the common state and gives the
changes to z and n as three arrays; the next state adds to each coordinate the mean of the changes of the shards that
touched it. The driver gets ``Fit.shards`` rows a round, of at most 7 MB each, however many partitions Spark makes. Tasks hold one batch at a time.

Defined results: a null, empty or wordless text has the score of the bias alone; rows that repeat are
scored alike; other columns are ignored; an empty table gives no rows; without labels of both kinds the
score is the share of label 1 (0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.samples import labelled_sample
from winnower.llm.shared import crc_remainder, settle, small_batches


@dataclass(frozen=True)
class Fit:
    rows: int = 12000
    size: int = 1 << 18
    shards: int = 4
    epochs: int = 6
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1


@dataclass
class Model:
    """Coordinates in order with their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float


_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _lo, _hi in ("az", "AZ", "09"):
    _WORD[ord(_lo) : ord(_hi) + 1] = True
_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def features(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of words, pairs and skip-pairs, and the text that each belongs to."""
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, bounds, _WORD[data])
    h, own = tb.span_hashes(tb.prefix_sums(data), starts, ends), tb.owner(first)
    found, whose = [h], [own]
    for step, salt in ((1, _PAIR), (2, _SKIP)):
        near = own[step:] == own[:-step] if len(own) > step else np.zeros(0, bool)
        if near.any():
            found.append(tb.mix(h[:-step][near] * salt + h[step:][near]))
            whose.append(own[step:][near])
    return (np.concatenate(found) % np.uint64(size)).astype(np.int64), np.concatenate(whose)


def _sampled(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(0)):
                at, own = features(data, bounds, fit.size)
                pairs = np.unique(own * fit.size + at)
                cuts = np.searchsorted(pairs, np.arange(hi - lo + 1) * fit.size)
                x = [(pairs[s:e] % fit.size).astype(np.int32) for s, e in zip(cuts, cuts[1:])]
                rest = [batch.column(k).slice(lo, hi - lo) for k in (1, 2, 3)]
                yield pa.record_batch([*rest, pa.array(x, pa.list_(pa.int32()))], names=["doc_id", "shard", "label", "x"])

    return run


def _weights(z: np.ndarray, n: np.ndarray, fit: Fit) -> np.ndarray:
    return np.where(np.abs(z) <= fit.l1, 0.0, -(z - np.sign(z) * fit.l1) / ((fit.beta + np.sqrt(n)) / fit.alpha + fit.l2))


def passed(state: tuple[np.ndarray, np.ndarray], batches: Iterable[pa.RecordBatch], fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """z and n after the texts of some batches (label, x), one after another."""
    z, n = state[0].copy(), state[1].copy()
    for batch in batches:
        labels, xs = batch.column(0).to_pylist(), batch.column(1)
        for y, x in zip(labels, xs, strict=True):
            i = np.append(np.asarray(x.values), fit.size)  # the last coordinate is the bias
            zi, ni = z[i], n[i]
            w = _weights(zi, ni, fit)
            w[-1] = -zi[-1] / ((fit.beta + np.sqrt(ni[-1])) / fit.alpha + fit.l2)  # no L1 on the bias
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            root = np.sqrt(ni)
            n[i] = ni + g * g
            z[i] = zi + g - (np.sqrt(n[i]) - root) / fit.alpha * w
    return z, n


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches, cut where the shard changes."""
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
        for s, e in zip(cuts, cuts[1:]):
            if s < e:
                yield int(shards[s]), batch.select(["label", "x"]).slice(s, e - s)


def _round(state, fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in groupby(_pieces(batches), key=itemgetter(0)):
            z, n = passed(state.value, (piece for _, piece in own), fit)
            at = np.flatnonzero(n != state.value[1])
            parts = [pa.array([x.tobytes()], pa.binary()) for x in (at, (z - state.value[0])[at], (n - state.value[1])[at])]
            yield pa.record_batch([pa.array([shard]), *parts], names=["shard", "at", "dz", "dn"])

    return run


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), label: str = "toxic") -> Model:
    """Fits on a bounded sample of the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, label, crc_remainder("doc_id", 5) != 0, fit.rows, fit.shards)
    known = sample.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    if not known["n"] or known["p"] in (0.0, 1.0):
        p = np.clip(known["p"] or 0.0, 1e-9, 1 - 1e-9)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(fit.shards)).cast("int").alias("shard")
    rows = sample.select("text", "doc_id", shard, "label").mapInArrow(_sampled(fit), "doc_id long, shard int, label int, x array<int>")
    # A shard is whole in one partition and goes through in the same order in every run, whatever the number of partitions.
    rows = rows.repartition(4 * fit.shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id")
    rows = settle(rows.select("shard", "label", "x"))
    z, n = np.zeros(fit.size + 1), np.zeros(fit.size + 1)
    for _ in range(fit.epochs):
        state = spark.sparkContext.broadcast((z, n))
        dz, dn, touched = np.zeros_like(z), np.zeros_like(n), np.zeros(len(z), np.int64)
        for r in sorted(rows.mapInArrow(_round(state, fit), "shard long, at binary, dz binary, dn binary").collect()):  # a row for each shard
            at = np.frombuffer(r.at, np.int64)
            dz[at] += np.frombuffer(r.dz, np.float64)
            dn[at] += np.frombuffer(r.dn, np.float64)
            touched[at] += 1
        z += dz / np.maximum(touched, 1)
        n += dn / np.maximum(touched, 1)
        state.unpersist()
    w = _weights(z, n, fit)
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(-z[-1] / ((fit.beta + np.sqrt(n[-1])) / fit.alpha + fit.l2)))


def score(docs: DataFrame, model: Model, fit: Fit = Fit(), threshold: float = 0.5) -> DataFrame:
    """``docs`` with the columns score and predicted, which replace any of these names; other columns pass through."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        dense = np.zeros(fit.size)
        dense[m.at] = m.weight
        for lo, hi, data, bounds in tb.chunks(pa.array(texts, pa.string(), from_pandas=True)):
            at, own = features(data, bounds, fit.size)
            hit = dense[at] != 0
            pairs = np.unique(own[hit] * fit.size + at[hit])  # each feature of a text counts once
            sums = np.bincount(pairs // fit.size, dense[pairs % fit.size], hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(sums + m.bias, -30, 30))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", scored(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
