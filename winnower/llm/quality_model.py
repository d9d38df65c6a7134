"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Tokens are the words of a text in lower case, and for each word its shape (classes of characters with
runs collapsed, as ``Aa.`` or ``a*``) and a mark if it repeats the word before. Every token falls into one of
``vocabulary`` hashed entries. An entry has a sparse random index vector; its context vector is the sum of
the index vectors of the tokens near it, collected by Spark tasks over the fitting sample and added up. A
document is the mean of its tokens' context vectors, with the logarithm of its length. The network (tanh
hidden layer, sigmoid output) is fitted with Adam; its logits are divided by a temperature chosen on
documents that were not fitted.

The fit sees at most ``Fit.rows`` labelled documents (a bounded sample); all texts are scored whole. The
driver gets one fixed-length vector per sampled document and tables of fixed size, never texts.

Defined results: a null or wordless text is an empty document with a score of its own; rows that repeat
are scored alike; other columns are ignored; an empty table gives no rows; without labels of both
kinds the score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.samples import labelled_sample
from winnower.llm.shared import crc_remainder, small_batches


@dataclass(frozen=True)
class Fit:
    rows: int = 4000
    vocabulary: int = 1 << 13
    dims: int = 48
    hidden: int = 24
    epochs: int = 60
    reach: int = 1
    folds: int = 5
    seed: int = 3


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -30, 30)))


#: Character classes: 0 space, 1 lower-case or non-ASCII, 2 upper-case, 3 digit, 4 sentence mark, 5 other sign.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[tb.SPACE] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4


def tokens(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all tokens (three for each word) and each text's first token (n+1 entries)."""
    return _tokens(data, bounds, size)[:2]


def _tokens(data: np.ndarray, bounds: np.ndarray, size: int, before: int | None = None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """The same and the hash of the last word; ``before`` is that of the word before, if the bytes go on with a text."""
    starts, ends, first = tb.words(data, bounds)
    low = tb.LOWER[data]
    hashes = tb.span_hashes(tb.prefix_sums(low), starts, ends)
    kinds = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    if len(data):
        change[starts] = True
    at = np.flatnonzero(change & (kinds > 0))
    runs = np.searchsorted(at, starts), np.searchsorted(at, ends)
    weight = np.concatenate([np.zeros(1, np.uint64), np.cumsum((kinds[at].astype(np.uint64) + np.uint64(1)) * tb.mix(np.minimum(np.arange(len(at)) - np.repeat(runs[0], runs[1] - runs[0]), 7).astype(np.uint64) + np.uint64(77)), dtype=np.uint64)])
    shapes = tb.mix(weight[runs[1]] - weight[runs[0]] + np.uint64(1))
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    fresh = first[:-1][first[:-1] < len(hashes)]
    again[fresh] = False
    if before is not None and len(hashes):
        again[0] = int(hashes[0]) == before
    out = np.empty(3 * len(hashes), np.int64)
    half = size // 2
    out[0::3] = (hashes % np.uint64(half)).astype(np.int64)
    out[1::3] = half + (shapes % np.uint64(half - 2)).astype(np.int64)
    out[2::3] = size - 2 + again
    return out, first * 3, int(hashes[-1]) if len(hashes) else before


def index_vectors(fit: Fit) -> np.ndarray:
    """Sparse random directions, the same in every task."""
    rng = np.random.default_rng(fit.seed)
    return rng.choice(np.array([-1, 0, 1], np.float32), (fit.vocabulary, fit.dims), p=[0.1, 0.8, 0.1])


def _contexts(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(fit), np.zeros((fit.vocabulary, fit.dims))  # whole numbers
        for batch in batches:
            for _, _, data, bounds in tb.chunks(batch.column(0)):
                entry, first = tokens(data, bounds, fit.vocabulary)
                own = tb.owner(first)
                for step in range(1, 3 * fit.reach + 1):
                    near = own[step:] == own[:-step]
                    a, b = entry[:-step][near], entry[step:][near]
                    for d in range(fit.dims):
                        total[:, d] += np.bincount(a, index[b, d], fit.vocabulary) + np.bincount(b, index[a, d], fit.vocabulary)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch([pa.array(used), pa.array(list(total[used].astype(np.int64)), pa.list_(pa.int64()))], names=["entry", "v"])

    return run


def pool(data: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """A row for each text: the mean vector of its tokens and the logarithm of its words. A text above ``limit`` bytes is counted in slices."""
    size = len(vectors)
    if len(bounds) > 2 or len(data) <= limit:
        return _pool(*tokens(data, bounds, size), vectors)
    counts, last = np.zeros(size), None
    for part in tb.slices(data, limit):
        entry, _, last = _tokens(part, np.array([0, len(part)]), size, last)
        counts += np.bincount(entry, minlength=size)
    return np.append(counts @ vectors / max(counts.sum(), 1), np.log1p(counts.sum() / 3))[None]


def _pool(entry: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    out = np.zeros((len(n), vectors.shape[1] + 1))
    full = np.flatnonzero(n)
    if len(full):
        out[full, :-1] = np.add.reduceat(vectors[entry], first[:-1][full], axis=0) / n[full, None]
    out[:, -1] = np.log1p(n / 3)
    return out


def pooled(vectors, fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(0)):
                x = pool(data, bounds, vectors.value)
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "fold", "x"])

    return run


def _train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, vectors: np.ndarray, fit: Fit) -> Model:
    blank = Model(vectors, np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    if len(set(y.tolist())) < 2:
        blank.prior = float(y.mean()) if len(y) else 0.5
        return blank
    held = fold < 100 // fit.folds
    held = held if 0 < held.sum() < len(y) and len(set(y[~held].tolist())) == 2 else np.zeros(len(y), bool)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(fit.seed)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], fit.hidden)), np.zeros(fit.hidden), rng.normal(0, 1 / np.sqrt(fit.hidden), fit.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    rows = np.flatnonzero(~held)
    for _ in range(fit.epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), 64):
            xb, yb = z[rows[at : at + 64]], y[rows[at : at + 64]]
            h = np.tanh(xb @ p[0] + p[1])
            e = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb
            back = e[:, None] * p[2] * (1 - h * h)
            grads = [xb.T @ back / len(yb) + 1e-4 * p[0], back.mean(axis=0), h.T @ e / len(yb) + 1e-4 * p[2], np.array([e.mean()])]
            step += 1
            for a, g, ma, va in zip(p, grads, m, v, strict=True):
                ma += 0.1 * (g - ma)
                va += 0.001 * (g * g - va)
                a -= 0.003 * (ma / (1 - 0.9**step)) / (np.sqrt(va / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held.any():
        logit = np.tanh(z[held] @ p[0] + p[1]) @ p[2] + p[3]
        loss = lambda t: np.logaddexp(0, np.where(y[held] == 1, -logit / t, logit / t)).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), label: str = "quality") -> Model:
    """Fits on a bounded sample of the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = labelled_sample(docs, labels, label, crc_remainder("doc_id", 5) != 0, fit.rows)
    vectors = np.zeros((fit.vocabulary, fit.dims), np.float32)
    sums = sample.select("text").mapInArrow(_contexts(fit), "entry long, v array<long>").groupBy("entry").agg(*(F.sum(F.col("v")[d]).alias(f"v{d}") for d in range(fit.dims)))
    table = sums.toPandas()  # at most one row per entry
    if len(table):
        raw = table.drop(columns="entry").to_numpy(np.float64)
        vectors[table["entry"].to_numpy()] = raw / (np.linalg.norm(raw, axis=1, keepdims=True) + 1e-9)
    shared = spark.sparkContext.broadcast(vectors)
    pdf: pd.DataFrame = sample.select("text", "label", "fold").mapInArrow(pooled(shared, fit), "label int, fold int, x array<double>").toPandas()
    x = np.stack(pdf["x"].to_list()) if len(pdf) else np.zeros((0, fit.dims + 1))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # the same fit in every run
    return _train(x[order], pdf["label"].to_numpy(np.float64)[order], pdf["fold"].to_numpy()[order], vectors, fit)


def score(docs: DataFrame, model: Model, fit: Fit = Fit(), threshold: float = 0.3) -> DataFrame:
    """``docs`` with the columns score and predicted, which replace any of these names; other columns pass through."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = shared.value
        out = [m.probabilities(pool(data, bounds, m.vectors)) for _, _, data, bounds in tb.chunks(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", scored(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
