"""Language identification: TF-IDF n-gram vectors against several clustered centroids per language.

A text is put in lower case by Spark, with single spaces for all ASCII that is no letter; its byte pairs and triples are
hashed to ``dims`` entries, weighted by log(1 + count) and inverse document frequency (of at least 1), and normalised.
Document frequencies are counted over all learning rows. For each language at most ``per_language``
learning rows (a bounded sample by hash of doc_id) are clustered into ``clusters`` centroids by cosine, a group
for each language, however rare; only centroids reach the driver and are broadcast, 64 KB for a language. The languages are counted
first: more than ``most_languages`` (256 MB of centroids) raise an error, as from a column that doesn't hold languages. A text has the language of its nearest centroid. ``rejected`` tells that it lies farther from
it than all but one in a hundred of the sampled texts, with a margin; the prediction itself stays.

Defined results: ``und`` with score 0 for a null text, for one without a letter, and if no language was
learned; rows that repeat are predicted alike; other columns pass through, but for those of the result's names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.shared import few, free_name, settle, small_batches


@dataclass(frozen=True)
class Fit:
    dims: int = 2048
    per_language: int = 400
    clusters: int = 4
    margin: float = 0.05
    most_languages: int = 4096
    seed: int = 17


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray


_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _i in range(26):
    _FOLD[[ord("a") + _i, ord("A") + _i]] = ord("a") + _i


#: Bytes of text counted at a time, and texts whose counts are held at a time.
_PIECE, _ROWS = 1 << 19, 128


def counts(data: np.ndarray, bounds: np.ndarray, dims: int) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    n = len(bounds) - 1
    text = _FOLD[data]
    own = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds)) if n > 1 else None
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    text, own = text[keep], own[keep] if n > 1 else None
    out = np.zeros(n * dims)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    for s in range(0, len(text), _PIECE):  # with the two bytes before, for the grams that begin there
        lo, hi = max(0, s - 2), min(s + _PIECE, len(text))
        part = text[lo:hi].astype(np.uint32)
        gram = part
        for k in (1, 2):
            if len(part) <= k:
                break
            gram = gram[:-1] * np.uint32(257) + part[k:]
            entry = ((gram * np.uint32(2654435761)) >> shift).astype(np.int64)
            first = max(0, s - lo - k)
            if own is None:
                out += np.bincount(entry[first:], minlength=dims)
            else:
                same = own[lo + k : hi] == own[lo : hi - k]
                same[:first] = False
                out += np.bincount((own[lo + k : hi] * np.int64(dims) + entry)[same], minlength=n * dims)
    return out.reshape(n, dims)


def _units(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(fit.dims, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, bounds in tb.chunks(batch.column(0), rows=_ROWS):
                df += (counts(data, bounds, fit.dims) > 0).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(-1, fit.dims)), pa.array(np.append(rows, df))], names=["entry", "n"])

    return run


def _vectors(shared, fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(0), rows=_ROWS):
                x = _units(counts(data, bounds, fit.dims), shared.value).astype(np.float32)
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "doc_id", "x"])

    return run


def _clustered(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Centroids of spherical k-means, started from spread-out rows."""
    chosen = [0]
    while len(chosen) < min(fit.clusters, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-9:
            break
        chosen.append(int(near.argmin()))
    c = x[chosen].astype(np.float64)
    for _ in range(12):
        at = (x @ c.T).argmax(axis=1)
        c = np.stack([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _centroids(fit: Fit):
    """Centroids of one language's sample, with the distance that all but one in a hundred of their rows keep."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values("doc_id").iloc[:: max(1, len(pdf) // fit.per_language)]
        x = np.stack([np.frombuffer(v, np.float32) for v in part["x"]])
        c = _clustered(x, fit)
        cos = x @ c.T
        own = [cos[cos.argmax(axis=1) == k, k] for k in range(len(c))]
        radius = [float(np.quantile(o, 0.01)) - fit.margin if len(o) else 0.0 for o in own]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "centroid": [v.astype(np.float32).tobytes() for v in c], "radius": radius})

    return run


def train(docs: DataFrame, learn: Column, fit: Fit = Fit()) -> Model:
    """Fits on the rows of ``docs`` (doc_id, text, lang) that fulfil ``learn`` and have a text and a language."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"), F.col("lang").cast("string").alias("lang"))
    df = rows.select("text").mapInArrow(_frequencies(fit), "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).toPandas().set_index("entry")["n"]
    total = int(df.get(-1, 0))
    if not total:
        return Model(np.ones(fit.dims), np.zeros((0, fit.dims)), [], np.zeros(0))
    idf = 1 + np.log((1 + total) / (1 + df.reindex(range(fit.dims), fill_value=0).to_numpy()))
    # A share of each language by hash that holds its sample almost surely, then the exact sample.
    share = rows.groupBy(F.col("lang").alias("l")).agg(F.least(F.lit(1.0), (1.5 * fit.per_language + 20) / F.count("*")).alias("share"))
    share = settle(share)
    if (found := share.count()) > fit.most_languages:
        raise ValueError(f"{found} languages, more than most_languages ({fit.most_languages})")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = rows.join(few(share), F.col("lang") == F.col("l")).where(draw < F.col("share"))
    vectors = sample.select("text", "lang", "doc_id").mapInArrow(_vectors(spark.sparkContext.broadcast(idf), fit), "lang string, doc_id long, x binary")
    rows = vectors.groupBy("lang").applyInPandas(_centroids(fit), "lang string, k int, centroid binary, radius double").toPandas().sort_values(["lang", "k"])
    return Model(idf, np.stack([np.frombuffer(c, np.float32) for c in rows["centroid"]]).astype(np.float64), rows["lang"].to_list(), rows["radius"].to_numpy())


def detect(docs: DataFrame, model: Model, fit: Fit = Fit()) -> DataFrame:
    """``docs`` with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def detected(texts: pa.Array) -> pa.Array:
        m, langs, scores, far = shared.value, [], [], []
        names = np.array([*m.langs, "und"], object)
        for lo, hi, data, bounds in tb.chunks(texts, rows=_ROWS):
            plain = (_FOLD[data] != 32) & (data < 128)
            if hi - lo == 1:
                some = np.array([plain.any()])
            else:
                letters = np.concatenate([[0], np.cumsum(plain)])
                some = letters[bounds[1:]] > letters[bounds[:-1]]
            for i in np.flatnonzero(~some):
                some[i] = any(c.isalpha() for c in (texts[lo + i].as_py() or ""))
            if not m.langs:
                some[:] = False
            at, best = np.full(hi - lo, len(m.langs)), np.zeros(hi - lo)
            if some.any():
                cos = _units(counts(data, bounds, fit.dims), m.idf) @ m.centroids.T
                at, best = np.where(some, cos.argmax(axis=1), len(m.langs)), np.where(some, cos.max(axis=1), 0)
            langs.append(names[at])
            scores.append(np.clip(best, 0, 1))
            far.append(~some | (best < np.append(m.radius, 2)[at]))
        none = [np.zeros(0)]
        parts = [pa.array(np.concatenate(langs or none).tolist(), pa.string()), pa.array(np.concatenate(scores or none)), pa.array(np.concatenate(far or none).astype(bool))]
        return pa.StructArray.from_arrays(parts, names=["lang_pred", "score", "rejected"])

    rest, found = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")], free_name(docs, "_found")
    return docs.select(*rest, detected(F.lower(F.col("text").cast("string"))).alias(found)).select(*rest, f"{found}.*")
