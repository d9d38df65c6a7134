"""Metrics of decoded images (R-01 to R-07): numpy over Arrow batches, one row out per image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.functions import scores as S

METRICS = "item_id string, width int, height int, file_size long, sharpness double, noise double, brightness double, contrast double, over_pct double, under_pct double, histogram_balance double, b double, g double, r double, grayscale boolean, decoded boolean"
_TAPS = np.array([1, 4, 6, 4, 1]) / 16.0


def gray(bgr: np.ndarray) -> np.ndarray:
    px = bgr.astype(np.float64)
    return px[:, :, 0] if px.shape[2] == 1 else np.floor(0.299 * px[:, :, 2] + 0.587 * px[:, :, 1] + 0.114 * px[:, :, 0] + 0.5)


def _mirrored(a: np.ndarray, n: int) -> np.ndarray:
    """Padded by reflection without repeating the edge; a side of one pixel repeats it."""
    return np.pad(a, n, mode="reflect") if min(a.shape) > n else np.pad(a, n, mode="symmetric" if min(a.shape) >= n else "edge")


def sharpness(g: np.ndarray) -> float:
    p = _mirrored(g, 1)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def noise(g: np.ndarray) -> float:
    p = _mirrored(g, 2)
    rows = sum(t * p[i : i + g.shape[0]] for i, t in enumerate(_TAPS))
    blurred = np.floor(sum(t * rows[:, i : i + g.shape[1]] for i, t in enumerate(_TAPS)) + 0.5)
    return float(np.abs(g - blurred).std() / 255)


def exposure_stats(g: np.ndarray) -> tuple[float, float, float, float, float]:
    """Brightness, contrast, shares of over- and underexposed pixels, balance of the histogram in five parts."""
    shares = [part.sum() / g.size for part in np.array_split(np.bincount(g.astype(np.int64).ravel(), minlength=256), 5)]
    return float(g.mean() / 255), float(g.std() / 255), float((g > 240).mean()), float((g < 15).mean()), float(1 - np.std(shares))


def shrink(bgr: np.ndarray, max_side: int) -> np.ndarray:
    """Block means, so that no side is above ``max_side``."""
    k = -(-max(bgr.shape[:2]) // max_side)
    if k < 2:
        return bgr
    h, w = bgr.shape[0] // k * k, bgr.shape[1] // k * k
    return np.floor(bgr[:h, :w].reshape(h // k, k, w // k, k, -1).mean(axis=(1, 3)) + 0.5).astype(np.uint8)


def quality_metrics(images: DataFrame, max_side: int = 2048) -> DataFrame:
    """All metrics and scores in one pass; an image that can't be decoded has zeros, noise 1 and fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf.itertuples(index=False):
                if x.height <= 0 or x.width <= 0:
                    rows.append((x.item_id, 0, 0, x.file_size, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, False))
                    continue
                px = shrink(np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.channels), max_side)
                g = gray(px)
                means = [float(v) for v in px.reshape(-1, px.shape[2]).mean(axis=0)]
                b, gr, r = (means * 3)[:3] if len(means) < 3 else means[:3]
                light, contrast, over, under, balance = exposure_stats(g)
                rows.append((x.item_id, x.width, x.height, x.file_size, sharpness(g), noise(g), light, contrast, over, under, balance, b, gr, r, px.shape[2] == 1, True))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METRICS.split(", ")])

    df = images.select("item_id", "file_size", "height", "width", "channels", "data").mapInPandas(run, METRICS)
    df = df.withColumn("color_balance", F.when(F.col("decoded"), S.color_balance("r", "g", "b", "grayscale")).otherwise(0.0))
    scored = {"exposure_score": S.exposure_score(), "overall": S.quality_overall(), "passed": S.quality_passed()}
    none = {"exposure_score": F.lit(0.0), "overall": F.lit(0.0), "passed": F.lit(False)}
    return df.withColumns({k: F.when(F.col("decoded"), v).otherwise(none[k]) for k, v in scored.items()})


#: What stands in for an analysis that failed on a readable item.
NEUTRAL = {
    "quality": {"sharpness": 0.5, "noise": 0.5, "exposure": 0.5, "overall": 0.5, "passed": True}, "defects": {"anomaly": 0.0, "count": 0, "passed": True},
    "similarity": {"group": 0}, "compliance": {"relevance": 0.5, "compliant": True},
}


def degraded(df: DataFrame, part: str) -> DataFrame:
    """The struct column ``part`` with neutral values where it is null, and the flag ``degraded``."""
    neutral = F.struct(*(F.lit(v).cast(df.schema[part].dataType[k].dataType).alias(k) for k, v in NEUTRAL[part].items()))
    return df.withColumn("degraded", F.col(part).isNull()).withColumn(part, F.coalesce(F.col(part), neutral))


def pixel_table(images: DataFrame) -> DataFrame:
    """(item_id, y, x, b, g, r), a row per pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                px = np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.channels)
                px = np.repeat(px, 3, axis=2) if x.channels == 1 else px
                y, at = np.divmod(np.arange(x.height * x.width), x.width)
                flat = px.reshape(-1, px.shape[2])
                yield pd.DataFrame({"item_id": x.item_id, "y": y, "x": at, "b": flat[:, 0].astype(int), "g": flat[:, 1].astype(int), "r": flat[:, 2].astype(int)})

    return images.where("height > 0").select("item_id", "height", "width", "channels", "data").mapInPandas(run, "item_id string, y int, x int, b int, g int, r int")


def pixel_metrics(pixels: DataFrame) -> DataFrame:
    """Brightness, contrast, exposure shares and channel means from a gray pixel table (item_id, y, x, gray), by SQL alone."""
    g = F.col("gray")
    return pixels.groupBy("item_id").agg((F.avg(g) / 255).alias("brightness"), (F.stddev_pop(g) / 255).alias("contrast"), F.avg((g > 240).cast("double")).alias("over_pct"), F.avg((g < 15).cast("double")).alias("under_pct"))


def pixel_sharpness(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Variance of the four-neighbour Laplacian from a gray pixel table, by a shift of each pixel to its neighbours."""
    mirror = lambda c, n: F.when(c < 0, -c).when(c >= n, 2 * (n - 1) - c).otherwise(c)
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in ((0, 0, -4), (-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1)))))
    need = pixels.select("item_id", F.col("y").alias("y0"), F.col("x").alias("x0"), steps.alias("s"))
    need = need.select("item_id", "y0", "x0", mirror(F.col("y0") + F.col("s.a"), height).alias("y"), mirror(F.col("x0") + F.col("s.b"), width).alias("x"), "s.w")
    value = need.join(pixels, ["item_id", "y", "x"]).groupBy("item_id", "y0", "x0").agg(F.sum(F.col("gray") * F.col("w")).alias("v"))
    return value.groupBy("item_id").agg(F.var_pop("v").alias("sharpness"))


def average_hash(pixels: DataFrame) -> DataFrame:
    """aHash of 8 by 8 gray pixel tables: 16 hex digits, a bit per pixel above the mean."""
    mean = pixels.groupBy("item_id").agg(F.avg("gray").alias("mean"))
    bits = pixels.join(mean, "item_id").groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", F.when(F.col("gray") > F.col("mean"), "1").otherwise("0").alias("bit")))), lambda s: s["bit"]), "").alias("bits"))
    nibble = lambda i: F.lower(F.conv(F.substr(F.col("bits"), i * 4 + 1, F.lit(4)), 2, 16))
    return bits.select("item_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), nibble), "").alias("ahash"))
