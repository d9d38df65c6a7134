"""Scores and decisions of an item (F-01 to F-18): arithmetic on metric columns, thresholds as parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnower.functions.exprs import clamp, col, contains_any, present


@dataclass(frozen=True)
class QualityLimits:
    """Fixed values of the quality rules."""

    sharpness: float = 100.0
    noise: float = 0.1
    color: float = 0.5
    width: int = 1920
    height: int = 1080
    exposure: float = 0.6


@dataclass(frozen=True)
class DecisionLimits:
    """Fixed values of the decision rules."""

    quality_critical: float = 0.30
    anomaly_critical: float = 0.70
    compliance_critical: float = 0.50
    quality: float = 0.60
    defect: float = 0.30
    similarity: float = 0.85
    compliance: float = 0.80
    approve: float = 0.75
    reject: float = 0.40
    weights: tuple[float, ...] = (0.35, 0.25, 0.20, 0.15, 0.05)


def quality_overall(sharpness="sharpness", noise="noise", brightness="brightness", color="color_balance", width="width", height="height", q: QualityLimits = QualityLimits()) -> Column:
    pixels = col(width).cast("double") * col(height) / float(q.width * q.height)
    return 0.3 * F.least(F.lit(1.0), col(sharpness) / 200) + 0.2 * F.greatest(F.lit(0.0), 1 - 10 * col(noise)) + 0.25 * col(brightness) + 0.15 * col(color) + 0.1 * F.least(F.lit(1.0), pixels)


def exposure_score(brightness="brightness", contrast="contrast", over="over_pct", under="under_pct") -> Column:
    low, zero = F.greatest(F.lit(0.0), 0.2 - col(contrast)), F.lit(0.0)
    return F.greatest(zero, 1 - 2 * F.abs(col(brightness) - 0.5) - 5 * low - 10 * F.greatest(zero, col(over) - 0.02) - 10 * F.greatest(zero, col(under) - 0.02))


def exposure_passed(brightness="brightness", contrast="contrast", over="over_pct", under="under_pct", q: QualityLimits = QualityLimits()) -> Column:
    return (exposure_score(brightness, contrast, over, under) > q.exposure) & (col(over) < 0.05) & (col(under) < 0.05) & (col(contrast) > 0.1)


def quality_parts(q: QualityLimits = QualityLimits()) -> dict[str, Column]:
    """The conditions of the quality test by name."""
    size = (F.col("width") >= q.width) & (F.col("height") >= q.height)
    return {"sharpness": F.col("sharpness") >= q.sharpness, "noise": F.col("noise") <= q.noise, "exposure": exposure_passed(q=q), "color_balance": F.col("color_balance") >= q.color, "resolution": size}


def quality_passed(q: QualityLimits = QualityLimits()) -> Column:
    parts = quality_parts(q)
    return parts["sharpness"] & parts["noise"] & parts["exposure"] & parts["color_balance"] & parts["resolution"]


def color_balance(r, g, b, grayscale=None) -> Column:
    """From channel means; a grayscale image has 0.8, a black one 0."""
    r, g, b = col(r).cast("double"), col(g).cast("double"), col(b).cast("double")
    mean = (r + g + b) / 3
    base = F.greatest(F.lit(0.0), 1 - 2 * F.greatest(F.abs(r - mean), F.abs(g - mean), F.abs(b - mean)) / F.nullif(mean, F.lit(0.0)))
    over = lambda x: F.coalesce(x / F.nullif(g, F.lit(0.0)), F.lit(1.0))
    cast = F.when(mean > 10, 0.5 * (F.abs(over(r) - 1) + F.abs(over(b) - 1))).otherwise(0.0)
    out = F.when(mean == 0, 0.0).otherwise(F.greatest(F.lit(0.0), base - cast))
    return out if grayscale is None else F.when(col(grayscale), 0.8).otherwise(out)


def compliance_score(compliant, logos, privacy, issues, relevance) -> Column:
    rest = 1 - 0.3 * col(logos) - 0.4 * col(privacy) - 0.1 * col(issues) - 0.5 * F.greatest(F.lit(0.0), 0.5 - col(relevance))
    return F.when(col(compliant), 1.0).otherwise(F.greatest(F.lit(0.0), rest))


def technical_score(file_size="file_size", width="width", height="height") -> Column:
    mb, pixels = F.coalesce(col(file_size), F.lit(0)) / 1048576.0, col(width).cast("long") * col(height)
    size = F.when(mb == 0, 0.0).when(mb < 0.5, 0.3).when(mb < 1, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1 - size - F.when(pixels < 1920 * 1080, 0.4).when(pixels < 2560 * 1440, 0.2).otherwise(0.0))


def component_scores(overall="overall", anomaly="anomaly", group="similarity_group", compliance="compliance", technical: Column | None = None, d: DecisionLimits = DecisionLimits()) -> dict[str, Column]:
    """quality, defect, similarity, compliance and technical score, their mean and their weighted sum."""
    parts = {
        "quality_score": F.coalesce(col(overall), F.lit(0.0)),
        "defect_score": F.coalesce(F.greatest(F.lit(0.0), 1 - col(anomaly)), F.lit(0.0)),
        "similarity_score": F.when(col(group) > 0, 0.5).otherwise(1.0),
        "compliance_score": F.coalesce(col(compliance), F.lit(0.0)),
        "technical_score": technical_score() if technical is None else technical,
    }
    values = list(parts.values())
    total = lambda xs: sum(xs[1:], xs[0])
    return parts | {"overall_score": total(values) / 5, "weighted_score": total([w * v for w, v in zip(d.weights, values, strict=True)])}


def _reason(category: str, reason: str, severity, score: Column, limit: float) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"), severity.alias("severity"), score.cast("double").alias("score"), F.lit(limit).alias("threshold"))


def critical_reasons(d: DecisionLimits = DecisionLimits()) -> Column:
    q, a, c = F.col("quality_score"), 1 - F.col("defect_score"), F.col("compliance_score")
    return present(
        (q < d.quality_critical, _reason("quality", "critical_quality", "critical", q, d.quality_critical)),
        (a > d.anomaly_critical, _reason("defect", "critical_defects", "critical", a, d.anomaly_critical)),
        (c < d.compliance_critical, _reason("compliance", "critical_compliance", "critical", c, d.compliance_critical)),
    )


def threshold_reasons(d: DecisionLimits = DecisionLimits()) -> Column:
    q, a, s, c = F.col("quality_score"), 1 - F.col("defect_score"), F.col("similarity_score"), F.col("compliance_score")
    return present(
        (q < d.quality, _reason("quality", "low_quality_score", F.when(q > 0.4, "medium").otherwise("high"), q, d.quality)),
        (a > d.defect, _reason("defect", "defects_detected", F.when(a < 0.5, "medium").otherwise("high"), a, d.defect)),
        (s < 1 - d.similarity, _reason("similarity", "similar_images", "medium", s, 1 - d.similarity)),
        (c < d.compliance, _reason("compliance", "compliance_issues", "high", c, d.compliance)),
    )


def approval_factors(d: DecisionLimits = DecisionLimits()) -> Column:
    q, a, s, c = F.col("quality_score"), 1 - F.col("defect_score"), F.col("similarity_score"), F.col("compliance_score")
    return present((q >= d.quality, "good_quality"), (a <= d.defect, "few_defects"), (s >= 1 - d.similarity, "unique_content"), (c >= d.compliance, "compliant"))


def decide(d: DecisionLimits = DecisionLimits(), failed: Column | None = None) -> dict[str, Column]:
    """decision, confidence and recommendation from weighted_score, critical_reasons and reasons."""
    w, many, critical = F.col("weighted_score"), F.size("reasons"), F.size("critical_reasons") > 0
    bad = F.lit(False) if failed is None else failed
    approve, reject = (w >= d.approve) & (many == 0), (w <= d.reject) | (many >= 3)
    choose = lambda e, c, a, r, o: F.when(bad, e).when(critical, c).when(approve, a).when(reject, r).otherwise(o)
    return {
        "decision": choose("rejected", "rejected", "approved", "rejected", "review_required"),
        "confidence": choose(F.lit(1.0), F.lit(0.95), F.least(F.lit(0.95), w), F.least(F.lit(0.95), 1 - w), F.lit(0.6)),
        "recommendation": choose("processing_error", "reject_critical", "approve", "reject_low_score", "manual_review"),
    }


def decide_simple(quality="quality_passed", defect="defect_passed", compliant="is_compliant") -> dict[str, Column]:
    reasons = present((~col(quality), "low_quality"), (~col(defect), "defects_detected"), (~col(compliant), "compliance_issues"))
    return {"reasons": reasons, "decision": F.when(F.size(reasons) > 0, "rejected").otherwise("approved")}


def unified_score(quality, anomaly, compliance, confidence) -> Column:
    return 0.25 * col(quality) + 0.25 * (1 - col(anomaly)) + 0.30 * col(compliance) + 0.20 * col(confidence)


def unified_decide(score, confidence, reasons, critical_compliance, critical_defect, approve=0.75, reject=0.40, least=0.60) -> dict[str, Column]:
    """A critical compliance reason wins; a high score approves unless a critical defect reason stands; the middle goes by reasons."""
    score, reasons = col(score), F.when(col(confidence) < least, F.array_append(col(reasons), F.lit("low_confidence"))).otherwise(col(reasons))
    ok = F.when(col(critical_compliance), False).when(score >= approve, ~col(critical_defect)).when(score <= reject, False).otherwise(F.size(reasons) == 0)
    return {"reasons": reasons, "decision": F.when(ok, "approved").otherwise("rejected")}


def ai_quality_overall(sharpness, noise, aesthetic, technical, confidence) -> Column:
    return clamp(0.25 * col(sharpness) + 0.20 * (1 - col(noise)) + 0.25 * col(aesthetic) + 0.20 * col(technical) + 0.10 * col(confidence))


def ai_quality_reasons(sharpness, noise, aesthetic, technical, confidence, parts: Mapping[str, Column] | None = None) -> Column:
    """Reasons against an item; ``parts`` are the conditions of the plain quality test by name, of which the failed ones are reasons too."""
    failed = [(~F.coalesce(c, F.lit(False)), name) for name, c in (parts or {}).items()]
    return present(*_ai_reasons(sharpness, noise, aesthetic, technical, confidence), *failed)


def ai_quality_decide(reasons: Column | str) -> Column:
    """approved if there is no reason against it."""
    return F.when(F.size(col(reasons)) == 0, "approved").otherwise("rejected")


def _ai_reasons(sharpness, noise, aesthetic, technical, confidence) -> tuple:
    return ((col(confidence) < 0.7, "low_confidence"), (col(sharpness) < 0.8, "low_sharpness"), (col(noise) > 0.3, "high_noise"), (col(aesthetic) < 0.6, "low_aesthetic"), (col(technical) < 0.7, "low_technical"))


def feature_scores(vector) -> dict[str, Column]:
    """Scores of a feature vector: scaled variance, 1 - 10 std / mean size, entropy of a 50-bin histogram over 10, and their means."""
    v = col(vector)
    n = F.size(v).cast("double")
    sums = F.aggregate(v, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("a")), lambda s, x: F.struct((s["s"] + x).alias("s"), (s["q"] + x.cast("double") * x).alias("q"), (s["a"] + F.abs(x)).alias("a")))
    mean, size = sums["s"] / n, sums["a"] / n
    variance = F.greatest(F.lit(0.0), sums["q"] / n - mean * mean)
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    bins = F.transform(v, lambda x: F.least(F.lit(49.0), F.floor(50 * (x - low) / F.nullif(high - low, F.lit(0.0)))))
    shares = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.size(F.filter(bins, lambda b: b == k)) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    sharp, calm, rich = clamp(1000 * variance), clamp(1 - 10 * F.sqrt(variance) / F.nullif(size, F.lit(0.0))), clamp(entropy / 10)
    return {"sharpness": sharp, "noise": 1 - calm, "aesthetic": rich, "technical": (sharp + calm) / 2, "confidence": (sharp + calm + rich) / 3}


def quality_fallback(passed="passed") -> dict[str, Column]:
    """Inputs of the model rules from plain metrics where there is no vector."""
    sharp, noise = F.least(F.lit(1.0), F.col("sharpness") / 200), clamp(10 * F.col("noise"))
    return {"sharpness": sharp, "noise": noise, "aesthetic": (F.col("brightness") + F.col("color_balance")) / 2, "technical": (sharp + 1 - noise) / 2, "confidence": F.when(col(passed), 0.8).otherwise(0.6)}


#: Types that are critical by themselves.
CRITICAL_TYPES = ["crack", "damage", "privacy_concern", "copyright_concern"]


def detector_severity(score="score", n="n", confident="confident", types="types") -> Column:
    """From the roll-up of a detector: score, count, count above 0.8 confidence, array of types."""
    critical = F.arrays_overlap(col(types), F.array(*(F.lit(t) for t in CRITICAL_TYPES)))
    return F.when(critical | (col(score) > 0.9), "critical").when((col(score) > 0.7) | (col(confident) > 2) | (col(n) > 5), "high").when((col(score) > 0.4) | (col(confident) >= 1) | (col(n) > 2), "medium").otherwise("low")


def detector_confidence(n="n", mean="mean_confidence", score="score") -> Column:
    return F.when(col(n) == 0, 0.8).otherwise(clamp((col(mean) + F.least(F.lit(1.0), col(n) / 5) + 1 - 0.3 * col(score)) / 3, 0.3))


def detector_decide(severity="severity", confidence="confidence", types="types", n="n", passed="passed") -> dict[str, Column]:
    grave = col(severity).isin("high", "critical")
    each = F.when(grave, F.transform(F.array_sort(col(types)), lambda t: F.concat(F.lit("defect_"), t))).otherwise(F.array().cast("array<string>"))
    rest = present((col(confidence) < 0.6, "low_confidence"), (F.size(col(types)) > 2, "multiple_types"), ((col(severity) == "medium") & (col(n) > 3), "many_objects"), (~col(passed), "classic_check_failed"))
    reasons = F.concat(each, rest)
    return {"reasons": reasons, "decision": F.when(F.size(reasons) > 0, "rejected").otherwise("approved")}


#: Class names by the keyword they contain, in order.
CLASS_WORDS = {"crack": ["crack"], "scratch": ["scratch"], "stain": ["stain"], "damage": ["damage"], "artifact": ["artifact"], "blur": ["blur"], "privacy_concern": ["person", "face", "hand"], "copyright_concern": ["text", "sign", "logo"]}


def map_class(name) -> Column:
    out = F
    for kind, words in CLASS_WORDS.items():
        out = out.when(contains_any(F.lower(col(name)), words), kind)
    return out.otherwise("unknown_object")
