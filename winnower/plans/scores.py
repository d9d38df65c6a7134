"""Queries of the score functions (F-01 to F-18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnower.functions import scores as S
from winnower.plans.registry import query

OVERALL = "0.3 * least(1.0e0, sharpness / 200) + 0.2 * greatest(0.0e0, 1 - 10 * noise) + 0.25 * brightness + 0.15 * color_balance + 0.1 * least(1.0e0, width::DOUBLE * height / 2073600)"
EXPOSURE = "greatest(0.0e0, 1 - 2 * abs(brightness - 0.5e0) - 5 * greatest(0.0e0, 0.2e0 - contrast) - 10 * greatest(0.0e0, over_pct - 0.02e0) - 10 * greatest(0.0e0, under_pct - 0.02e0))"
EXPOSED = f"({EXPOSURE}) > 0.6 AND over_pct < 0.05e0 AND under_pct < 0.05e0 AND contrast > 0.1e0"
TECH = "greatest(0.0e0, 1 - CASE WHEN file_size = 0 THEN 0.0e0 WHEN file_size / 1048576.0e0 < 0.5 THEN 0.3e0 WHEN file_size / 1048576.0e0 < 1 THEN 0.1e0 ELSE 0.0e0 END - CASE WHEN width * height < 2073600 THEN 0.4e0 WHEN width * height < 3686400 THEN 0.2e0 ELSE 0.0e0 END)"
PARTS = f"""SELECT item_id, session_id, image_path, filename, overall AS quality_score, greatest(0.0e0, 1 - anomaly) AS defect_score, CASE WHEN similarity_group > 0 THEN 0.5e0 ELSE 1.0e0 END AS similarity_score,
  compliance AS compliance_score, {TECH} AS technical_score FROM scored"""
SCORES = f"""SELECT *, (quality_score + defect_score + similarity_score + compliance_score + technical_score) / 5 AS overall_score,
  0.35 * quality_score + 0.25 * defect_score + 0.2 * similarity_score + 0.15 * compliance_score + 0.05 * technical_score AS weighted_score FROM ({PARTS})"""
NAMES = "quality_score defect_score similarity_score compliance_score technical_score overall_score weighted_score"
CRITICAL = "concat_ws(',', CASE WHEN quality_score < 0.3 THEN 'critical_quality' END, CASE WHEN 1 - defect_score > 0.7 THEN 'critical_defects' END, CASE WHEN compliance_score < 0.5 THEN 'critical_compliance' END)"
REASONS = """concat_ws(',', CASE WHEN quality_score < 0.6 THEN CASE WHEN quality_score > 0.4 THEN 'low_quality_score:medium' ELSE 'low_quality_score:high' END END,
  CASE WHEN 1 - defect_score > 0.3 THEN CASE WHEN 1 - defect_score < 0.5 THEN 'defects_detected:medium' ELSE 'defects_detected:high' END END,
  CASE WHEN similarity_score < 0.15 THEN 'similar_images:medium' END, CASE WHEN compliance_score < 0.8 THEN 'compliance_issues:high' END)"""


@query("f01_quality_overall", f"SELECT item_id, {OVERALL} AS overall FROM quality", "overall")
def _(r):
    return r.quality.select("item_id", S.quality_overall().alias("overall"))


@query("f02_quality_passed", f"SELECT item_id, sharpness >= 100 AND noise <= 0.1e0 AND {EXPOSED} AND color_balance >= 0.5 AND width >= 1920 AND height >= 1080 AS passed FROM quality")
def _(r):
    return r.quality.select("item_id", S.quality_passed().alias("passed"))


@query("f03_exposure", f"SELECT item_id, {EXPOSURE} AS exposure_score, {EXPOSED} AS exposure_passed FROM quality", "exposure_score")
def _(r):
    return r.quality.select("item_id", S.exposure_score().alias("exposure_score"), S.exposure_passed().alias("exposure_passed"))


MEANS = "SELECT item_id, (item_id * 7 % 256)::DOUBLE AS r, (item_id * 11 % 256)::DOUBLE AS g, (item_id * 13 % 256)::DOUBLE AS b, item_id % 10 = 0 AS gray FROM items"


@query(
    "f04_color_balance",
    f"""SELECT item_id, CASE WHEN gray THEN 0.8e0 WHEN r + g + b = 0 THEN 0.0e0 ELSE greatest(0.0e0, greatest(0.0e0, 1 - 2 * greatest(abs(r - m), abs(g - m), abs(b - m)) / m)
      - CASE WHEN m > 10 THEN 0.5e0 * (abs(CASE WHEN g = 0 THEN 1.0e0 ELSE r / g END - 1) + abs(CASE WHEN g = 0 THEN 1.0e0 ELSE b / g END - 1)) ELSE 0.0e0 END) END AS balance FROM (SELECT *, (r + g + b) / 3 AS m FROM ({MEANS}))""",
    "balance",
)
def _(r):
    i = F.col("item_id")
    means = r.items.select("item_id", *((i * k % 256).cast("double").alias(c) for c, k in (("r", 7), ("g", 11), ("b", 13))), (i % 10 == 0).alias("gray"))
    return means.select("item_id", S.color_balance("r", "g", "b", "gray").alias("balance"))


@query(
    "f05_compliance_score",
    """SELECT item_id, CASE WHEN privacy_count = 0 AND issue_count = 0 THEN 1.0e0 ELSE greatest(0.0e0, 1 - 0.3e0 * (item_id % 2) - 0.4e0 * privacy_count - 0.1e0 * issue_count - 0.5e0 * greatest(0.0e0, 0.5e0 - (item_id % 10) / 10.0e0)) END AS score FROM scored""",
    "score",
)
def _(r):
    clean = (F.col("privacy_count") == 0) & (F.col("issue_count") == 0)
    return r.scored.select("item_id", S.compliance_score(clean, F.col("item_id") % 2, "privacy_count", "issue_count", F.col("item_id") % 10 / 10.0).alias("score"))


@query("f06_technical_score", f"SELECT item_id, {TECH} AS score FROM items", "score")
def _(r):
    return r.items.select("item_id", S.technical_score().alias("score"))


def scored(r):
    """Items with component scores, critical and threshold reasons and the decision."""
    df = r.scored.withColumns(S.component_scores())
    return df.withColumns({"critical_reasons": S.critical_reasons(), "reasons": S.threshold_reasons()})


@query("f07_component_scores", f"SELECT item_id, {NAMES.replace(' ', ', ')} FROM ({SCORES})", NAMES)
def _(r):
    return r.scored.withColumns(S.component_scores()).select("item_id", *NAMES.split())


@query("f08_critical_reasons", f"SELECT item_id, {CRITICAL} AS reasons FROM ({SCORES})")
def _(r):
    return scored(r).select("item_id", F.array_join("critical_reasons.reason", ",").alias("reasons"))


@query(
    "f09_threshold_reasons",
    f"""SELECT item_id, {REASONS} AS reasons, concat_ws(',', CASE WHEN quality_score >= 0.6 THEN 'good_quality' END, CASE WHEN 1 - defect_score <= 0.3 THEN 'few_defects' END,
      CASE WHEN similarity_score >= 0.15 THEN 'unique_content' END, CASE WHEN compliance_score >= 0.8 THEN 'compliant' END) AS factors FROM ({SCORES})""",
)
def _(r):
    named = F.transform("reasons", lambda x: F.concat(x["reason"], F.lit(":"), x["severity"]))
    return scored(r).select("item_id", F.array_join(named, ",").alias("reasons"), F.array_join(S.approval_factors(), ",").alias("factors"))


DECIDED = f"""SELECT *, CASE WHEN item_id % 97 = 0 THEN 'rejected' WHEN critical <> '' THEN 'rejected' WHEN weighted_score >= 0.75 AND reasons = '' THEN 'approved' WHEN weighted_score <= 0.4 OR n >= 3 THEN 'rejected' ELSE 'review_required' END AS decision,
  CASE WHEN item_id % 97 = 0 THEN 1.0e0 WHEN critical <> '' THEN 0.95e0 WHEN weighted_score >= 0.75 AND reasons = '' THEN least(0.95e0, weighted_score) WHEN weighted_score <= 0.4 OR n >= 3 THEN least(0.95e0, 1 - weighted_score) ELSE 0.6e0 END AS confidence,
  CASE WHEN item_id % 97 = 0 THEN 'processing_error' WHEN critical <> '' THEN 'reject_critical' WHEN weighted_score >= 0.75 AND reasons = '' THEN 'approve' WHEN weighted_score <= 0.4 OR n >= 3 THEN 'reject_low_score' ELSE 'manual_review' END AS recommendation
  FROM (SELECT *, {CRITICAL} AS critical, {REASONS} AS reasons, CASE WHEN {REASONS} = '' THEN 0 ELSE len(string_split({REASONS}, ',')) END AS n FROM ({SCORES}))"""


def decided(r):
    return scored(r).withColumns(S.decide(failed=F.col("item_id") % 97 == 0))


@query("f10_decide", f"SELECT item_id, decision, confidence, recommendation FROM ({DECIDED})", "confidence")
def _(r):
    return decided(r).select("item_id", "decision", "confidence", "recommendation")


@query(
    "f11_decide_simple",
    """SELECT item_id, concat_ws(',', CASE WHEN overall < 0.6e0 THEN 'low_quality' END, CASE WHEN anomaly > 0.3e0 THEN 'defects_detected' END, CASE WHEN compliance < 1 THEN 'compliance_issues' END) AS reasons,
      CASE WHEN overall < 0.6e0 OR anomaly > 0.3e0 OR compliance < 1 THEN 'rejected' ELSE 'approved' END AS decision FROM scored""",
)
def _(r):
    out = S.decide_simple(F.col("overall") >= 0.6, F.col("anomaly") <= 0.3, F.col("compliance") >= 1)
    return r.scored.select("item_id", F.array_join(out["reasons"], ",").alias("reasons"), out["decision"].alias("decision"))


@query(
    "f12_unified_decide",
    """SELECT item_id, score, CASE WHEN compliance < 0.5 THEN 'rejected' WHEN score >= 0.75 THEN CASE WHEN anomaly > 0.9 THEN 'rejected' ELSE 'approved' END WHEN score <= 0.4 THEN 'rejected'
      WHEN overall < 0.5e0 OR confidence < 0.6 THEN 'rejected' ELSE 'approved' END AS decision,
      concat_ws(',', CASE WHEN overall < 0.5e0 THEN 'low_quality' END, CASE WHEN confidence < 0.6 THEN 'low_confidence' END) AS reasons
    FROM (SELECT *, 0.25 * overall + 0.25 * (1 - anomaly) + 0.3 * compliance + 0.2 * confidence AS score FROM (SELECT *, (item_id % 21) / 20.0e0 AS confidence FROM scored))""",
    "score",
)
def _(r):
    df = r.scored.withColumn("confidence", F.col("item_id") % 21 / 20.0)
    df = df.withColumns({"score": S.unified_score("overall", "anomaly", "compliance", "confidence"), "own": F.array_compact(F.array(F.when(F.col("overall") < 0.5, "low_quality")))})
    out = S.unified_decide("score", "confidence", "own", F.col("compliance") < 0.5, F.col("anomaly") > 0.9)
    return df.select("item_id", "score", out["decision"].alias("decision"), F.array_join(out["reasons"], ",").alias("reasons"))


FALLBACK = """SELECT item_id, least(1.0e0, sharpness / 200) AS sharp, greatest(0.0e0, least(1.0e0, 10 * noise)) AS noisy, (brightness + color_balance) / 2 AS aesthetic, CASE WHEN sharpness >= 100 THEN 0.8e0 ELSE 0.6e0 END AS confidence FROM quality"""


@query(
    "f13_ai_quality",
    f"""SELECT item_id, overall, reasons, CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS decision FROM (SELECT item_id, greatest(0.0e0, least(1.0e0, 0.25 * sharp + 0.2 * (1 - noisy) + 0.25 * aesthetic + 0.2 * technical + 0.1 * confidence)) AS overall,
      concat_ws(',', CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN sharp < 0.8 THEN 'low_sharpness' END, CASE WHEN noisy > 0.3 THEN 'high_noise' END, CASE WHEN aesthetic < 0.6 THEN 'low_aesthetic' END, CASE WHEN technical < 0.7 THEN 'low_technical' END, CASE WHEN NOT sharpness >= 100 THEN 'sharpness' END, CASE WHEN NOT noise <= 0.1e0 THEN 'noise' END, CASE WHEN NOT ({EXPOSED}) THEN 'exposure' END, CASE WHEN NOT color_balance >= 0.5 THEN 'color_balance' END, CASE WHEN NOT (width >= 1920 AND height >= 1080) THEN 'resolution' END) AS reasons
    FROM (SELECT q.*, sharp, noisy, aesthetic, confidence, (sharp + 1 - noisy) / 2 AS technical FROM ({FALLBACK}) f JOIN quality q ON q.item_id = f.item_id))""",
    "overall",
)
def _(r):
    parts = S.quality_parts()
    f = r.quality.select("item_id", *(v.alias(k) for k, v in S.quality_fallback(F.col("sharpness") >= 100).items()), *(c.alias(f"p_{k}") for k, c in parts.items()))
    five = ("sharpness", "noise", "aesthetic", "technical", "confidence")
    reasons = S.ai_quality_reasons(*five, parts={k: F.col(f"p_{k}") for k in parts})
    f = f.select("item_id", S.ai_quality_overall(*five).alias("overall"), reasons.alias("reasons"))
    return f.select("item_id", "overall", F.array_join("reasons", ",").alias("reasons"), S.ai_quality_decide("reasons").alias("decision"))


@query(
    "f14_feature_scores",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
      s AS (SELECT vec_id, var_pop(x) AS v, avg(abs(x)) AS a, min(x) AS lo, max(x) AS hi, count(*) AS n FROM x GROUP BY vec_id),
      b AS (SELECT vec_id, count(*) AS c FROM (SELECT x.vec_id, least(49, floor(50 * (x - lo) / (hi - lo))) AS k FROM x JOIN s USING (vec_id)) GROUP BY vec_id, k),
      e AS (SELECT vec_id, sum(-(c / n::DOUBLE) * log2(c / n::DOUBLE)) AS h FROM b JOIN s USING (vec_id) GROUP BY vec_id)
    SELECT vec_id, least(1.0e0, 1000 * v) AS sharpness, 1 - greatest(0.0e0, least(1.0e0, 1 - 10 * sqrt(v) / a)) AS noise, least(1.0e0, h / 10) AS aesthetic FROM s JOIN e USING (vec_id)""",
    "sharpness noise aesthetic",
)
def _(r):
    f = S.feature_scores("embedding")
    return r.embeddings.select("vec_id", *(f[k].alias(k) for k in ("sharpness", "noise", "aesthetic")))


@query("f15_quality_fallback", f"SELECT item_id, sharp AS sharpness, noisy AS noise, aesthetic, (sharp + 1 - noisy) / 2 AS technical, confidence FROM ({FALLBACK})", "sharpness noise aesthetic technical confidence")
def _(r):
    return r.quality.select("item_id", *(v.alias(k) for k, v in S.quality_fallback(F.col("sharpness") >= 100).items()))


DETECTOR = """SELECT item_id, count(*) AS n, avg(confidence) AS mean_confidence, count(*) FILTER (WHERE confidence > 0.8e0) AS confident, count(DISTINCT defect_type) AS kinds,
  string_agg(DISTINCT 'defect_' || defect_type, ',' ORDER BY 'defect_' || defect_type) AS names, bool_or(defect_type IN ('crack', 'damage')) AS grave,
  0.4e0 * least(1.0e0, count(*) * avg(confidence) / 10) + 0.6e0 * least(1.0e0, count(*) * avg(confidence) * count(DISTINCT defect_type) / 10) AS score FROM detections GROUP BY item_id"""
SEVERITY = "CASE WHEN grave OR score > 0.9 THEN 'critical' WHEN score > 0.7 OR confident > 2 OR n > 5 THEN 'high' WHEN score > 0.4 OR confident >= 1 OR n > 2 THEN 'medium' ELSE 'low' END"
CONFIDENCE = "greatest(0.3e0, least(1.0e0, (mean_confidence + least(1.0e0, n / 5.0e0) + 1 - 0.3 * score) / 3))"


def detector(r):
    from winnower.operators import aggregates as A

    roll = A.detector_rollup(r.detections.select("item_id", "defect_type", "confidence"))
    return roll.withColumn("severity", S.detector_severity()).withColumn("confidence", S.detector_confidence())


@query("f16_detector_severity", f"SELECT item_id, {SEVERITY} AS severity FROM ({DETECTOR})")
def _(r):
    return detector(r).select("item_id", "severity")


@query("f17_detector_confidence", f"SELECT item_id, {CONFIDENCE} AS confidence FROM ({DETECTOR})", "confidence")
def _(r):
    return detector(r).select("item_id", "confidence")


@query(
    "f18_detector_decide",
    f"""SELECT item_id, CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS decision, reasons FROM (
      SELECT item_id, concat_ws(',', CASE WHEN severity IN ('high', 'critical') THEN names END, CASE WHEN confidence < 0.6 THEN 'low_confidence' END, CASE WHEN kinds > 2 THEN 'multiple_types' END,
        CASE WHEN severity = 'medium' AND n > 3 THEN 'many_objects' END, CASE WHEN n > 3 THEN 'classic_check_failed' END) AS reasons FROM (SELECT *, {SEVERITY} AS severity, {CONFIDENCE} AS confidence FROM ({DETECTOR})))""",
)
def _(r):
    out = S.detector_decide(passed=F.col("n") <= 3)
    return detector(r).select("item_id", out["decision"].alias("decision"), F.array_join(out["reasons"], ",").alias("reasons"))


@query("f19_map_class", "SELECT item_id, n, CASE WHEN contains(lower(object_type), 'person') THEN 'privacy_concern' WHEN contains(lower(object_type), 'text') THEN 'copyright_concern' ELSE 'unknown_object' END AS kind FROM detections")
def _(r):
    return r.detections.select("item_id", "n", S.map_class("object_type").alias("kind"))
