"""Queries of the rules on shapes, texts, metadata, errors and sessions (F-20 to F-49, V-01, V-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnower.functions import rules as R
from winnower.functions.exprs import tokens
from winnower.plans.registry import query
from winnower.plans.scores import DECIDED, decided


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\s+'), lambda t: t <> '')"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


@query(
    "f20_edge_defect_class",
    """SELECT item_id, n, CASE WHEN ok THEN kind END AS defect, CASE WHEN ok THEN conf END AS confidence FROM (SELECT *, area >= 100 AND conf > 0.3 AS ok FROM (
      SELECT *, CASE WHEN aspect > 3 AND solidity < 0.7 THEN 'crack' WHEN solidity < 0.8 AND aspect > 1.5 THEN 'break' WHEN aspect > 2 AND solidity > 0.7 THEN 'scratch' ELSE 'edge_anomaly' END AS kind,
        CASE WHEN aspect > 3 AND solidity < 0.7 THEN least(0.9e0, aspect / 10 + 1 - solidity) WHEN solidity < 0.8 AND aspect > 1.5 THEN least(0.8e0, 2 * (1 - solidity)) WHEN aspect > 2 AND solidity > 0.7 THEN least(0.7e0, aspect / 5) ELSE 0.4e0 END AS conf FROM contours))""",
    "confidence",
)
def _(r):
    return r.contours.select("item_id", "n", *(v.alias(k) for k, v in R.edge_defect_class().items()))


@query("f21_edge_severity", "SELECT item_id, n, CASE WHEN area > 5000 OR aspect > 10 THEN 'high' WHEN area > 1000 OR aspect > 5 OR solidity < 0.5 THEN 'medium' ELSE 'low' END AS severity FROM contours")
def _(r):
    return r.contours.select("item_id", "n", R.edge_severity().alias("severity"))


@query(
    "f22_object_shape",
    """SELECT item_id, n, CASE WHEN perimeter = 0 THEN 'unknown' WHEN 4 * pi() * area / (perimeter * perimeter) > 0.7 THEN 'circular' WHEN aspect > 2 THEN 'elongated' WHEN aspect < 0.5 THEN 'tall' ELSE 'rectangular' END AS shape
      FROM (SELECT item_id, n, area / 100 AS area, perimeter, aspect FROM contours)""",
)
def _(r):
    return r.contours.select("item_id", "n", R.object_shape(F.col("area") / 100, "perimeter", "aspect", F.lit(1.0)).alias("shape"))


@query(
    "f23_region_anomalies",
    """SELECT item_id, n, concat_ws(',', CASE WHEN a > 50 AND least(0.9e0, a / 100) >= 0.5 THEN 'texture' END, CASE WHEN b > 30 AND least(0.8e0, b / 50) >= 0.5 THEN 'color' END) AS kinds
      FROM (SELECT item_id, n, confidence * 100 AS a, quantity AS b FROM detections)""",
)
def _(r):
    found = R.region_anomalies(F.col("confidence") * 100, F.col("quantity"))
    return r.detections.select("item_id", "n", F.array_join(found["kind"], ",").alias("kinds"))


@query("f24_brand_match", f"SELECT doc_id, list_filter({listed(R.BRANDS)}, lambda b: contains(lower(trim(text)), b))[1] AS brand FROM documents")
def _(r):
    return r.documents.select("doc_id", R.brand_match("text").alias("brand"))


CLASSED = f"""SELECT doc_id, CASE WHEN within THEN 'brand' WHEN regexp_matches(text, '[®™©]') THEN 'trademark' ELSE 'not_brand' END AS brand_kind,
  CASE WHEN exact THEN 0.9e0 WHEN within THEN 0.7e0 WHEN regexp_matches(text, '[®™©]') THEN 0.8e0 ELSE 0.1e0 END AS brand_confidence FROM (
  SELECT *, list_contains({listed(R.GRADED_BRANDS)}, lower(trim(text))) AS exact, len(list_filter({listed(R.GRADED_BRANDS)}, lambda b: contains(lower(trim(text)), b))) > 0 AS within FROM documents)"""


@query("f25_brand_class", CLASSED, "brand_confidence")
def _(r):
    return r.documents.select("doc_id", *(v.alias(k) for k, v in R.brand_class("text").items()))


@query(
    "f26_logo_risk",
    f"""SELECT item_id, n, CASE WHEN list_contains({listed(R.HIGH_RISK_BRANDS)}, brand) AND confidence > 0.8e0 THEN 'critical' WHEN brand IS NOT NULL AND confidence > 0.7e0 THEN 'high' WHEN confidence > 0.5e0 THEN 'medium' ELSE 'low' END AS risk
      FROM (SELECT *, CASE WHEN n % 3 = 0 THEN 'nike' WHEN n % 3 = 1 THEN 'sony' END AS brand FROM detections)""",
)
def _(r):
    brand = F.when(F.col("n") % 3 == 0, "nike").when(F.col("n") % 3 == 1, "sony")
    return r.detections.withColumn("brand", brand).select("item_id", "n", R.logo_risk("brand", "confidence").alias("risk"))


@query("f27_plate_matches", "SELECT doc_id, array_to_string(list_concat(" + ", ".join(f"regexp_extract_all(text, '(?i){p}')" for p in R.PLATES) + "), '|') AS plates FROM documents")
def _(r):
    return r.documents.select("doc_id", F.array_join(R.plate_matches("text"), "|").alias("plates"))


@query(
    "f28_plate_strict",
    f"""SELECT doc_id, CASE WHEN length(b) >= 5 AND regexp_matches(b, '^({"|".join(R.STRICT_PLATES)})$') AND a BETWEEN 2 AND 6 THEN b END AS plate
      FROM (SELECT doc_id, upper(regexp_replace(substr(md5(text), 1, 6), '[\\s-]', '', 'g')) AS b, (doc_id % 8)::DOUBLE AS a FROM documents)""",
)
def _(r):
    return r.documents.select("doc_id", R.plate_strict(F.substring(F.md5("text"), 1, 6), F.col("doc_id") % 8, F.lit(1)).alias("plate"))


@query("f29_pii_matches", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in R.PII.items()) + ") AS kinds FROM documents")
def _(r):
    return r.documents.select("doc_id", F.array_join(R.pii_matches("text"), ",").alias("kinds"))


@query("f30_face_severity", "SELECT item_id, n, CASE WHEN s > 0.15e0 THEN 'critical' WHEN s > 0.05e0 THEN 'high' WHEN s > 0.01e0 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT item_id, n, quantity / 200.0e0 AS s FROM detections)")
def _(r):
    return r.detections.select("item_id", "n", R.face_severity("quantity", F.lit(200.0)).alias("severity"))


META = """SELECT d.doc_id, text AS description, CASE WHEN quality = 1 THEN 'T' || d.doc_id END AS title, CASE WHEN toxic = 1 THEN 'iPhone' END AS make, CASE WHEN d.doc_id % 7 = 0 THEN 'GPS' END AS gps,
  CASE WHEN d.doc_id % 11 = 0 THEN 'TrialSoft' END AS software FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id"""


def metadata(r):
    d = r.documents.select("doc_id", "text").join(r.marks, "doc_id", "left")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    i = F.col("doc_id")
    fields = F.array(
        entry("description", F.when(i % 5 != 0, F.col("text"))), entry("title", F.when(F.col("quality") == 1, F.concat(F.lit("T"), i))), entry("Make", F.when(F.col("toxic") == 1, "iPhone")),
        entry("GPSInfo", F.when(i % 7 == 0, "GPS")), entry("Software", F.when(i % 11 == 0, "TrialSoft")),
    )
    return d.select("doc_id", "text", F.map_from_entries(F.filter(fields, lambda e: e["v"].isNotNull())).alias("metadata"))


NO_DESC = "(doc_id % 5 = 0 OR coalesce(description, '') = '')"


@query(
    "f31_metadata_issues",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN {NO_DESC} AND title IS NULL THEN 'missing_description' END, CASE WHEN gps IS NOT NULL OR (contains(description, 'GPS') AND NOT {NO_DESC}) THEN 'gps_data' END,
      CASE WHEN make IS NOT NULL THEN 'device_info' END, CASE WHEN software IS NOT NULL THEN 'software_mark' END) AS issues FROM ({META})""",
)
def _(r):
    return metadata(r).select("doc_id", F.array_join(R.metadata_issues("metadata"), ",").alias("issues"))


@query(
    "f32_metadata_issues_strict",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN {NO_DESC} THEN 'missing_description' END, CASE WHEN title IS NULL THEN 'missing_title' END, CASE WHEN gps IS NOT NULL THEN 'gps_data' END, CASE WHEN make IS NOT NULL THEN 'device_in_make' END) AS issues FROM ({META})""",
)
def _(r):
    return metadata(r).select("doc_id", F.array_join(R.metadata_issues_strict("metadata"), ",").alias("issues"))


MARKED = "CASE WHEN doc_id % 3 = 0 THEN text || ' gun nike' ELSE text END"


def marked(r):
    return r.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" gun nike"))).otherwise(F.col("text")).alias("text"))


@query(
    "f33_keyword_relevance",
    f"""SELECT doc_id, CASE WHEN len(t) = 0 THEN 0.0e0 ELSE greatest(0.0e0, 1 - (len(list_filter(t, lambda x: list_contains({listed(R.INAPPROPRIATE)}, x))) + len(list_filter(t, lambda x: list_contains({listed(R.BRANDS)}, x)))) / len(t)::DOUBLE) END AS relevance
      FROM (SELECT doc_id, {TOKENS.format(MARKED)} AS t FROM documents)""",
    "relevance",
)
def _(r):
    return marked(r).select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", R.keyword_relevance(F.col("t")).alias("relevance"))


@query("f34_keyword_quality", f"SELECT doc_id, CASE WHEN len(t) = 0 THEN 0.0e0 ELSE 1 - len(list_intersect(t, {listed(R.INAPPROPRIATE[:11])})) / len(t)::DOUBLE END AS score FROM (SELECT doc_id, list_distinct({TOKENS.format(MARKED)}) AS t FROM documents)", "score")
def _(r):
    return marked(r).select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", R.keyword_quality(F.col("t")).alias("score"))


@query("f35_description_quality", f"SELECT doc_id, CASE WHEN n = 0 THEN 0.0e0 WHEN n < 3 THEN 0.3e0 WHEN n < 10 THEN 0.6e0 ELSE 0.9e0 END AS score FROM (SELECT doc_id, len({TOKENS.format('text')}) AS n FROM documents)", "score")
def _(r):
    return r.documents.select("doc_id", R.description_quality("text").alias("score"))


@query("f36_language_appropriateness", f"SELECT doc_id, greatest(0.0e0, 1 - 0.2e0 * len(list_filter({listed(R.HARSH)}, lambda w: contains(lower(text), w)))) AS score FROM documents", "score")
def _(r):
    return r.documents.select("doc_id", R.language_appropriateness("text").alias("score"))


@query(
    "f37_commercial_viability",
    f"""SELECT doc_id, least(1.0e0, 0.5e0 + CASE WHEN len(list_filter({listed(R.COMMERCIAL)}, lambda w: contains(lower(text), w))) > 0 THEN 0.2e0 ELSE 0.0e0 END + CASE WHEN doc_id % 2 = 0 THEN 0.1e0 ELSE 0.0e0 END + CASE WHEN text <> '' THEN 0.1e0 ELSE 0.0e0 END
      + CASE WHEN doc_id % 3 = 0 THEN 0.1e0 ELSE 0.0e0 END) AS score FROM documents""",
    "score",
)
def _(r):
    i = F.col("doc_id")
    return r.documents.select("doc_id", R.commercial_viability(F.when(i % 2 == 0, "t"), "text", F.when(i % 3 == 0, "k")).alias("score"))


@query("f38_age_rating", "SELECT item_id, CASE WHEN compliance >= 0.9 THEN 'all_ages' WHEN compliance >= 0.7 THEN 'teen' WHEN compliance >= 0.5 THEN 'adult' ELSE 'restricted' END AS rating FROM scored")
def _(r):
    return r.scored.select("item_id", R.age_rating("compliance").alias("rating"))


RISK = "CASE WHEN confidence > 0.8e0 THEN 'critical' WHEN confidence > 0.6e0 THEN 'high' WHEN confidence > 0.3e0 THEN 'medium' ELSE 'low' END"
GRADED = f"""SELECT item_id, greatest(0.0e0, least(1.0e0, greatest(0.0e0, 1 - lc - pc) * 0.9e0 * (0.7 + 0.3 * 0.5))) AS score, cs, n, lcrit, pcrit, pgrave FROM (
  SELECT item_id, sum(CASE WHEN n % 2 = 0 THEN CASE k WHEN 'critical' THEN 0.4e0 WHEN 'high' THEN 0.3e0 WHEN 'medium' THEN 0.2e0 ELSE 0.1e0 END ELSE 0.0e0 END) AS lc,
    sum(CASE WHEN n % 2 = 1 THEN CASE k WHEN 'critical' THEN 0.5e0 WHEN 'high' THEN 0.3e0 WHEN 'medium' THEN 0.2e0 ELSE 0.1e0 END ELSE 0.0e0 END) AS pc, sum(confidence) AS cs, count(*) AS n,
    bool_or(n % 2 = 0 AND k = 'critical') AS lcrit, bool_or(n % 2 = 1 AND k = 'critical') AS pcrit, count(*) FILTER (WHERE n % 2 = 1 AND k IN ('high', 'critical')) AS pgrave
  FROM (SELECT *, {RISK} AS k FROM detections) GROUP BY item_id)"""


def graded(r):
    c = F.col("confidence")
    risk = F.when(c > 0.8, "critical").when(c > 0.6, "high").when(c > 0.3, "medium").otherwise("low")
    d = r.detections.withColumn("risk", risk)
    lists = d.groupBy("item_id").agg(F.collect_list(F.when(F.col("n") % 2 == 0, F.col("risk"))).alias("logos"), F.collect_list(F.when(F.col("n") % 2 == 1, F.col("risk"))).alias("privacy"), F.collect_list("confidence").alias("confidences"))
    return lists.withColumn("score", R.graded_compliance_score("logos", "privacy", F.lit(0.9), F.lit(0.5)))


@query("f39_graded_compliance_score", f"SELECT item_id, score FROM ({GRADED})", "score")
def _(r):
    return graded(r).select("item_id", "score")


@query(
    "f40_graded_compliance_decide",
    f"""SELECT item_id, confidence, CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS decision, reasons FROM (SELECT item_id, (cs + 0.9e0) / (n + 1) AS confidence, concat_ws(',', CASE WHEN score < 0.6e0 THEN 'low_compliance_score' END,
      CASE WHEN lcrit THEN 'critical_logo' END, CASE WHEN pcrit THEN 'critical_privacy' END, CASE WHEN pgrave > 2 THEN 'multiple_privacy_violations' END) AS reasons FROM ({GRADED}))""",
    "confidence",
)
def _(r):
    df = graded(r).withColumn("reasons", R.graded_compliance_reasons("score", "logos", "privacy", F.lit(0.9)))
    return df.select("item_id", R.graded_compliance_confidence("confidences", F.lit(0.9)).alias("confidence"), F.when(F.size("reasons") == 0, "approved").otherwise("rejected").alias("decision"), F.array_join("reasons", ",").alias("reasons"))


CATEGORY = """CASE WHEN exception_type IN ('ConnectionError', 'TimeoutError') THEN 'network' WHEN exception_type = 'MemoryError' THEN 'memory' WHEN exception_type IN ('FileNotFoundError', 'PermissionError') THEN 'file_system'
  WHEN exception_type = 'ValueError' THEN CASE WHEN contains(coalesce(component, ''), 'config') THEN 'configuration' ELSE 'validation' END WHEN exception_type = 'SystemError' THEN 'critical' ELSE 'processing' END"""
GRADE = "CASE WHEN category = 'critical' THEN 'critical' WHEN category = 'memory' OR exception_type = 'PermissionError' THEN 'high' WHEN category IN ('configuration', 'network') THEN 'medium' WHEN category = 'validation' THEN 'low' ELSE 'medium' END"
ERRORS = f"SELECT *, {GRADE} AS severity FROM (SELECT *, {CATEGORY} AS category FROM errors)"


def classified(errors):
    return errors.withColumn("category", R.error_category()).withColumn("severity", R.error_severity())


@query("f41_error_category", f"SELECT event_id, {CATEGORY} AS category FROM errors")
def _(r):
    return r.errors.select("event_id", R.error_category().alias("category"))


@query("f42_error_severity", f"SELECT event_id, severity FROM ({ERRORS})")
def _(r):
    return classified(r.errors).select("event_id", "severity")


@query("f43_error_id", "SELECT event_id, substr(md5(exception_type || '_' || message || '_' || coalesce(component, 'unknown')), 1, 12) AS error_id FROM errors")
def _(r):
    return r.errors.select("event_id", R.error_id().alias("error_id"))


@query(
    "f44_retry_delay",
    f"SELECT event_id, least(1.0e0 * pow(2.0, event_id % 9), 60.0e0) AS delay, CASE category WHEN 'processing' THEN 2 WHEN 'file_system' THEN 3 WHEN 'memory' THEN 1 WHEN 'network' THEN 5 ELSE 0 END AS retries FROM ({ERRORS})",
    "delay",
)
def _(r):
    return classified(r.errors).select("event_id", R.retry_delay(F.col("event_id") % 9).alias("delay"), R.max_retries("category").alias("retries"))


IDLE = "epoch(" + NOW + " - {0})"


@query(
    "f45_crash_type",
    f"""SELECT id, CASE WHEN regexp_matches(lower(coalesce(error_message, '')), 'memory|oom') THEN 'out_of_memory' WHEN regexp_matches(lower(coalesce(error_message, '')), 'network|connection') THEN 'network_failure'
      WHEN regexp_matches(lower(coalesce(error_message, '')), 'crash|exception') THEN 'application_crash' WHEN {IDLE.format('updated_at')} > 3600 THEN 'power_failure' WHEN {IDLE.format('updated_at')} > 600 THEN 'system_crash' ELSE 'application_crash' END AS crash FROM sessions""",
)
def _(r):
    return r.sessions.select("id", R.crash_type("error_message", "updated_at", now()).alias("crash"))


CP_SECONDS = f"floor(epoch({NOW}) - floor(epoch(created_at)))"


@query("f46_data_loss_risk", f"SELECT id, CASE WHEN lost < 10 THEN 'low' WHEN lost < 50 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT id, floor({CP_SECONDS} * 0.00005e0) AS lost FROM checkpoints)")
def _(r):
    return r.checkpoints.select("id", R.data_loss_risk("created_at", F.lit(0.00005), now()).alias("risk"))


@query(
    "f47_recovery",
    f"""SELECT id, CASE WHEN processed_count < 20 THEN CASE WHEN processed_count < 10 THEN 'fresh_start' WHEN error_count > 0 AND s >= 120 THEN 'restart_batch' ELSE 'continue' END WHEN s < 120 THEN 'continue' WHEN error_count > 0 THEN 'restart_batch' ELSE 'continue' END AS action,
      greatest(0.0e0, least(1.0e0, 1 - CASE WHEN s > 300 THEN 0.2e0 ELSE 0.0e0 END - CASE WHEN s > 900 THEN 0.3e0 ELSE 0.0e0 END - 0.1e0 * error_count - CASE WHEN memory_mb > 8000 THEN 0.1e0 ELSE 0.0e0 END)) AS confidence FROM (SELECT *, {CP_SECONDS} AS s FROM checkpoints)""",
    "confidence",
)
def _(r):
    c = r.checkpoints
    return c.select("id", R.recovery_action("processed_count", "error_count", "created_at", now()).alias("action"), R.recovery_confidence("error_count", "memory_mb", "created_at", now()).alias("confidence"))


@query(
    "f48_resume_options",
    """WITH c AS (SELECT id, processed_count - 10 AS done, (processed_count - 10) // 20 * 20 AS start, CASE WHEN id % 6 = 0 THEN 0.0e0 ELSE 2.5e0 END AS rate FROM checkpoints)
    SELECT id, 'fresh_start' AS option, 0::BIGINT AS start_index, CASE WHEN rate > 0 THEN 500 / rate END AS seconds_left FROM c UNION ALL SELECT id, 'continue', done, CASE WHEN rate > 0 THEN greatest(0, 500 - done) / rate END FROM c WHERE done > 0
    UNION ALL SELECT id, 'restart_batch', start, CASE WHEN rate > 0 THEN greatest(0, 500 - start) / rate END FROM c WHERE start > 0""",
    "seconds_left",
)
def _(r):
    done = F.col("processed_count") - 10
    points = R.resume_points(done, F.floor(done / 20) * 20, F.lit(500), F.when(F.col("id") % 6 == 0, 0.0).otherwise(2.5))
    return r.checkpoints.select("id", F.inline(points))


@query("f48_options", "SELECT id, concat_ws(',', 'fresh_start', CASE WHEN processed_count - 10 > 0 THEN 'continue' END, CASE WHEN (processed_count - 10) // 20 > 0 THEN 'restart_batch' END) AS options, greatest(0, 500 - processed_count) / 2.5e0 AS seconds_left FROM checkpoints", "seconds_left")
def _(r):
    done = F.col("processed_count") - 10
    return r.checkpoints.select("id", F.array_join(R.resume_options(done, F.floor(done / 20)), ",").alias("options"), (F.greatest(F.lit(0), 500 - F.col("processed_count")) / 2.5).alias("seconds_left"))


STATE = """concat('{"checkpoint_type":"', checkpoint_type, '","error_count":', error_count, ',"processed_count":', processed_count, ',"session_id":', session_id, '}')"""


@query(
    "f49_state_hash",
    f"""SELECT id, sha256({STATE}) AS state_hash, id % 9 <> 4 AND id % 11 <> 5 AND EXISTS (SELECT 1 FROM sessions s WHERE s.id = c.session_id) AS valid FROM checkpoints c""",
)
def _(r):
    fields = ("session_id", "processed_count", "error_count", "checkpoint_type")
    # Of every nine stored hashes one is that of another count, of every eleven one is missing; sessions come from another table, so some are unknown.
    stored = F.when(F.col("id") % 9 == 4, F.sha2(F.concat(R.state_hash(*fields), F.lit("!")), 256)).when(F.col("id") % 11 != 5, R.state_hash(*fields))
    rows = r.checkpoints.withColumn("stored", stored)
    return R.state_valid(rows, r.sessions, "stored", *fields).select("id", R.state_hash(*fields).alias("state_hash"), "valid")


@query(
    "v01_validate_decisions",
    f"""SELECT item_id, concat_ws(',', CASE WHEN item_id % 13 = 0 THEN 'missing_path' END, CASE WHEN item_id % 19 = 0 THEN 'invalid_decision' END, CASE WHEN confidence + (item_id % 23) / 22.0e0 > 1 THEN 'confidence_out_of_range' END,
      CASE WHEN item_id % 19 <> 0 AND decision = 'rejected' AND reasons = '' THEN 'rejected_without_reasons' END, CASE WHEN item_id % 19 <> 0 AND decision = 'approved' AND reasons <> '' THEN 'approved_with_reasons' END) AS problems FROM ({DECIDED})""",
)
def _(r):
    i = F.col("item_id")
    df = decided(r).withColumns({"image_path": F.when(i % 13 != 0, F.col("image_path")), "decision": F.when(i % 19 == 0, "maybe").otherwise(F.col("decision")), "confidence": F.col("confidence") + i % 23 / 22.0})
    return df.select("item_id", F.array_join(R.validate_decisions(), ",").alias("problems"))


@query(
    "v03_validate_ranges",
    "SELECT item_id, concat_ws(',', CASE WHEN sharpness < 10 THEN 'sharpness' END, CASE WHEN noise < 0 OR noise > 0.15e0 THEN 'noise' END, CASE WHEN source_folder NOT IN ('src0', 'src1', 'src2') THEN 'source_folder' END) AS problems FROM scored",
)
def _(r):
    return r.scored.select("item_id", F.array_join(R.validate_ranges({"sharpness": (10, None), "noise": (0, 0.15)}, {"source_folder": ["src0", "src1", "src2"]}), ",").alias("problems"))


@query(
    "v02_validate_thresholds",
    "SELECT l_returnflag AS preset, ((avg(l_discount) NOT BETWEEN 0 AND 1)::INT + (avg(l_quantity) NOT BETWEEN 0 AND 1)::INT + (abs(5 * avg(l_discount) - 1) > 0.01)::INT)::BIGINT AS n FROM lineitem GROUP BY 1",
)
def _(r):
    """Thresholds as the averages of each return flag (three at most), checked on the driver as a caller would."""
    means = r.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").cast("double").alias("d"), F.avg("l_quantity").cast("double").alias("q")).collect()
    rows = [(m.l_returnflag, len(R.validate_thresholds({"low": m.d, "high": m.q, "weights": (m.d,) * 5}))) for m in means]
    return r.spark.createDataFrame(rows, "preset string, n long")
