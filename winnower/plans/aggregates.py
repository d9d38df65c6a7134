"""Queries of the aggregations (A-01 to A-31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnower.functions import rules as R
from winnower.operators import aggregates as A
from winnower.operators import metric as M
from winnower.plans.registry import query
from winnower.plans.results import results
from winnower.plans.rules import ERRORS, classified, now
from winnower.plans.scores import DECIDED, DETECTOR, NAMES, decided
from winnower.plans.windows import PAIRS, pairs

COUNTS = """count(*) AS total, count(*) FILTER (WHERE final_decision = 'approved') AS approved, count(*) FILTER (WHERE final_decision = 'rejected') AS rejected,
  coalesce(sum(processing_time) FILTER (WHERE processing_time <> 0), 0.0e0) AS total_time, coalesce(avg(processing_time) FILTER (WHERE processing_time <> 0), 0.0e0) AS avg_time,
  coalesce(avg(overall), 0.0e0) AS avg_quality, count(*) FILTER (WHERE human_override) AS overrides"""
SUMMARY = f"SELECT *, total - approved - rejected AS pending, approved::DOUBLE / total AS approval_rate FROM (SELECT session_id, {COUNTS} FROM results GROUP BY session_id)"


@query("a01_session_summary", SUMMARY, "total_time avg_time avg_quality approval_rate")
def _(r):
    return A.session_summary(r.results)


EXPLODED = "SELECT final_decision, unnest(list_filter(string_split(reasons, ','), lambda x: x <> '')) AS reason FROM results"


@query("a02_rejection_breakdown", f"SELECT reason, count(*) AS n, 100.0e0 * count(*) / (SELECT count(*) FROM results WHERE final_decision = 'rejected') AS percent FROM ({EXPLODED}) WHERE final_decision = 'rejected' GROUP BY reason", "percent")
def _(r):
    return A.rejection_breakdown(results(r))


@query(
    "a03_decision_aggregate",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'approved') AS approved, count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) FILTER (WHERE decision = 'review_required') AS review_required, avg(quality_score) AS avg_quality, avg(overall_score) AS avg_overall, avg((decision = 'approved')::INT) AS approval_rate FROM ({DECIDED})",
    "avg_quality avg_overall approval_rate",
)
def _(r):
    return A.decision_aggregate(decided(r))


REASON_ROWS = f"SELECT split_part(x, ':', 1) AS reason FROM (SELECT unnest(string_split(reasons, ',')) AS x FROM ({DECIDED}) WHERE reasons <> '')"


@query("a04_reason_categories", f"SELECT CASE reason WHEN 'low_quality_score' THEN 'quality' WHEN 'defects_detected' THEN 'defect' WHEN 'similar_images' THEN 'similarity' ELSE 'compliance' END AS category, count(*) AS n FROM ({REASON_ROWS}) GROUP BY 1")
def _(r):
    return A.reason_categories(decided(r))


@query("a04_top_reasons", f"SELECT reason, count(*) AS n FROM ({REASON_ROWS}) GROUP BY 1 ORDER BY n DESC, reason LIMIT 2")
def _(r):
    return A.top_reasons(decided(r), 2)


@query("a05_processing_statistics", "SELECT avg(processing_time) AS avg_time, min(processing_time) AS min_time, max(processing_time) AS max_time, sum(processing_time) AS total_time FROM results WHERE processing_time > 0", "avg_time min_time max_time total_time")
def _(r):
    return A.processing_statistics(r.results)


@query("a06_approval_chart", f"SELECT label, value, 100.0e0 * value / total AS percent FROM (SELECT {COUNTS} FROM results) t, LATERAL (VALUES ('approved', approved), ('rejected', rejected), ('pending', total - approved - rejected)) v(label, value)", "percent")
def _(r):
    return A.approval_chart(r.results)


@query("a07_quality_histogram", "SELECT b::INT AS bin, count(q.item_id) AS n FROM range(10) t(b) LEFT JOIN (SELECT item_id, least(floor(overall * 10), 9) AS k FROM results WHERE overall BETWEEN 0 AND 1) q ON q.k = t.b GROUP BY b")
def _(r):
    return A.quality_histogram(r.results)


@query("a08_hourly_timeline", "SELECT date_trunc('hour', created_at) AS hour, count(*) FILTER (WHERE final_decision = 'approved') AS approved, count(*) FILTER (WHERE final_decision = 'rejected') AS rejected, count(*) FILTER (WHERE final_decision IN ('approved', 'rejected')) AS value FROM results WHERE created_at IS NOT NULL GROUP BY 1")
def _(r):
    df = A.hourly_timeline(r.results)
    return df.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("a09_folder_breakdown", "SELECT coalesce(source_folder, 'Unknown') AS folder, count(*) AS total, count(*) FILTER (WHERE final_decision = 'approved') AS approved, count(*) FILTER (WHERE final_decision = 'rejected') AS rejected, 100.0e0 * count(*) FILTER (WHERE final_decision = 'approved') / count(*) AS rate FROM results GROUP BY 1", "rate")
def _(r):
    return A.folder_breakdown(r.results)


@query(
    "a10_facet_values",
    f"""SELECT (SELECT string_agg(DISTINCT final_decision, ',' ORDER BY final_decision) FROM results) AS decisions, (SELECT string_agg(DISTINCT reason, ',' ORDER BY reason) FROM ({EXPLODED})) AS reasons,
      (SELECT string_agg(DISTINCT source_folder, ',' ORDER BY source_folder) FROM results) AS folders, min(created_at) AS "first", max(created_at) AS "last", min(overall) AS min_score, max(overall) AS max_score FROM results""",
    "min_score max_score",
)
def _(r):
    df = A.facet_values(results(r))
    return df.withColumns({c: F.array_join(c, ",") for c in ("decisions", "reasons", "folders")})


@query(
    "a11_facet_counts",
    f"""SELECT 'all' AS facet, 'all' AS label, count(*) AS n FROM results UNION ALL SELECT 'decision', final_decision, count(*) FROM results GROUP BY 2 UNION ALL SELECT 'folder', source_folder, count(*) FROM results GROUP BY 2
      UNION ALL SELECT 'reviewed', CASE WHEN human_review_at IS NOT NULL THEN 'reviewed' ELSE 'not_reviewed' END, count(*) FROM results GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM ({EXPLODED}) GROUP BY 2""",
)
def _(r):
    return A.facet_counts(results(r))


COMPARED = f"SELECT *, CASE WHEN total_time = 0 THEN 0.0e0 ELSE total / (total_time / 60) END AS per_minute, approval_rate * (1 - overrides::DOUBLE / total) AS efficiency FROM ({SUMMARY})"


@query("a12_compare_sessions", f"SELECT * FROM ({COMPARED}) WHERE session_id IN (1, 2, 5)", "total_time avg_time avg_quality approval_rate per_minute efficiency")
def _(r):
    return A.compare_sessions(r.results, [1, 2, 5])


@query("a13_comparison_recommendations", f"SELECT unnest(list_filter([CASE WHEN max(approval_rate) > 0.8 THEN 'use_best_approval' END, CASE WHEN max(efficiency) > 0.7 THEN 'use_best_efficiency' END, CASE WHEN avg(approval_rate) < 0.5 THEN 'review_thresholds' END], lambda x: x IS NOT NULL)) AS code FROM ({COMPARED})")
def _(r):
    return A.comparison_recommendations(A.compare_sessions(r.results))


@query(
    "a14_project_statistics",
    """SELECT project_id, count(*) AS sessions, sum(processed_images)::BIGINT AS processed, sum(approved_images)::BIGINT AS approved, sum(rejected_images)::BIGINT AS rejected, CASE WHEN sum(processed_images) = 0 THEN 0.0e0 ELSE 100.0e0 * sum(approved_images) / sum(processed_images) END AS approval,
      arg_max(total_images, (created_at, id))::BIGINT AS latest_total, arg_max(status, (created_at, id)) AS latest_status FROM sessions GROUP BY project_id""",
    "approval",
)
def _(r):
    return A.project_statistics(r.sessions)


@query(
    "a15_batch_statistics",
    """SELECT run_id, sum(n)::BIGINT AS processed, sum(errors)::BIGINT AS errors, avg(seconds) AS avg_batch_time, avg(memory) AS avg_memory, 100.0e0 * (sum(n) - sum(errors)) / sum(n) AS success FROM (SELECT user_id AS run_id, event_id // 200 AS batch, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, sum(value / 97) AS seconds, avg(value / 93) AS memory FROM events GROUP BY ALL) GROUP BY run_id""",
    "avg_batch_time avg_memory success",
)
def _(r):
    e = r.events
    return A.batch_statistics(e.select(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 200).alias("batch"), (F.col("event_type") == "error").alias("failed"), (F.col("value") / 97).alias("seconds"), (F.col("value") / 93).alias("memory_mb")))


@query(
    "a16_unified_batch_statistics",
    f"SELECT avg((decision = 'approved')::INT) AS approval_rate, avg((decision = 'rejected')::INT) AS rejection_rate, avg(overall_score) AS mean_score, avg(confidence) AS mean_confidence, avg((item_id % 5 = 0)::INT) AS fallback_rate, (SELECT count(DISTINCT item_id % 3) + 1 FROM items)::BIGINT AS models FROM ({DECIDED})",
    "approval_rate rejection_rate mean_score mean_confidence fallback_rate",
)
def _(r):
    i = F.col("item_id")
    df = decided(r).select("decision", F.col("overall_score").alias("score"), "confidence", (i % 5 == 0).alias("fallback"), F.array(F.lit("base"), F.concat(F.lit("m"), i % 3)).alias("models"))
    return A.unified_batch_statistics(df)


@query(
    "a17_defect_rollup",
    """SELECT *, anomaly <= 0.3e0 AND n <= 3 AND high <= 1 AS passed FROM (SELECT o.o_orderkey AS item_id, count(d.n) AS n, count(DISTINCT defect_type) AS kinds, coalesce(avg(confidence), 0.0e0) AS mean, count(*) FILTER (WHERE confidence > 0.5e0) AS high,
      least(1.0e0, count(d.n) * coalesce(avg(confidence), 0.0e0) / 10) AS anomaly FROM orders o LEFT JOIN detections d ON d.item_id = o.o_orderkey GROUP BY 1)""",
    "mean anomaly",
)
def _(r):
    return A.defect_rollup(r.orders.select(F.col("o_orderkey").alias("item_id")), r.detections)


@query("a18_detector_rollup", f"SELECT item_id, n, mean_confidence, confident, replace(names, 'defect_', '') AS types, score FROM ({DETECTOR})", "mean_confidence score")
def _(r):
    return A.detector_rollup(r.detections).withColumn("types", F.array_join(F.array_sort("types"), ","))


@query("a18_detector_types", "SELECT item_id, defect_type, count(*) AS n FROM detections GROUP BY ALL")
def _(r):
    return A.detector_types(r.detections)


@query(
    "a19_compliance_rollup",
    """SELECT item_id, logo, privacy_count::BIGINT AS privacy, (CASE WHEN issue_count > 0 THEN 1 ELSE 0 END)::BIGINT AS metadata, concat_ws(',', CASE WHEN issue_count > 0 THEN 'metadata_issues' END, CASE WHEN logo > 0 THEN 'nike' END, CASE WHEN privacy_count > 0 THEN 'toxic' END) AS main_issues,
      logo = 0 AND privacy_count = 0 AND issue_count = 0 AND relevance >= 0.5 AS compliant FROM (SELECT *, (CASE WHEN item_id % 9 = 0 THEN 2 ELSE 0 END)::BIGINT AS logo, (item_id % 4) / 4.0e0 AS relevance FROM scored)""",
)
def _(r):
    s = r.scored
    issue = lambda cond, name: s.where(cond).select("item_id", F.lit(name).alias("issue"))
    logos = issue("item_id % 9 = 0", "nike")
    df = A.compliance_rollup(s.select("item_id", (F.col("item_id") % 4 / 4.0).alias("relevance")), logos.unionByName(logos), issue("privacy_count > 0", "toxic"), issue("issue_count > 0", "metadata_issues"))
    return df.select("item_id", "logo", "privacy", "metadata", F.array_join("main_issues", ",").alias("main_issues"), "compliant")


@query(
    "a20_cluster_stats",
    f"""SELECT cluster_id, round(avg, 3) AS avg, max, min, round(variance, 3) AS variance, identical, near_duplicate, "similar", somewhat_similar, CASE WHEN avg > 0.85 THEN 'high' WHEN avg > 0.75 THEN 'medium' ELSE 'low' END AS quality,
      CASE WHEN avg >= 0.95 THEN 'remove_duplicates' WHEN avg >= 0.90 THEN 'review_duplicates' WHEN avg >= 0.75 THEN 'review_similar' ELSE 'keep_all' END AS recommendation FROM (SELECT cluster_id, avg(similarity) AS avg, max(similarity) AS max, min(similarity) AS min, var_pop(similarity) AS variance,
      count(*) FILTER (WHERE similarity >= 0.95) AS identical, count(*) FILTER (WHERE similarity >= 0.9 AND similarity < 0.95) AS near_duplicate, count(*) FILTER (WHERE similarity >= 0.75 AND similarity < 0.9) AS "similar", count(*) FILTER (WHERE similarity < 0.75) AS somewhat_similar FROM ({PAIRS}) GROUP BY cluster_id)""",
    "avg max min variance",
)
def _(r):
    return A.cluster_stats(pairs(r))


@query(
    "a20_vector_cluster_stats",
    f"""SELECT cluster_id, n_pairs, round(avg, 3) AS avg, round(max, 3) AS max, round(min, 3) AS min, round(variance, 3) AS variance, identical, near_duplicate, "similar", somewhat_similar, CASE WHEN avg > 0.85 THEN 'high' WHEN avg > 0.75 THEN 'medium' ELSE 'low' END AS quality,
      CASE WHEN avg >= 0.95 THEN 'remove_duplicates' WHEN avg >= 0.90 THEN 'review_duplicates' WHEN avg >= 0.75 THEN 'review_similar' ELSE 'keep_all' END AS recommendation FROM (SELECT cluster_id, count(*) AS n_pairs, avg(c) AS avg, max(c) AS max, min(c) AS min, var_pop(c) AS variance,
      count(*) FILTER (WHERE c >= 0.4) AS identical, count(*) FILTER (WHERE c >= 0.3 AND c < 0.4) AS near_duplicate, count(*) FILTER (WHERE c >= 0.2 AND c < 0.3) AS "similar", count(*) FILTER (WHERE c < 0.2) AS somewhat_similar FROM (
        SELECT a.label::BIGINT AS cluster_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) GROUP BY cluster_id)""",
    "avg max min variance",
)
def _(r):
    v = r.embeddings.select("vec_id", "embedding", F.col("label").cast("long").alias("cluster_id"))
    return A.graded_stats(M.cluster_cosines(v, levels={"identical": 0.4, "near_duplicate": 0.3, "similar": 0.2}))


@query(
    "a21_group_statistics",
    """SELECT count(*) AS groups, count(*) FILTER (WHERE kind = 'singleton') AS singletons, count(*) FILTER (WHERE kind = 'duplicate') AS duplicate_groups, count(*) FILTER (WHERE kind = 'similar') AS similar_groups, coalesce(sum(size - 1) FILTER (WHERE kind = 'duplicate'), 0)::BIGINT AS duplicates,
      coalesce(sum(size - 1) FILTER (WHERE kind = 'similar'), 0)::BIGINT AS similars, count(*) AS keeps, coalesce(sum(size - 1) FILTER (WHERE kind <> 'singleton'), 0)::BIGINT AS removes FROM (SELECT count(*) AS size, CASE WHEN cluster_id = 0 THEN 'singleton' WHEN cluster_id % 2 = 0 THEN 'duplicate' ELSE 'similar' END AS kind FROM clusters GROUP BY cluster_id, CASE WHEN cluster_id = 0 THEN item_id ELSE 0 END)""",
)
def _(r):
    c = F.col("cluster_id")
    groups = r.clusters.groupBy("cluster_id", F.when(c == 0, F.col("item_id")).otherwise(0).alias("own")).agg(F.count("*").alias("size"))
    return A.group_statistics(groups.withColumn("kind", F.when(c == 0, "singleton").when(c % 2 == 0, "duplicate").otherwise("similar")))


@query(
    "a22_integrity_counts",
    """WITH s AS (SELECT id, (id * 18 % 140)::BIGINT AS processed_images, approved_images, rejected_images, (id * 31 % 200)::BIGINT AS start_index FROM sessions), c AS (SELECT session_id, count(*) AS total, count(*) FILTER (WHERE final_decision = 'approved') AS approved, count(*) FILTER (WHERE final_decision = 'rejected') AS rejected FROM results GROUP BY 1)
    SELECT coalesce(id, session_id) AS id, coalesce(total, 0) AS total, coalesce(approved, 0) AS approved, coalesce(rejected, 0) AS rejected, concat_ws(',', CASE WHEN processed_images <> coalesce(total, 0) THEN 'total_mismatch' END, CASE WHEN approved_images <> coalesce(approved, 0) THEN 'approved_mismatch' END,
      CASE WHEN rejected_images <> coalesce(rejected, 0) THEN 'rejected_mismatch' END, CASE WHEN start_index > coalesce(total, 0) THEN 'index_beyond_results' END, CASE WHEN id IS NULL THEN 'missing_session' END) AS issues, id IS NOT NULL AND start_index <= coalesce(total, 0) AS safe FROM s FULL JOIN c ON c.session_id = s.id""",
)
def _(r):
    i = F.col("id")
    s = r.sessions.select("id", (i * 18 % 140).alias("processed_images"), "approved_images", "rejected_images", (i * 31 % 200).alias("start_index"))
    return A.integrity_counts(s, r.results).withColumn("issues", F.array_join("issues", ","))


@query("a23_duplicate_results", "SELECT session_id, image_path, count(*) AS n FROM (SELECT item_id % 8 AS session_id, concat('/in/', (item_id % 704)) AS image_path FROM items) GROUP BY ALL HAVING count(*) > 1")
def _(r):
    return A.duplicate_results(r.items.select((F.col("item_id") % 8).alias("session_id"), F.concat(F.lit("/in/"), F.col("item_id") % 704).alias("image_path")))


@query(
    "a24_error_statistics",
    f"""WITH e AS ({ERRORS}) SELECT 'total' AS kind, 'all' AS label, count(*) AS n FROM e UNION ALL SELECT 'category', category, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'exception', exception_type, count(*) FROM e GROUP BY 2
      UNION ALL SELECT 'resolved', CASE WHEN resolved THEN 'resolved' ELSE 'unresolved' END, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'retries', 'all', sum(retry_count)::BIGINT FROM e""",
)
def _(r):
    return A.error_statistics(classified(r.errors))


@query("a25_folder_usage", "SELECT coalesce(source_folder, 'total') AS folder, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM items GROUP BY ROLLUP (source_folder)")
def _(r):
    return A.folder_usage(r.items, "source_folder", "file_size")


@query(
    "a26_run_performance",
    "SELECT *, CASE WHEN elapsed = 0 THEN 0.0e0 ELSE n / elapsed::DOUBLE END AS per_second, elapsed::DOUBLE / n AS seconds_per_item FROM (SELECT session_id, count(*) AS n, max(memory_mb) AS peak_memory, max(gpu_mb) AS peak_gpu, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS elapsed FROM metrics GROUP BY 1)",
    "peak_memory peak_gpu per_second seconds_per_item",
)
def _(r):
    return A.run_performance(r.metrics)


@query(
    "a27_issue_counts",
    f"""SELECT session_id, count(*) AS total, count(*) FILTER (WHERE decision = 'approved') AS approved, count(*) FILTER (WHERE contains(reasons, 'low_quality')) AS quality_issues, count(*) FILTER (WHERE contains(reasons, 'defects')) AS defect_issues, count(*) FILTER (WHERE contains(reasons, 'similar')) AS similarity_issues,
      count(*) FILTER (WHERE contains(reasons, 'compliance')) AS compliance_issues, 100.0e0 * count(*) FILTER (WHERE decision = 'approved') / count(*) AS approval FROM ({DECIDED}) GROUP BY session_id""",
    "approval",
)
def _(r):
    return A.issue_counts(decided(r))


@query("a28_copy_summary", "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars % 5 <> 0) AS succeeded, count(*) FILTER (WHERE n_chars % 5 = 0) AS failed, count(DISTINCT source) AS folders FROM documents")
def _(r):
    return A.copy_summary(r.documents.select((F.col("n_chars") % 5 != 0).alias("good"), F.col("source").alias("folder")))


CRASHED = "SELECT CASE WHEN regexp_matches(lower(coalesce(error_message, '')), 'memory|oom') THEN 'out_of_memory' WHEN regexp_matches(lower(coalesce(error_message, '')), 'network|connection') THEN 'network_failure' WHEN regexp_matches(lower(coalesce(error_message, '')), 'crash|exception') THEN 'application_crash' ELSE 'power_failure' END AS crash_type, processed_images, total_images FROM sessions WHERE status = 'running'"


@query(
    "a29_crash_summary",
    f"""SELECT coalesce(crash_type, 'all') AS crash_type, count(*) AS crashed, count(*) FILTER (WHERE processed_images > 0) AS recoverable, count(*) FILTER (WHERE processed_images = 0) AS unrecoverable, sum(processed_images)::BIGINT AS processed, sum(total_images)::BIGINT AS total,
      100.0e0 * count(*) FILTER (WHERE processed_images > 0) / count(*) AS recovery FROM ({CRASHED}) GROUP BY ROLLUP (crash_type)""",
    "recovery",
)
def _(r):
    s = r.sessions.where("status = 'running'")
    return A.crash_summary(s.select(R.crash_type("error_message", "updated_at", now()).alias("crash_type"), (F.col("processed_images") > 0).alias("recoverable"), F.col("processed_images").alias("processed"), F.col("total_images").alias("total")))


@query("a30_table_counts", "SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def _(r):
    return A.table_counts({"documents": r.documents, "events": r.events, "lineitem": r.lineitem})


@query(
    "a31_score_statistics",
    f"""SELECT score, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75 FROM (UNPIVOT (SELECT {NAMES.replace(' ', ', ')} FROM ({DECIDED})) ON {NAMES.replace(' ', ', ')} INTO NAME score VALUE x) GROUP BY score""",
    "mean median std min max q25 q75",
)
def _(r):
    return A.score_statistics(decided(r), NAMES.split())


