"""Queries of filters, projections, joins, pages and set operations (P, J, L, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnower.operators import results as O
from winnower.plans.registry import query
from winnower.plans.scores import DECIDED, decided

COLS = "item_id, session_id, filename, final_decision"


def results(r):
    """The results view with reasons as an array."""
    return r.results.withColumn("reasons", F.filter(F.split("reasons", ","), lambda x: x != ""))


@query("p01_filter_results", f"SELECT {COLS} FROM results WHERE final_decision = 'review_required' AND list_contains(string_split(reasons, ','), 'low_quality') AND filename ILIKE '%IMG_1%'")
def _(r):
    return O.filter_results(results(r), "review_required", "Low image quality", search="IMG_1").select(*COLS.split(", "))


@query("p02_review_queue", f"SELECT {COLS} FROM results WHERE human_review_at IS NOT NULL AND final_decision = 'review_required'")
def _(r):
    return O.review_queue(results(r), "review_required", human_reviewed=True).select(*COLS.split(", "))


@query("p03_list_sessions", "SELECT id, project_id, status FROM sessions WHERE status IN ('running', 'paused') ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 10")
def _(r):
    return O.list_sessions(r.sessions, status=["running", "paused"], limit=40, offset=10).select("id", "project_id", "status")


#: Projects with the state of their newest session, when they were made and last changed.
PROJECTS = """SELECT p.id, p.name, coalesce(s.status, 'idle') AS status, coalesce(f.created_at, TIMESTAMP '1990-01-01 00:00:00') AS created_at, coalesce(s.updated_at, TIMESTAMP '1990-01-01 00:00:00') AS updated_at FROM projects p
  LEFT JOIN (SELECT project_id, min(created_at) AS created_at FROM sessions GROUP BY 1) f ON f.project_id = p.id LEFT JOIN (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1) s ON s.project_id = p.id"""


def dated_projects(r):
    last = r.sessions.groupBy("project_id").agg(F.max_by(F.struct("status", "updated_at"), F.struct("created_at", "id")).alias("s"), F.min("created_at").alias("created_at"))
    old = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    df = r.projects.select("id", "name").join(last, F.col("id") == F.col("project_id"), "left")
    return df.select("id", "name", F.coalesce("s.status", F.lit("idle")).alias("status"), F.coalesce("created_at", old).alias("created_at"), F.coalesce("s.updated_at", old).alias("updated_at"))


@query("p03_list_projects", f"SELECT id, name FROM ({PROJECTS}) WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 10")
def _(r):
    return O.list_projects(dated_projects(r), "completed", 40, 10).select("id", "name")


@query("p03_active_projects", f"SELECT id, name, status FROM ({PROJECTS}) WHERE status IN ('running', 'paused')")
def _(r):
    return O.active_projects(dated_projects(r)).select("id", "name", "status")


@query("p03_concurrent_sessions", "SELECT id, project_id, status FROM (SELECT id, project_id, CASE WHEN status = 'paused' THEN 'created' ELSE status END AS status FROM sessions) WHERE status IN ('running', 'created')")
def _(r):
    made = r.sessions.withColumn("status", F.when(F.col("status") == "paused", "created").otherwise(F.col("status")))  # the view has none that are created
    return O.concurrent_sessions(made).select("id", "project_id", "status")


@query(
    "p04_session_status",
    """SELECT id, status, CASE WHEN total_images = 0 THEN 0.0e0 ELSE round(100.0e0 * processed_images / total_images, 2) END AS progress,
      CASE WHEN processed_images = 0 THEN 0.0e0 ELSE round(100.0e0 * approved_images / processed_images, 2) END AS approval FROM sessions""",
    "progress approval",
)
def _(r):
    return O.session_status(r.sessions)


@query("p05_activity_type", "SELECT item_id, CASE WHEN human_override THEN 'human_override' WHEN final_decision IN ('approved', 'rejected') THEN final_decision ELSE 'processed' END AS activity FROM results")
def _(r):
    return r.results.select("item_id", O.activity_type().alias("activity"))


@query("p06_grid_view", "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 0.0e0 ELSE overall END AS overall, CASE WHEN item_id % 4 = 0 THEN 0.0e0 ELSE sharpness END AS sharpness, CASE WHEN item_id % 4 = 0 THEN 0.0e0 ELSE noise END AS noise, CASE WHEN item_id % 4 = 0 THEN 0.0e0 ELSE brightness END AS exposure, coalesce(source_folder, 'Unknown') AS folder FROM scored", "overall sharpness noise exposure")
def _(r):
    nested = F.when(F.col("item_id") % 4 != 0, F.struct("overall", "sharpness", "noise", F.col("brightness").alias("exposure")))
    return O.grid_view(r.scored.withColumn("quality", nested))


SUMMARY = "quality_score, overall_score, weighted_score"


@query(
    "p07_decision_summary",
    f"""SELECT d.item_id, d.decision, round(d.quality_score::DECIMAL(20,10), 3) AS quality_score, round(d.overall_score::DECIMAL(20,10), 3) AS overall_score, round(d.weighted_score::DECIMAL(20,10), 3) AS weighted_score, round(s.processing_time::DECIMAL(20,10), 4) AS processing_time, n::INT AS rejection_count,
      regexp_replace(array_to_string(string_split(reasons, ',')[1:3], ','), ':[a-z]+', '', 'g') AS first_reasons FROM ({DECIDED}) d JOIN scored s ON s.item_id = d.item_id""",
    "quality_score overall_score weighted_score processing_time",
)
def _(r):
    return O.decision_summary(decided(r), SUMMARY.split(", "))


@query(
    "p09_checkpoint_listing",
    "SELECT id, session_id, created_at, checkpoint_type, processed_count, (processed_count // 20)::BIGINT AS current_batch, error_count FROM checkpoints WHERE id % 50 <> 0",
)
def _(r):
    state = F.to_json(F.struct("processed_count", F.floor(F.col("processed_count") / 20).cast("long").alias("current_batch"), "error_count"))
    rows = r.checkpoints.withColumn("session_state", F.when(F.col("id") % 50 == 0, "{broken").otherwise(state))
    return O.checkpoint_listing(rows.drop("processed_count", "error_count"))


@query("p10_resumable_sessions", "SELECT id FROM sessions WHERE status IN ('running', 'paused', 'failed') AND input_folder = '/in/2' AND output_folder = '/out/1'")
def _(r):
    return O.resumable_sessions(r.sessions, "/in/2", "/out/1").select("id")


@query("j01_with_groups", "SELECT i.item_id, coalesce(c.cluster_id, 0) AS similarity_group FROM items i LEFT JOIN (SELECT * FROM clusters WHERE cluster_id > 0) c ON c.item_id = i.item_id")
def _(r):
    return O.with_groups(r.items, r.clusters.where("cluster_id > 0")).select("item_id", "similarity_group")


@query("j02_assemble", "SELECT i.item_id, q.sharpness, d.anomaly, m.quality AS label FROM items i LEFT JOIN quality q ON q.item_id = i.item_id LEFT JOIN defects d ON d.item_id = i.item_id LEFT JOIN marks m ON m.doc_id = i.item_id", "anomaly")
def _(r):
    df = O.assemble(r.items, quality=r.quality, defects=r.defects, compliance=r.marks.withColumnRenamed("doc_id", "item_id"))
    return df.select("item_id", "quality.sharpness", "defects.anomaly", F.col("compliance.quality").alias("label"))


@query("j03_sessions_with_project", "SELECT s.id, s.project_id, coalesce(p.name, 'Unknown') AS project_name FROM sessions s LEFT JOIN projects p ON p.id = s.project_id")
def _(r):
    return O.sessions_with_project(r.sessions, r.projects).select("id", "project_id", "project_name")


@query("j04_group_neighbours", "SELECT a.item_id, b.item_id AS other_id FROM results a JOIN results b ON a.session_id = b.session_id AND a.similarity_group = b.similarity_group AND a.similarity_group <> 0 AND a.item_id <> b.item_id")
def _(r):
    return O.group_neighbours(r.results)


@query(
    "j05_expand_similar",
    """SELECT a.item_id, b.item_id AS other_id, CASE WHEN a.item_id % 2 = 0 THEN 0.0e0 ELSE 0.9e0 END AS similarity FROM results a JOIN results b ON a.session_id = b.session_id AND (b.image_path = concat('/in/', a.source_folder, '/', a.item_id + 160, '.jpg') OR b.image_path = a.image_path) WHERE a.item_id <> b.item_id""",
    "similarity",
)
def _(r):
    s = lambda path: F.struct(path.alias("path"), F.when(F.col("item_id") % 2 != 0, 0.9).alias("similarity"))
    other = F.concat(F.lit("/in/"), F.col("source_folder"), F.lit("/"), F.col("item_id") + 160, F.lit(".jpg"))
    return O.expand_similar(r.results.withColumn("similar_images", F.array(s(other), s(F.col("image_path")), s(F.lit("/none.jpg")))))


@query("j06_cluster_pairs", "SELECT a.cluster_id, a.item_id AS a, b.item_id AS b FROM clusters a JOIN clusters b ON a.cluster_id = b.cluster_id AND a.cluster_id <> 0 AND a.item_id < b.item_id")
def _(r):
    return O.cluster_pairs(r.clusters)


LABELS = "[" + ", ".join(f"'{k}'" for k in O.REASON_LABELS) + "]", "[" + ", ".join(f"'{v}'" for v in O.REASON_LABELS.values()) + "]"


@query("j07_translate_reasons", f"SELECT item_id, array_to_string(list_transform(list_filter(string_split(reasons, ','), lambda x: x <> ''), lambda x: coalesce({LABELS[1]}[list_position({LABELS[0]}, x)], x)), ';') AS labels FROM results")
def _(r):
    return results(r).select("item_id", F.array_join(O.translate_reasons("reasons"), ";").alias("labels"))


@query("j08_remaining_items", "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM results WHERE final_decision = 'approved')")
def _(r):
    return O.remaining_items(r.items, r.results.where("final_decision = 'approved'")).select("item_id")


@query("j09_orphans", "SELECT DISTINCT item_id FROM detections WHERE item_id NOT IN (SELECT item_id FROM results)")
def _(r):
    return O.orphans(r.detections.select("item_id").distinct(), r.results)


@query("j10_select_for_review", "SELECT item_id, 'found' AS state FROM results WHERE item_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0) UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey NOT IN (SELECT item_id FROM results)")
def _(r):
    ids = r.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("item_id"))
    found = O.select_for_review(r.results, ids).select("item_id", F.lit("found").alias("state"))
    return found.unionByName(O.missing_ids(r.results, ids).withColumn("state", F.lit("missing")))


@query(
    "j11_latest_checkpoint",
    "SELECT session_id, status, checkpoint_id, processed_count FROM (SELECT s.id AS session_id, s.status, c.id AS checkpoint_id, c.processed_count, row_number() OVER (PARTITION BY s.id ORDER BY c.created_at DESC, c.id DESC) AS k FROM sessions s JOIN checkpoints c ON c.session_id = s.id) WHERE k = 1",
)
def _(r):
    return O.latest_checkpoint(r.sessions, r.checkpoints)


@query("l01_sorted_page", f"SELECT {COLS} FROM results ORDER BY overall DESC NULLS LAST, item_id LIMIT 50 OFFSET 50")
def _(r):
    return O.sorted_page(r.results, "confidence", page=2).select(*COLS.split(", "))


@query("l02_review_page", "SELECT count(*) AS total_count, ceil(count(*) / 50.0)::BIGINT AS total_pages, 2 < ceil(count(*) / 50.0) AS has_next, true AS has_prev FROM results WHERE final_decision = 'review_required'")
def _(r):
    return O.page_info(O.review_queue(results(r), "review_required"), page=2)


@query("l03_recent", f"SELECT {COLS} FROM results ORDER BY created_at DESC NULLS LAST, item_id LIMIT 20")
def _(r):
    return O.recent(r.results, 20).select(*COLS.split(", "))


@query("l04_results_page", f"SELECT {COLS} FROM results WHERE final_decision = 'rejected' ORDER BY created_at DESC NULLS LAST, item_id LIMIT 30 OFFSET 10")
def _(r):
    return O.results_page(r.results, 10, 30, "rejected").select(*COLS.split(", "))


@query(
    "u01_compare_structure",
    """WITH a AS (SELECT DISTINCT o_custkey::VARCHAR AS name FROM orders), b AS (SELECT DISTINCT l_suppkey::VARCHAR AS name FROM lineitem)
      SELECT name, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT name, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def _(r):
    return O.compare_structure(r.orders.select(F.col("o_custkey").cast("string").alias("name")), r.lineitem.select(F.col("l_suppkey").cast("string").alias("name")))


@query(
    "u01_structure_valid",
    """WITH a AS (SELECT DISTINCT o_custkey::VARCHAR AS name FROM orders), b AS (SELECT DISTINCT l_suppkey::VARCHAR AS name FROM lineitem), m AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b)), x AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
      SELECT 'all' AS input, m.n AS n_missing, x.n AS n_extra, m.n + x.n = 0 AS valid FROM m, x UNION ALL SELECT 'same', 0, 0, true""",
)
def _(r):
    source, target = (r.orders.select(F.col("o_custkey").cast("string").alias("name")), r.lineitem.select(F.col("l_suppkey").cast("string").alias("name")))
    every = O.structure_valid(source, target).select(F.lit("all").alias("input"), "*")
    return every.unionByName(O.structure_valid(source, source).select(F.lit("same").alias("input"), "*"))


@query(
    "u02_union_defects",
    """SELECT item_id, object_type, defect_type, confidence, defect_type || ' on ' || object_type AS description FROM detections WHERE n = 1
      UNION ALL SELECT item_id, 'edge_feature', defect_type, confidence, defect_type || ' with high severity' FROM detections WHERE n = 2
      UNION ALL SELECT item_id, 'tall', 'shape_anomaly', confidence, 'unusual shape' FROM detections WHERE n = 3""",
    "confidence",
)
def _(r):
    d = r.detections
    return O.union_defects(d.where("n = 1"), d.where("n = 2").withColumn("severity", F.lit("high")), d.where("n = 3").withColumn("shape", F.lit("tall")))


@query("u03_distinct_reasons", "SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(reasons, ','), lambda x: x <> ''), CASE WHEN item_id % 2 = 0 THEN ['low_quality', 'copyright'] ELSE [] END))), ',') AS reasons FROM results")
def _(r):
    more = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("low_quality"), F.lit("copyright")))
    return results(r).withColumn("more", more).select("item_id", F.array_join(F.array_sort(O.distinct_reasons("reasons", "more")), ",").alias("reasons"))


@query("u04_mirror_paths", "SELECT item_id, CASE WHEN starts_with(image_path, '/in/src1/') THEN '/in/src1_processed' || substr(image_path, 9) END AS mirrored FROM items")
def _(r):
    return r.items.select("item_id", O.mirror_path("image_path", "/in/src1").alias("mirrored"))


@query("p08_select_analyses", "SELECT 'quality' AS analysis, item_id FROM quality UNION ALL SELECT 'defect', item_id FROM defects")
def _(r):
    every = {"quality": r.quality, "defect": r.defects, "compliance": r.scored, "similarity": r.clusters}
    out = None
    for name, df in O.select_analyses(every, ["quality", "defect"]).items():
        one = df.select(F.lit(name).alias("analysis"), "item_id")
        out = one if out is None else out.unionByName(one)
    return out
