"""Queries of reviews and table changes (X-01 to X-11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.functions.durable import checkpoint_root
from winnower.operators import lifecycle as L
from winnower.operators.scans import ranged, scan
from winnower.plans.registry import query
from winnower.plans.results import results
from winnower.sources.tables import create_table, read_table

NOW = "TIMESTAMP '1999-01-01 00:00:00'"


def _ratio(row: dict) -> dict:
    if row["n_chars"] % 10 == 0:
        raise ValueError(f"bad item {row['item_id']}")
    return {"ratio": 1000.0 / (row["n_chars"] % 10)}


@query(
    "x01_apply_analyzer",
    "SELECT doc_id AS item_id, CASE WHEN n_chars % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_chars % 10 = 0 THEN 'ValueError: bad item ' || doc_id END AS error, CASE WHEN n_chars % 10 <> 0 THEN 1000.0e0 / (n_chars % 10) END AS ratio FROM documents",
    "ratio",
)
def _(r):
    items = r.documents.select(F.col("doc_id").alias("item_id"), "n_chars")
    out = L.apply_analyzer(items, _ratio, T.StructType([T.StructField("ratio", T.DoubleType())])).drop("seconds")
    return out.withColumn("ratio", F.when(F.col("status") == "ok", F.col("ratio")))


def _ratios(rows):
    bad = rows["n_chars"] % 10 == 0
    if bad.any():
        raise ValueError(f"bad item {rows['item_id'][bad].iloc[0]}")
    return (1000.0 / (rows["n_chars"] % 10)).to_frame("ratio")


@query(
    "x01_apply_batches",
    "SELECT doc_id AS item_id, CASE WHEN n_chars % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_chars % 10 = 0 THEN 'ValueError: bad item ' || doc_id END AS error, CASE WHEN n_chars % 10 <> 0 THEN 1000.0e0 / (n_chars % 10) END AS ratio FROM documents",
    "ratio",
)
def _(r):
    items = r.documents.select(F.col("doc_id").alias("item_id"), "n_chars")
    out = L.apply_batches(items, _ratios, T.StructType([T.StructField("ratio", T.DoubleType())])).drop("seconds")
    return out.withColumn("ratio", F.when(F.col("status") == "ok", F.col("ratio")))


@query("x02_apply_model", "SELECT vec_id, list_max(embedding)::DOUBLE AS prediction FROM embeddings", "prediction")
def _(r):
    return L.apply_model(r.embeddings.select("vec_id", "embedding"), L.largest_model, "embedding", dims=64).select("vec_id", "prediction")


REVIEWS = "SELECT event_id % 1000 AS item_id, CASE WHEN event_id % 3 = 0 THEN 'approve' ELSE 'reject' END AS action, CASE WHEN event_id % 2 = 0 THEN 'copyright' END AS reason, ts AS reviewed_at FROM events WHERE event_type = 'click'"
LAST = f"SELECT item_id, arg_max(action, (reviewed_at, action)) AS action, arg_max(coalesce(reason, '-'), (reviewed_at, action)) AS reason FROM ({REVIEWS}) GROUP BY 1"
AFTER = f"SELECT s.item_id, s.session_id, s.final_decision AS old, CASE l.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE s.final_decision END AS final_decision, s.reasons, l.action, l.reason, s.human_override FROM results s LEFT JOIN ({LAST}) l ON l.item_id = s.item_id"


def reviews(r):
    i = F.col("event_id")
    e = r.events.where("event_type = 'click'")
    return e.select((i % 1000).alias("item_id"), F.when(i % 3 == 0, "approve").otherwise("reject").alias("action"), F.when(i % 2 == 0, "copyright").alias("reason"), F.col("ts").alias("reviewed_at"))


@query(
    "x04_review",
    f"SELECT item_id, final_decision, coalesce(human_override, false) OR action IS NOT NULL AS human_override, CASE WHEN action = 'reject' AND reason <> '-' THEN CASE WHEN reasons = '' THEN reason ELSE reasons || ',' || reason END ELSE reasons END AS reasons FROM ({AFTER})",
)
def _(r):
    df = L.review(results(r), reviews(r))
    return df.select("item_id", "final_decision", "human_override", F.array_join("reasons", ",").alias("reasons"))


def results_table(r) -> str:
    path = f"{checkpoint_root(r.spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    create_table(results(r), path, "session_id")
    return path


@query(
    "x04_review_table",
    f"SELECT item_id, final_decision, coalesce(human_override, false) OR action IS NOT NULL AS human_override, CASE WHEN action = 'reject' AND reason <> '-' THEN CASE WHEN reasons = '' THEN reason ELSE reasons || ',' || reason END ELSE reasons END AS reasons FROM ({AFTER})",
)
def _(r):
    path = results_table(r)
    L.review_table(r.spark, path, reviews(r))
    return read_table(r.spark, path).select("item_id", "final_decision", "human_override", F.array_join("reasons", ",").alias("reasons"))


@query("x11_purge_table", "SELECT item_id, session_id, final_decision FROM results WHERE session_id NOT IN (SELECT id FROM sessions WHERE status = 'completed')")
def _(r):
    path = results_table(r)
    L.purge_table(r.spark, path, r.sessions.where("status = 'completed'").select("id"))
    return read_table(r.spark, path).select("item_id", "session_id", "final_decision")


@query("x05_counter_deltas", f"SELECT session_id, sum((final_decision = 'approved')::INT - (old = 'approved')::INT)::BIGINT AS approved, sum((final_decision = 'rejected')::INT - (old = 'rejected')::INT)::BIGINT AS rejected FROM ({AFTER}) WHERE old <> final_decision GROUP BY 1")
def _(r):
    return L.counter_deltas(r.results, L.review(results(r), reviews(r)))


@query("x06_export_actions", f"SELECT item_id, CASE WHEN old = 'rejected' AND final_decision = 'approved' THEN 'copy' WHEN old = 'approved' AND final_decision = 'rejected' THEN 'remove' ELSE 'none' END AS action FROM ({AFTER}) WHERE old <> final_decision")
def _(r):
    return L.export_actions(r.results, L.review(results(r), reviews(r)))


@query("x07_resume", "SELECT item_id, i FROM (SELECT item_id, row_number() OVER (ORDER BY image_path, item_id) - 1 AS i FROM items) WHERE i < 640")
def _(r):
    from winnower.operators.windows import global_rank

    return L.resume(global_rank(r.items, ("image_path", "item_id"), "index"), "restart_batch", 640).select("item_id", F.col("index").alias("i"))


def indexed(r):
    """Results with their index within the session."""
    df = r.results.select("item_id", "session_id", "image_path", "final_decision")
    order = ("image_path", "item_id")
    return scan(ranged(df, "session_id", order), "session_id", order, {"_n": F.lit(1)}).withColumn("index", F.col("_n") - 1).drop("_n", "_part")


def resume_points(r):
    """Every other session has a checkpoint ten items before its end, in batches of twenty."""
    n = r.results.groupBy("session_id").agg(F.count("*").alias("n")).where("session_id % 2 = 0")
    done = F.greatest(F.col("n") - 10, F.lit(0))
    return n.select("session_id", done.alias("processed_count"), (F.floor(done / 20) * 20).alias("batch_start"))


@query(
    "x07_resume_sessions",
    """WITH p AS (SELECT session_id, greatest(count(*) - 10, 0) // 20 * 20 AS start FROM results WHERE session_id % 2 = 0 GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY image_path, item_id) - 1 AS i FROM results),
      c AS (SELECT p.session_id, count(i) AS n, count(*) FILTER (WHERE final_decision = 'approved') AS a, count(*) FILTER (WHERE final_decision = 'rejected') AS j FROM p LEFT JOIN k ON k.session_id = p.session_id AND i < start GROUP BY 1)
    SELECT id, CASE WHEN c.n IS NOT NULL THEN 'running' ELSE status END AS status, CASE WHEN c.n IS NULL THEN error_message END AS error_message, coalesce(c.n, processed_images)::BIGINT AS processed_images, coalesce(a, approved_images)::BIGINT AS approved_images, coalesce(j, rejected_images)::BIGINT AS rejected_images
    FROM sessions LEFT JOIN c ON c.session_id = id""",
)
def _(r):
    sessions, _ = L.resume_sessions(r.sessions, indexed(r), resume_points(r), "restart_batch")
    return sessions.select("id", "status", "error_message", *(F.col(c).cast("long").alias(c) for c in ("processed_images", "approved_images", "rejected_images")))


@query("x08_update_counters", "SELECT id, count(r.item_id) AS processed_images, count(*) FILTER (WHERE final_decision = 'approved') AS approved_images, count(*) FILTER (WHERE final_decision = 'rejected') AS rejected_images FROM sessions s LEFT JOIN results r ON r.session_id = s.id GROUP BY id")
def _(r):
    return L.update_counters(r.sessions, r.results).select("id", "processed_images", "approved_images", "rejected_images")


@query(
    "x09_start_sessions",
    "SELECT p.id AS project_id, coalesce(s.open_id::VARCHAR, 'new-' || substr(sha256(p.id::VARCHAR), 1, 12)) AS session_id, s.open_id IS NOT NULL AS reused, coalesce(c.n, 0)::BIGINT AS total_images FROM projects p LEFT JOIN (SELECT project_id, max(id) AS open_id FROM sessions WHERE status = 'running' GROUP BY 1) s ON s.project_id = p.id LEFT JOIN (SELECT item_id % 100 + 1 AS project_id, count(*) AS n FROM items GROUP BY 1) c ON c.project_id = p.id",
)
def _(r):
    counts = r.items.groupBy((F.col("item_id") % 100 + 1).alias("project_id")).agg(F.count("*").alias("total_images"))
    return L.start_sessions(r.projects, r.sessions, counts)


@query("x10_set_status", "SELECT id, CASE WHEN id % 2 = 0 AND status = 'running' THEN 'paused' ELSE status END AS status FROM sessions WHERE project_id % 5 <> 0")
def _(r):
    left, _ = L.delete_sessions(r.sessions, r.sessions.where("project_id % 5 = 0").select("id"), r.checkpoints)
    return L.set_status(left, "pause", F.col("id") % 2 == 0).select("id", "status")


@query(
    "x11_purge_sessions",
    f"WITH g AS (SELECT id FROM sessions WHERE status = 'completed' AND updated_at < {NOW} - INTERVAL 30 DAY) SELECT 'session' AS kind, id FROM sessions WHERE id NOT IN (FROM g) UNION ALL SELECT 'checkpoint', id FROM checkpoints WHERE session_id NOT IN (FROM g)",
)
def _(r):
    s, c = L.purge_sessions(r.sessions, r.checkpoints, now=F.lit("1999-01-01 00:00:00").cast("timestamp"), days=30)
    return s.select(F.lit("session").alias("kind"), "id").unionByName(c.select(F.lit("checkpoint").alias("kind"), "id"))


@query("x03_safe_apply", "SELECT item_id, 'half' AS function, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars // 2 END AS value, n_chars % 5 = 0 AS failed FROM (SELECT doc_id AS item_id, n_chars FROM documents) UNION ALL SELECT doc_id, 'source', len(source), false FROM documents")
def _(r):
    def half(row: dict) -> dict:
        if row["n_chars"] % 5 == 0:
            raise ValueError("divisible by five")
        return {"value": row["n_chars"] // 2}

    schema = T.StructType([T.StructField("value", T.LongType())])
    df = r.documents.select(F.col("doc_id").alias("item_id"), "n_chars", "source")
    good, bad = L.safe_apply(df, [("half", half, schema), ("source", lambda row: {"value": len(row["source"])}, schema)])
    out = bad.select("item_id", "function", F.lit(None).cast("long").alias("value"), F.lit(True).alias("failed"))
    for name, one in good.items():
        out = out.unionByName(one.select("item_id", F.lit(name).alias("function"), "value", F.lit(False).alias("failed")))
    return out
