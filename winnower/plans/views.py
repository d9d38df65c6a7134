"""The role that each given table plays: items, quality measures, detections, results, sessions and so on.

A view is one SELECT in the SQL that Spark and DuckDB share, so that a query and its check start from the
same rows. In Spark a view reads Parquet directly; column pruning and filters reach the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "items": """
        SELECT doc_id AS item_id, source AS source_folder, concat('/in/', source, '/', doc_id, '.jpg') AS image_path,
          concat('img_', doc_id % 300, '.jpg') AS filename, n_chars * 1024 AS file_size,
          CAST(1280 + 320 * (doc_id % 7) AS INT) AS width, CAST(720 + 180 * (doc_id % 7) AS INT) AS height FROM documents""",
    "quality": """
        SELECT doc_id AS item_id, CAST(n_chars % 401 AS DOUBLE) AS sharpness, CAST(7 * doc_id % 20 AS DOUBLE) / 100 AS noise,
          CAST(13 * doc_id % 101 AS DOUBLE) / 100 AS brightness, CAST(17 * doc_id % 51 AS DOUBLE) / 100 AS contrast,
          CAST(doc_id % 9 AS DOUBLE) / 100 AS over_pct, CAST(doc_id % 7 AS DOUBLE) / 100 AS under_pct,
          CAST(29 * doc_id % 101 AS DOUBLE) / 100 AS color_balance, CAST(1280 + 320 * (doc_id % 7) AS INT) AS width,
          CAST(720 + 180 * (doc_id % 7) AS INT) AS height, n_chars * 1024 AS file_size FROM documents""",
    "detections": """
        SELECT l_orderkey AS item_id, l_linenumber AS n, CAST(l_discount * 10 AS DOUBLE) AS confidence, l_quantity AS quantity,
          CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'crack' WHEN 'NF' THEN 'scratch' WHEN 'NO' THEN 'stain' WHEN 'RF' THEN 'damage' ELSE 'blur' END AS defect_type,
          CASE WHEN l_linenumber % 3 = 0 THEN 'person' WHEN l_linenumber % 3 = 1 THEN 'text' ELSE 'bottle' END AS object_type FROM lineitem""",
    "contours": """
        SELECT l_orderkey AS item_id, l_linenumber AS n, CAST(l_extendedprice / 10 AS DOUBLE) AS area, CAST(4 * l_quantity AS DOUBLE) AS perimeter,
          CAST(1 + l_quantity / 5 AS DOUBLE) AS aspect, CAST(1 - l_tax * 10 AS DOUBLE) AS solidity FROM lineitem""",
    "defects": """
        SELECT item_id, count(*) AS n, least(1.0e0, count(*) * avg(confidence) / 10) AS anomaly, sum(CASE WHEN confidence > 0.5e0 THEN 1 ELSE 0 END) AS high
        FROM detections GROUP BY item_id""",
    "marks": "SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id",
    "copies": "SELECT copy_digest, min(doc_id) AS first_id, count(*) AS n_copies FROM (SELECT doc_id, md5(text) AS copy_digest FROM documents) t GROUP BY copy_digest",
    "scored": """
        SELECT d.doc_id AS item_id, d.doc_id % 8 AS session_id, i.image_path, i.filename, i.source_folder, q.sharpness, q.noise, q.color_balance, q.brightness,
          0.3e0 * least(1.0e0, q.sharpness / 200) + 0.2e0 * greatest(0.0e0, 1 - 10 * q.noise) + 0.25e0 * q.brightness + 0.15e0 * q.color_balance
            + 0.1e0 * least(1.0e0, CAST(q.width AS DOUBLE) * q.height / 2073600) AS overall,
          coalesce(f.anomaly, 0.0e0) AS anomaly, coalesce(f.n, 0) AS defect_count,
          CASE WHEN c.n_copies > 1 THEN c.first_id + 1 ELSE 0 END AS similarity_group,
          CASE WHEN m.toxic = 1 THEN 1 ELSE 0 END AS privacy_count, CASE WHEN m.quality = 0 THEN 2 ELSE 0 END AS issue_count,
          CASE WHEN m.toxic = 1 OR m.quality = 0 THEN greatest(0.0e0, 1 - 0.4e0 * (CASE WHEN m.toxic = 1 THEN 1 ELSE 0 END) - 0.1e0 * (CASE WHEN m.quality = 0 THEN 2 ELSE 0 END)) ELSE 1.0e0 END AS compliance,
          i.width, i.height, i.file_size, e.ts AS created_at, e.value / 100 AS processing_time, e.event_type = 'signup' AS human_override
        FROM (SELECT doc_id, md5(text) AS digest FROM documents) d JOIN items i ON i.item_id = d.doc_id JOIN quality q ON q.item_id = d.doc_id LEFT JOIN defects f ON f.item_id = d.doc_id
          LEFT JOIN marks m ON m.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN copies c ON c.copy_digest = d.digest""",
    "results": """
        SELECT item_id, session_id, image_path, filename, source_folder, sharpness, noise, color_balance, brightness, overall, anomaly, defect_count, similarity_group,
          privacy_count, issue_count, compliance, width, height, file_size, created_at, processing_time, human_override,
          CASE WHEN overall < 0.3e0 OR anomaly > 0.7e0 OR compliance < 0.5e0 THEN 'rejected' WHEN weighted >= 0.75e0 AND n_reasons = 0 THEN 'approved'
            WHEN weighted <= 0.4e0 OR n_reasons >= 3 THEN 'rejected' WHEN item_id % 17 = 0 THEN 'pending' ELSE 'review_required' END AS final_decision,
          concat_ws(',', CASE WHEN overall < 0.6e0 THEN 'low_quality' END, CASE WHEN anomaly > 0.3e0 THEN 'defects_detected' END,
            CASE WHEN similarity_group > 0 THEN 'similar_images' END, CASE WHEN privacy_count > 0 THEN 'privacy_violation' END, CASE WHEN issue_count > 0 THEN 'metadata_issues' END) AS reasons,
          weighted, CASE WHEN human_override THEN created_at END AS human_review_at
        FROM (
          SELECT s.*, 0.35e0 * overall + 0.25e0 * greatest(0.0e0, 1 - anomaly) + 0.2e0 * (CASE WHEN similarity_group > 0 THEN 0.5e0 ELSE 1.0e0 END) + 0.15e0 * compliance + 0.05e0 AS weighted,
            (CASE WHEN overall < 0.6e0 THEN 1 ELSE 0 END) + (CASE WHEN anomaly > 0.3e0 THEN 1 ELSE 0 END) + (CASE WHEN compliance < 0.8e0 THEN 1 ELSE 0 END) AS n_reasons
          FROM scored s) w""",
    "projects": "SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'completed' ELSE 'idle' END AS status, c_acctbal AS budget FROM customer",
    "session_lines": """
        SELECT l_orderkey AS session_id, count(*) AS total_images, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS processed_images,
          sum(CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 1 ELSE 0 END) AS approved_images, sum(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS rejected_images
        FROM lineitem GROUP BY l_orderkey""",
    "sessions": """
        SELECT o.o_orderkey AS id, o.o_custkey AS project_id, CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'paused' END AS status,
          coalesce(l.total_images, 0) AS total_images, coalesce(l.processed_images, 0) AS processed_images, coalesce(l.approved_images, 0) AS approved_images,
          coalesce(l.rejected_images, 0) AS rejected_images, o.o_orderdate AS updated_at, o.o_orderdate AS created_at,
          CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Out of memory' WHEN '2-HIGH' THEN 'connection reset' WHEN '3-MEDIUM' THEN 'unhandled exception' END AS error_message,
          concat('/in/', o.o_custkey % 5) AS input_folder, concat('/out/', o.o_custkey % 3) AS output_folder
        FROM orders o LEFT JOIN session_lines l ON l.session_id = o.o_orderkey""",
    "progress": """
        SELECT event_id, user_id AS session_id, ts, event_type, value, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'rejected' END AS decision FROM events""",
    "metrics": "SELECT event_id, user_id AS session_id, ts, value AS memory_mb, value / 2 AS gpu_mb, value / 100 AS batch_seconds FROM events",
    "errors": """
        SELECT event_id, ts, user_id AS session_id, CASE event_id % 8 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'MemoryError' WHEN 2 THEN 'FileNotFoundError' WHEN 3 THEN 'ValueError' WHEN 4 THEN 'PermissionError'
            WHEN 5 THEN 'TimeoutError' WHEN 6 THEN 'SystemError' ELSE 'CustomError' END AS exception_type,
          concat('message ', event_id % 5) AS message, CASE WHEN event_id % 3 = 0 THEN 'config_loader' WHEN event_id % 3 = 1 THEN 'quality' END AS component,
          event_id % 2 = 0 AS resolved, event_id % 4 AS retry_count FROM events WHERE event_type = 'error'""",
    "checkpoints": """
        SELECT event_id AS id, user_id AS session_id, ts AS created_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS BIGINT) AS processed_count,
          CASE WHEN event_id % 30 = 0 THEN 'emergency' ELSE 'automatic' END AS checkpoint_type, event_id % 7 AS error_count, value AS memory_mb
        FROM events""",
    "hashes": """
        SELECT doc_id AS item_id, concat(substr(md5(text), 1, 12), substr(md5(concat('', doc_id)), 1, 4)) AS phash, substr(md5(concat(text, doc_id)), 1, 16) AS dhash,
          substr(md5(text), 1, 16) AS ahash FROM documents""",
    "clusters": """
        SELECT d.doc_id AS item_id, CASE WHEN c.n_copies > 1 THEN c.first_id + 1 ELSE 0 END AS cluster_id FROM (SELECT doc_id, md5(text) AS digest FROM documents) d JOIN copies c ON c.copy_digest = d.digest""",
}
_NAMES = list(VIEWS)


def _used(sql: str) -> list[str]:
    """Views that ``sql`` needs, those first that others need."""
    words = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", sql))
    out: list[str] = []
    for name in _NAMES:
        if name in words:
            out += [x for x in [*_used(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """``sql`` with the views that it names defined in front."""
    used = _used(sql)
    if not used:
        return sql
    head, body = ("WITH RECURSIVE ", re.sub(r"^\s*WITH (RECURSIVE )?", "", sql)) if re.match(r"\s*WITH ", sql) else ("WITH ", sql)
    return head + ", ".join(f"{v} AS ({VIEWS[v]})" for v in used) + (", " if head != "WITH " else " ") + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a given table as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_views(f"SELECT * FROM {name}")
    return spark.sql(re.sub(rf"(FROM|JOIN)\s+({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))
