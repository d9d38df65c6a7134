"""Queries of the streams (T-01 to T-09), each run over the events to the end and compared with its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnower.functions.durable import checkpoint_root
from winnower.plans.registry import Roles, query
from winnower.plans.rules import ERRORS
from winnower.sources.files import load_results
from winnower.streaming import streams as T


def _events(r: Roles) -> DataFrame:
    """The events table as a stream of progress events."""
    path = f"{r.sf_dir}/events.parquet"
    raw = r.spark.readStream.schema(r.spark.read.parquet(path).schema).parquet(f"{r.sf_dir}/events*.parquet")  # a pattern, since a stream has no single file as its source
    decision = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "view", "rejected").otherwise("none")
    return raw.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", decision.alias("decision"))


def _run(r: Roles, stream: DataFrame, mode: str) -> DataFrame:
    """All rows the stream gave, with their batch."""
    base = f"{checkpoint_root(r.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    T.write_batches(stream, f"{base}/out", f"{base}/state", mode)
    return r.spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{base}/out")


def _last(df: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


@query(
    "t01_progress_stream",
    """WITH d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)), s AS (SELECT session_id, dt, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS k FROM d WHERE dt > 0),
      v AS (SELECT session_id, avg(1 / dt) AS speed FROM s WHERE k <= 10 GROUP BY 1)
    SELECT session_id, count(*) AS processed, count(*) FILTER (WHERE decision = 'approved') AS approved, count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) + 10 AS total, 100.0e0 * count(*) / (count(*) + 10) AS percentage, coalesce(max(speed), 0) AS speed, 10 / max(speed) AS eta, 'processing' AS stage,
      arg_max(event_id, (ts, event_id)) AS last_event FROM progress LEFT JOIN v USING (session_id) GROUP BY session_id""",
    "percentage speed eta",
)
def _(r):
    totals = r.events.groupBy(F.col("user_id").alias("session_id")).agg((F.count("*") + 10).alias("total"))
    return _last(_run(r, T.progress_stream(_events(r).join(totals, "session_id")), "update"), "session_id")


@query(
    "t02_milestone_stream",
    """WITH p AS (SELECT session_id, event_id, ts, row_number() OVER w AS k, count(*) OVER (PARTITION BY session_id) AS n, floor((floor(epoch(ts)) - floor(epoch(min(ts) OVER (PARTITION BY session_id)))) / 3600)::BIGINT AS h FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
      m AS (SELECT *, 'percent_' || x AS milestone FROM p, (SELECT unnest([25, 50, 75, 90]) AS x) WHERE k * 100 >= n * x UNION ALL SELECT *, 'count_' || x FROM p, (SELECT unnest([100, 500, 1000, 5000, 10000, 25000]) AS x) WHERE k >= x
        UNION ALL SELECT a.*, x, 'hour_' || x FROM p a, (SELECT unnest(range(1, 2000)) AS x) WHERE a.h >= x)
    SELECT session_id, milestone, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, milestone ORDER BY k) AS j FROM m) WHERE j = 1""",
)
def _(r):
    totals = r.events.groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("total"))
    return _run(r, T.milestone_stream(_events(r).join(totals, "session_id")), "append").drop("batch")


@query("t03_latest_progress", "SELECT session_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM progress GROUP BY 1")
def _(r):
    return _last(_run(r, T.latest_progress(_events(r)), "update"), "session_id")


@query("t04_stale_sessions", "SELECT id FROM sessions WHERE status = 'running' AND updated_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 5 MINUTE")
def _(r):
    return T.stale_sessions(r.sessions, F.lit("1998-06-01 00:00:00").cast("timestamp")).select("id")


@query(
    "t04_recoverable_sessions",
    """SELECT s.id AS session_id, s.status, c.id AS checkpoint_id, c.processed_count, CASE WHEN regexp_matches(lower(coalesce(error_message, '')), 'memory|oom') THEN 'out_of_memory' WHEN regexp_matches(lower(coalesce(error_message, '')), 'network|connection') THEN 'network_failure'
      WHEN regexp_matches(lower(coalesce(error_message, '')), 'crash|exception') THEN 'application_crash' WHEN epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(updated_at) > 3600 THEN 'power_failure' WHEN epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(updated_at) > 600 THEN 'system_crash' ELSE 'application_crash' END AS crash_type
    FROM sessions s JOIN (SELECT * FROM checkpoints QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) = 1) c ON c.session_id = s.id WHERE s.status IN ('running', 'created') AND updated_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 5 MINUTE""",
)
def _(r):
    return T.recoverable_sessions(r.sessions, r.checkpoints, F.lit("1998-06-01 00:00:00").cast("timestamp"))


@query(
    "t04_activity_windows",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS fresh FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS k FROM g)
    SELECT session_id, count(*) AS n FROM s GROUP BY session_id, k""",
)
def _(r):
    return T.activity_windows(r.progress, 300).select("session_id", "n")


@query("t05_hourly_stream", "SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE decision = 'approved') AS approved, count(*) FILTER (WHERE decision = 'rejected') AS rejected, count(*) FILTER (WHERE decision IS NOT NULL) AS value FROM progress GROUP BY 1")
def _(r):
    df = _last(_run(r, T.hourly_stream(_events(r)), "complete"), "hour")
    return df.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("t06_error_stream", f"SELECT date_trunc('day', ts)::TIMESTAMP AS \"begin\", category, severity, count(*) AS n FROM ({ERRORS}) GROUP BY ALL")
def _(r):
    i = F.col("event_id")
    kinds = ["ConnectionError", "MemoryError", "FileNotFoundError", "ValueError", "PermissionError", "TimeoutError", "SystemError", "CustomError"]
    kind, part = F.element_at(F.array(*map(F.lit, kinds)), (i % 8 + 1).cast("int")), F.when(i % 3 == 0, "config_loader").when(i % 3 == 1, "quality")
    errors = _events(r).where("event_type = 'error'").select("ts", kind.alias("exception_type"), part.alias("component"))
    df = _last(_run(r, T.error_stream(errors), "complete"), "begin", "category", "severity")
    return df.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query(
    "t07_checkpoint_stream",
    """SELECT session_id, event_id, k AS processed, e::BIGINT AS errors, false AS forced, 'automatic' AS checkpoint_type, CASE WHEN k >= 20 THEN 'fresh_start,continue,restart_batch' ELSE 'fresh_start,continue' END AS options,
      sha256(concat('{"checkpoint_type":"automatic","errors":', e, ',"processed":', k, ',"session_id":', session_id, '}')) AS state_hash
    FROM (SELECT *, row_number() OVER w AS k, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS e FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE k % 10 = 0""",
)
def _(r):
    rows = T.checkpoint_stream(_events(r))
    return _run(r, rows.withColumn("options", F.array_join("options", ",")), "append").drop("batch")


@query(
    "t08_completion_stream",
    """WITH g AS (SELECT *, coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM progress)
    SELECT session_id, event_id, processed, approved::BIGINT AS approved, approved / processed AS approve_rate, elapsed, CASE WHEN elapsed = 0 THEN 0.0e0 ELSE processed / elapsed END AS speed FROM (SELECT *, count(*) OVER w AS processed, sum((coalesce(decision, '') = 'approved')::INT) OVER w AS approved, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 AS elapsed
      FROM g WINDOW w AS (PARTITION BY session_id, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'signup'""",
    "approve_rate elapsed speed",
)
def _(r):
    return _run(r, T.completion_stream(_events(r), T.Life(done="signup")), "append").drop("batch")


@query("t04_stale_stream", "SELECT session_id, arg_max(event_id, (ts, event_id)) AS event_id FROM progress GROUP BY 1 HAVING epoch_ms(max(ts)) + 300000 < (SELECT epoch_ms(max(ts)) FROM progress)")
def _(r):
    return _run(r, T.stale_stream(_events(r)), "append").select("session_id", "event_id")


@query("t09_ingest_results", "SELECT DISTINCT session_id, concat('/in/', event_id % 20, '.jpg') AS image_path FROM progress")
def _(r):
    events = _events(r).withColumn("image_path", F.concat(F.lit("/in/"), F.col("event_id") % 20, F.lit(".jpg")))
    base = f"{checkpoint_root(r.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    T.ingest_batches(T.ingest_results(events, "60 days"), f"{base}/out", f"{base}/state")
    return load_results(r.spark, f"{base}/out").select(F.col("session_id").cast("long").alias("session_id"), "image_path")
