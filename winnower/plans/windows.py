"""Queries of ranks and running values (W-01 to W-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnower.operators import metric as M
from winnower.operators import windows as O
from winnower.plans.registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
KIND = "CASE WHEN cluster_id = 0 THEN 'singleton' WHEN cluster_id % 2 = 0 THEN 'duplicate' ELSE 'similar' END"
MEMBERS = f"SELECT i.*, c.cluster_id, {KIND} AS kind FROM items i JOIN clusters c ON c.item_id = i.item_id"


def members(r):
    c = r.clusters
    kind = F.when(F.col("cluster_id") == 0, "singleton").when(F.col("cluster_id") % 2 == 0, "duplicate").otherwise("similar")
    return r.items.join(c.withColumn("kind", kind), "item_id")


@query(
    "w01_keep_best",
    f"""SELECT item_id, cluster_id, CASE WHEN kind = 'singleton' OR row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN kind = 'similar' THEN file_size + 0.001e0 * width * height ELSE 0.0e0 END DESC, image_path) = 1 THEN 'keep' ELSE 'remove' END AS action FROM ({MEMBERS})""",
)
def _(r):
    groups = members(r)
    alone = groups.where("kind = 'singleton'").select("item_id", "cluster_id", F.lit("keep").alias("action"))  # not a group: no window over all of them
    return O.keep_best(groups.where("kind <> 'singleton'")).select("item_id", "cluster_id", "action").unionByName(alone)


@query(
    "w02_keep_best_scored",
    """WITH m AS (SELECT v.label::BIGINT AS cluster_id, v.vec_id AS item_id, i.filename, i.file_size, i.width, i.height, v.embedding FROM embeddings v JOIN items i ON i.item_id = v.vec_id),
      x AS (SELECT cluster_id, item_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM m), c AS (SELECT cluster_id, k, avg(x) AS c FROM x GROUP BY ALL),
      g AS (SELECT item_id, sqrt(sum((x - c) * (x - c))) AS gap FROM x JOIN c USING (cluster_id, k) GROUP BY item_id),
      s AS (SELECT cluster_id, item_id, round(0.2 * least(file_size / 1048576.0e0, 10.0e0) + 0.3 * least(width * height / 1000000.0e0, 50.0e0) - CASE WHEN regexp_matches(lower(filename), 'copy|duplicate|\\(1\\)') THEN 2 ELSE 0 END
        + CASE WHEN count(*) OVER (PARTITION BY cluster_id) >= 2 THEN 0.5 * (1 - least(gap, 1.0e0)) ELSE 0.0e0 END, 9) AS score FROM m JOIN g USING (item_id))
    SELECT cluster_id, item_id, score, CASE WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, item_id) = 1 THEN 'keep' ELSE 'remove' END AS action FROM s""",
    "score",
)
def _(r):
    v = r.embeddings.select(F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("cluster_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return O.keep_best_scored(v.select("item_id", "cluster_id").join(r.items, "item_id"), v)


PAIRS = "SELECT a.cluster_id, a.item_id AS a, b.item_id AS b, ((a.item_id * 7 + b.item_id * 3) % 30 + 71) / 100.0e0 AS similarity FROM clusters a JOIN clusters b ON a.cluster_id = b.cluster_id AND a.cluster_id <> 0 AND a.item_id < b.item_id"


def pairs(r):
    from winnower.operators.results import cluster_pairs

    return cluster_pairs(r.clusters).withColumn("similarity", ((F.col("a") * 7 + F.col("b") * 3) % 30 + 71) / 100.0)


@query(
    "w03_keep_medoid",
    f"""WITH p AS ({PAIRS}), b AS (SELECT cluster_id, a AS item_id, similarity FROM p UNION ALL SELECT cluster_id, b, similarity FROM p),
      m AS (SELECT cluster_id, item_id, round(avg(similarity), 9) AS mean, max(similarity) AS most FROM b GROUP BY ALL)
    SELECT cluster_id, m.item_id, mean, CASE WHEN max(most) OVER w <= 0.90e0 THEN 'review' WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, file_size DESC, m.item_id) = 1 THEN 'keep' WHEN max(most) OVER w > 0.95e0 THEN 'remove' ELSE 'review' END AS action
    FROM m JOIN items i ON i.item_id = m.item_id WINDOW w AS (PARTITION BY cluster_id)""",
    "mean",
)
def _(r):
    return O.keep_medoid(pairs(r), r.items.select("item_id", "file_size"))


@query(
    "w03_vector_medoid",
    """WITH p AS (SELECT a.label::BIGINT AS cluster_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
      m AS (SELECT cluster_id, a AS item_id, round(avg(similarity), 9) AS mean, max(similarity) AS most FROM p GROUP BY ALL)
    SELECT cluster_id, m.item_id, mean, CASE WHEN max(most) OVER w <= 0.2e0 THEN 'review' WHEN row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, file_size DESC, m.item_id) = 1 THEN 'keep' WHEN max(most) OVER w > 0.4e0 THEN 'remove' ELSE 'review' END AS action
    FROM m JOIN items i ON i.item_id = m.item_id WINDOW w AS (PARTITION BY cluster_id)""",
    "mean",
)
def _(r):
    v = r.embeddings.select("vec_id", "embedding", F.col("label").cast("long").alias("cluster_id"))
    means = M.mean_cosines(v)[1].where("mean is not null")
    return O.keep_medoid_of_means(means, M.cluster_cosines(v).select("cluster_id", F.col("max").alias("most")), r.items.select("item_id", "file_size"), 0.4, 0.2)


@query("w04_prune_checkpoints", "SELECT id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS k FROM checkpoints) WHERE k > 5")
def _(r):
    return O.prune_checkpoints(r.checkpoints).select("id", "session_id")


APPROVED = "SELECT i.* FROM items i JOIN results r ON r.item_id = i.item_id WHERE r.final_decision <> 'rejected'"


def approved(r):
    """Only the columns that order and folders need: ranked rows are written to storage in between."""
    return r.items.select("item_id", "image_path", "source_folder").join(r.results.where("final_decision <> 'rejected'").select("item_id"), "item_id", "left_semi")


@query("w05_assign_folders", f"SELECT item_id, ((row_number() OVER (ORDER BY image_path, item_id) - 1) // 200 + 1)::BIGINT AS folder FROM ({APPROVED})")
def _(r):
    return O.assign_folders(approved(r)).select("item_id", "folder")


@query("w06_assign_subfolders", f"SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY source_folder) <= 20 THEN source_folder ELSE format('{{}}_batch_{{:03d}}', source_folder, ((row_number() OVER (PARTITION BY source_folder ORDER BY image_path, item_id) - 1) // 20 + 1)::INT) END AS folder FROM ({APPROVED})")
def _(r):
    return O.assign_subfolders(approved(r), 20).select("item_id", "folder")


@query("w07_resolve_names", "SELECT item_id, CASE WHEN k = 0 THEN filename ELSE replace(filename, '.jpg', '_' || k || '.jpg') END AS new_name FROM (SELECT item_id, filename, row_number() OVER (PARTITION BY filename ORDER BY item_id) - 1 AS k FROM items)")
def _(r):
    return O.resolve_names(r.items.select("item_id", "filename", F.lit("out").alias("folder"))).select("item_id", "new_name")


@query(
    "w08_running_totals",
    """SELECT event_id, processed, approved::BIGINT AS approved, rejected::BIGINT AS rejected, 100.0e0 * processed / n AS percentage, approved::DOUBLE / processed AS approve_rate FROM (SELECT event_id, count(*) OVER w AS processed, sum(CASE WHEN decision = 'approved' THEN 1 ELSE 0 END) OVER w::BIGINT AS approved,
      sum(CASE WHEN decision = 'rejected' THEN 1 ELSE 0 END) OVER w::BIGINT AS rejected, count(*) OVER (PARTITION BY session_id) AS n FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""".replace("OVER w::BIGINT", "OVER w"),
    "percentage approve_rate",
)
def _(r):
    return O.running_totals(r.progress).select("event_id", "processed", "approved", "rejected", "percentage", "approve_rate")


@query(
    "w09_moving_speed",
    """WITH d AS (SELECT *, row_number() OVER w AS processed, count(*) OVER (PARTITION BY session_id) AS n, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
      s AS (SELECT *, avg(1 / dt) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS speed FROM d WHERE dt > 0)
    SELECT event_id, session_id, speed, (n - processed) / speed AS eta FROM s""",
    "speed eta",
)
def _(r):
    return O.moving_speed(r.progress).select("event_id", "session_id", "speed", "eta")


@query(
    "w10_milestones",
    """WITH p AS (SELECT session_id, event_id, ts, row_number() OVER w AS k, count(*) OVER (PARTITION BY session_id) AS n, floor((floor(epoch(ts)) - floor(epoch(min(ts) OVER (PARTITION BY session_id)))) / 3600)::BIGINT AS h FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
      m AS (SELECT *, 'percent_' || x AS milestone FROM p, (SELECT unnest([25, 50, 75, 90]) AS x) WHERE k * 100 >= n * x UNION ALL SELECT *, 'count_' || x FROM p, (SELECT unnest([100, 500, 1000, 5000, 10000, 25000]) AS x) WHERE k >= x
        UNION ALL SELECT a.*, x, 'hour_' || x FROM p a, (SELECT unnest(range(1, 2000)) AS x) WHERE a.h >= x)
    SELECT session_id, milestone, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, milestone ORDER BY k) AS j FROM m) WHERE j = 1 GROUP BY ALL""",
)
def _(r):
    return O.milestones(r.progress).select("session_id", "milestone", "event_id")


@query("w11_last_n", "SELECT event_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS k FROM metrics) WHERE k <= 50")
def _(r):
    return O.last_n(r.metrics, 50).select("event_id", "session_id")


@query("w12_batch_index", 'SELECT item_id, (i // 64)::BIGINT AS batch, (i % 64)::BIGINT AS "offset" FROM (SELECT item_id, row_number() OVER (ORDER BY image_path, item_id) - 1 AS i FROM items)')
def _(r):
    return O.batch_index(r.items.select("item_id", "image_path"), 64).select("item_id", "batch", "offset")


@query(
    "w13_current_counters",
    f"""SELECT session_id, count(*) AS processed, count(*) / (epoch({NOW}) - floor(epoch(min(ts)))) AS rate, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(event_type, (ts, event_id)) AS last_type FROM progress GROUP BY session_id""",
    "rate",
)
def _(r):
    return O.current_counters(r.progress, F.lit("2024-01-31 00:00:00").cast("timestamp"))
