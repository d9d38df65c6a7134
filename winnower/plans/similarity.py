"""Queries of similarity and grouping (SIM-01 to SIM-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnower.operators import metric as M
from winnower.operators import similarity as S
from winnower.plans.registry import query
from winnower.plans.windows import PAIRS, members, pairs

DIFF = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN substr({0}, i, 1) <> substr({1}, i, 1) THEN 1 ELSE 0 END))"


@query("sim02_hash_distance", f"SELECT item_id, {DIFF.format('phash', 'dhash')}::DOUBLE AS digits, bit_count(xor(('0x' || phash)::UBIGINT, ('0x' || dhash)::UBIGINT))::DOUBLE AS bits FROM hashes", "digits bits")
def _(r):
    return r.hashes.select("item_id", S.hash_distance("phash", "dhash").alias("digits"), S.hash_distance("phash", "dhash", bits=True).alias("bits"))


@query("sim03_cosine", "SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "cosine")
def _(r):
    e = r.embeddings.select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", S.cosine("embedding", "other").alias("cosine"))


@query(
    "sim04_standard_scale",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), s AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY k)
    SELECT vec_id, sum(abs((x - m) / s)) AS size, max((x - m) / s) AS top FROM x JOIN s USING (k) GROUP BY vec_id""",
    "size top",
)
def _(r):
    v = S.standard_scale(r.embeddings.select("vec_id", "embedding"))
    return v.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("size"), F.array_max("embedding").alias("top"))


@query("sim04_fuse", "SELECT vec_id, len(embedding)::INT * 2 AS dims, 1.0e0 * 0.49 + 0.09 AS norm2 FROM embeddings", "norm2")
def _(r):
    v = r.embeddings.select("vec_id", S.fuse("embedding", F.reverse("embedding")).alias("v"))
    return v.select("vec_id", F.size("v").alias("dims"), S.dot(F.col("v"), F.col("v")).alias("norm2"))


HASH_PAIRS = f"SELECT * FROM (SELECT a.item_id AS a, b.item_id AS b, least({', '.join(DIFF.format(f'a.{k}', f'b.{k}') for k in ('phash', 'dhash', 'ahash'))})::DOUBLE AS distance FROM hashes a JOIN hashes b ON a.item_id < b.item_id) WHERE distance <= 5"


@query("sim05_hash_pairs", HASH_PAIRS, "distance")
def _(r):
    return S.hash_pairs(r.hashes)


@query(
    "sim05_hash_links",
    f"""WITH e AS (SELECT item_id, unnest(['p', 'd', 'a']) AS kind, unnest([phash, dhash, ahash]) AS h FROM hashes), c AS (SELECT kind, h, min(item_id) AS node FROM e GROUP BY ALL),
      n AS (SELECT least(a.node, b.node) AS a, greatest(a.node, b.node) AS b, {DIFF.format('a.h', 'b.h')}::DOUBLE AS d FROM c a JOIN c b ON a.kind = b.kind AND a.h < b.h)
    SELECT a, b, min(d) AS distance FROM (SELECT * FROM n WHERE d <= 5 UNION ALL SELECT node, item_id, 0.0e0 FROM e JOIN c USING (kind, h) WHERE item_id <> node) GROUP BY a, b""",
    "distance",
)
def _(r):
    return S.hash_links(r.hashes)


#: Pairs of distinct vectors by the least id of each, and each further item of a vector with its least id.
COS_PAIRS = """WITH u AS (SELECT embedding AS e, min(vec_id) AS i FROM embeddings GROUP BY 1), p AS (SELECT least(a.i, b.i) AS a, greatest(a.i, b.i) AS b, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS cosine FROM u a JOIN u b ON a.i < b.i)
    SELECT a, b, cosine FROM p WHERE cosine >= {0} UNION ALL SELECT i, vec_id, 1.0e0 FROM embeddings JOIN u ON e = embedding WHERE vec_id <> i"""


def cos_pairs(r, least: float):
    return M.cosine_pairs(r.embeddings, least)


@query("sim06_cosine_pairs", COS_PAIRS.format(0.3), "cosine")
def _(r):
    return cos_pairs(r, 0.3)


@query("sim07_similarity_level", f"SELECT a, b, CASE WHEN similarity >= 0.95 THEN 'identical' WHEN similarity >= 0.9 THEN 'near_duplicate' WHEN similarity >= 0.75 THEN 'similar' ELSE 'somewhat_similar' END AS level FROM ({PAIRS})")
def _(r):
    return pairs(r).select("a", "b", S.similarity_level("similarity").alias("level"))


@query(
    "sim08_dbscan",
    f"""WITH RECURSIVE p AS ({COS_PAIRS.format(0.35)}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), core AS (SELECT a FROM e GROUP BY a HAVING count(*) + 1 >= 3), ce AS (SELECT a, b FROM e WHERE a IN (FROM core) AND b IN (FROM core)),
      r(i, m) AS (SELECT a, a FROM core UNION SELECT r.i, ce.b FROM r JOIN ce ON ce.a = r.m), l AS (SELECT i, min(m) AS c FROM r GROUP BY i),
      bd AS (SELECT e.a AS i, arg_min(l.c, e.b) AS c FROM e JOIN l ON l.i = e.b WHERE e.a NOT IN (FROM core) GROUP BY e.a)
    SELECT vec_id AS item_id, coalesce(l.c + 1, bd.c + 1, 0)::BIGINT AS cluster_id FROM embeddings LEFT JOIN l ON l.i = vec_id LEFT JOIN bd ON bd.i = vec_id""",
)
def _(r):
    return M.density_clusters(r.embeddings, 0.35, 3)


@query(
    "sim09_connected_components",
    f"WITH RECURSIVE p AS ({COS_PAIRS.format(0.38)}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(i, m) AS (SELECT a, a FROM e UNION SELECT r.i, e.b FROM r JOIN e ON e.a = r.m) SELECT i AS item_id, min(m) AS component FROM r GROUP BY i",
)
def _(r):
    return S.connected_components(cos_pairs(r, 0.38))


@query(
    "sim10_leader_groups",
    f"""WITH RECURSIVE p AS ({COS_PAIRS.format(0.35)}), n AS (SELECT b, list(a) AS low FROM p GROUP BY b), o AS (SELECT vec_id AS i, row_number() OVER (ORDER BY vec_id) AS k, coalesce(low, []) AS low FROM embeddings LEFT JOIN n ON n.b = vec_id),
      r(k, leads) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN len(list_intersect(o.low, r.leads)) > 0 THEN r.leads ELSE list_append(r.leads, o.i) END FROM r JOIN o ON o.k = r.k + 1), f AS (SELECT leads FROM r ORDER BY k DESC LIMIT 1)
    SELECT o.i AS item_id, coalesce(list_min(list_intersect(o.low, f.leads)), o.i) AS leader FROM o, f""",
)
def _(r):
    return M.cosine_leaders(r.embeddings, 0.35)


GRADED = f"SELECT *, ((a + b) % 7)::DOUBLE AS distance FROM ({PAIRS})"


@query("sim11_classify_groups", f"SELECT cluster_id, avg(distance) AS distance, avg(similarity) AS cosine, CASE WHEN avg(distance) < 3 OR avg(similarity) > 0.95e0 THEN 'duplicate' ELSE 'similar' END AS kind FROM ({GRADED}) GROUP BY cluster_id", "distance cosine")
def _(r):
    return S.classify_groups(pairs(r).withColumns({"distance": ((F.col("a") + F.col("b")) % 7).cast("double"), "cosine": F.col("similarity")}))


@query(
    "sim12_recommend",
    f"""WITH g AS ({GRADED}), b AS (SELECT a, b, distance, similarity FROM g UNION ALL SELECT b, a, distance, similarity FROM g), p AS (SELECT a, bool_or(distance < 3 OR similarity > 0.95e0) AS same, bool_or(distance <= 5 OR similarity >= 0.85e0) AS near, string_agg(b, ',' ORDER BY b) FILTER (WHERE distance <= 5 OR similarity >= 0.85e0) AS ids FROM b GROUP BY a)
    SELECT item_id, CASE WHEN same THEN 'remove' WHEN near THEN 'review' ELSE 'keep' END AS action, coalesce(ids, '') AS similar FROM items LEFT JOIN p ON p.a = item_id""",
)
def _(r):
    p = pairs(r).select("a", "b", ((F.col("a") + F.col("b")) % 7).cast("double").alias("distance"), F.col("similarity").alias("cosine"))
    df = S.recommend(r.items, p)
    return df.withColumn("similar", F.array_join(F.col("similar").cast("array<string>"), ","))


@query(
    "sim13_group_actions",
    "SELECT item_id, CASE WHEN kind = 'singleton' OR row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN kind = 'similar' THEN file_size + 0.001e0 * width * height ELSE 0.0e0 END DESC, image_path) = 1 THEN 'keep' ELSE 'remove' END AS action FROM (SELECT i.*, c.cluster_id, CASE WHEN cluster_id = 0 THEN 'singleton' WHEN cluster_id % 2 = 0 THEN 'duplicate' ELSE 'similar' END AS kind FROM items i JOIN clusters c ON c.item_id = i.item_id) WHERE kind <> 'singleton'",
)
def _(r):
    from winnower.operators.windows import keep_best

    return keep_best(members(r).where("kind <> 'singleton'")).select("item_id", "action")


@query(
    "sim14_graded_actions",
    f"""WITH s AS (SELECT cluster_id, avg(similarity) AS avg FROM ({PAIRS}) GROUP BY cluster_id), m AS (SELECT c.*, count(*) OVER (PARTITION BY cluster_id) AS size, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) = 1 AS best FROM clusters c WHERE cluster_id <> 0)
    SELECT item_id, CASE WHEN size = 1 THEN 'keep_unique' WHEN avg >= 0.95 THEN CASE WHEN best THEN 'keep_best' ELSE 'remove_identical' END WHEN avg >= 0.9 THEN CASE WHEN best THEN 'keep_best' ELSE 'review_duplicate' END WHEN avg >= 0.75 THEN 'review_similar' ELSE 'keep_different' END AS action FROM m LEFT JOIN s USING (cluster_id)""",
)
def _(r):
    from pyspark.sql import Window as W

    w = W.partitionBy("cluster_id")
    avg = pairs(r).groupBy("cluster_id").agg(F.avg("similarity").alias("avg"))
    m = r.clusters.where("cluster_id <> 0").withColumns({"size": F.count("*").over(w), "best": F.row_number().over(w.orderBy("item_id")) == 1})
    return S.graded_actions(m.join(avg, "cluster_id", "left")).select("item_id", "action")


@query("sim15_cluster_quality", f"SELECT * FROM (SELECT cluster_id, c.size, CASE WHEN size = 1 THEN 1.0e0 ELSE coalesce(m, 0.5e0) END AS quality FROM (SELECT cluster_id, count(*) AS size FROM clusters WHERE cluster_id <> 0 GROUP BY 1) c LEFT JOIN (SELECT cluster_id, avg(similarity) AS m FROM ({PAIRS}) GROUP BY 1) p USING (cluster_id)) WHERE quality >= 0.85", "quality")
def _(r):
    return S.cluster_quality(r.clusters.where("cluster_id <> 0"), pairs(r).withColumnRenamed("similarity", "cosine"), 0.85)


#: All pairs of the vectors of a label, for what the vectors' sums and blocks give without them.
LABEL_PAIRS = "SELECT a.label::BIGINT AS cluster_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


def labelled(r):
    return r.embeddings.select("vec_id", "embedding", F.col("label").cast("long").alias("cluster_id"))


@query("sim11_classify_vectors", f"SELECT cluster_id, NULL::DOUBLE AS distance, avg(cosine) AS cosine, CASE WHEN avg(cosine) > 0.95e0 THEN 'duplicate' ELSE 'similar' END AS kind FROM ({LABEL_PAIRS}) GROUP BY cluster_id", "distance cosine")
def _(r):
    means = M.mean_cosines(labelled(r))[0].where("avg is not null")
    return S.classify_means(means.select("cluster_id", F.lit(None).cast("double").alias("distance"), F.col("avg").alias("cosine")))


@query("sim15_vector_quality", f"SELECT * FROM (SELECT label::BIGINT AS cluster_id, count(*) AS size, CASE WHEN count(*) = 1 THEN 1.0e0 ELSE coalesce(any_value(m), 0.5e0) END AS quality FROM embeddings LEFT JOIN (SELECT cluster_id, avg(cosine) AS m FROM ({LABEL_PAIRS}) GROUP BY 1) ON cluster_id = label GROUP BY 1) WHERE quality >= -0.1", "quality")
def _(r):
    means = M.mean_cosines(labelled(r))[0].select("cluster_id", F.col("avg").alias("mean"))
    return S.quality_of_means(labelled(r), means, -0.1)


@query(
    "sim16_threshold_config",
    f"""SELECT preset, level, count(*) AS n FROM (SELECT preset, CASE WHEN similarity >= i THEN 'identical' WHEN similarity >= d THEN 'near_duplicate' WHEN similarity >= s THEN 'similar' ELSE 'somewhat_similar' END AS level
      FROM ({PAIRS}), (VALUES ('strict', 0.98, 0.95, 0.85), ('balanced', 0.95, 0.90, 0.8), ('lenient', 0.90, 0.85, 0.70)) t(preset, i, d, s)) GROUP BY ALL""",
)
def _(r):
    p, out = pairs(r).select("similarity"), None
    for preset in S.PRESETS:
        t = S.threshold_config(preset, {"similar": 0.8, "identical": 7, "min_cluster_size": 3} if preset == "balanced" else None)
        one = p.select(F.lit(preset).alias("preset"), S.similarity_level("similarity", t).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("preset", "level").agg(F.count("*").alias("n"))
