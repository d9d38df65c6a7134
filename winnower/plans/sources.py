"""Queries of digests, manifests, exports and raster metrics over the given tables (S, R, SIM-01)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from winnower.functions.durable import checkpoint_root, settle
from winnower.operators import windows as W
from winnower.operators.similarity import perceptual_hashes
from winnower.plans.registry import query
from winnower.plans.results import results
from winnower.sources import files as S
from winnower.sources import raster as R
from winnower.sources.image_files import encode_png, write_image_files


@query("s04_content_digest", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def _(r):
    return r.documents.select("doc_id", S.content_digest("text", "md5").alias("md5"), S.content_digest("text").alias("sha256"))


@query(
    "s05_manifest_verify",
    "SELECT concat('/in/', source, '/', doc_id, '.jpg') AS path, CASE WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 10 = 2 THEN 'missing' WHEN doc_id % 10 = 3 THEN 'changed' ELSE 'ok' END AS state, doc_id % 10 NOT IN (2, 3) AS good FROM documents",
)
def _(r):
    path, k = F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.lit(".jpg")).alias("path"), F.col("doc_id") % 10
    old = S.manifest_build(r.documents.where(k != 1).select(path, F.col("text").alias("content")))
    new = S.manifest_build(r.documents.where(k != 2).select(path, F.when(k == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")))
    return S.manifest_verify(old, new)


@query("s06_verify_copies", "SELECT doc_id::VARCHAR AS path, doc_id % 6 NOT IN (0, 1) AS good FROM documents")
def _(r):
    i = F.col("doc_id")
    d = r.documents.select(i.cast("string").alias("path"), S.content_digest("text").alias("digest"), F.col("n_chars").alias("length"), "doc_id")
    return S.verify_copies(d.drop("doc_id"), d.where(i % 6 != 0).withColumn("length", F.col("length") + F.when(i % 6 == 1, 1).otherwise(0)))


@query("s07_decode_results", "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(props->>'k' AS BIGINT) END AS k FROM events")
def _(r):
    raw = r.events.select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("props"))
    return S.decode_results(raw, "props", "struct<k: long>").select("event_id", "props.k")


#: Results of three analyzers in one JSON column, some of them cut off.
RAW = "SELECT event_id, event_id % 3 AS analyzer, CASE WHEN event_id % 9 = 4 THEN '{' || body ELSE body END AS raw FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('{\"quality\":{\"sharpness\":', event_id % 401, '},\"k\":', props->>'k', '}') WHEN 1 THEN concat('{\"defects\":[\"crack\",\"blur', event_id % 5, '\"],\"k\":\"', props->>'k', '\"}') ELSE concat('{\"compliant\":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '}') END AS body FROM events)"


def raw_results(r):
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    text = lambda v: v.cast("string")
    quality = F.concat(F.lit('{"quality":{"sharpness":'), text(i % 401), F.lit('},"k":'), k, F.lit("}"))
    defects = F.concat(F.lit('{"defects":["crack","blur'), text(i % 5), F.lit('"],"k":"'), k, F.lit('"}'))
    compliant = F.concat(F.lit('{"compliant":'), text(i % 2 == 0), F.lit("}"))
    body = F.when(i % 3 == 0, quality).when(i % 3 == 1, defects).otherwise(compliant)
    return r.events.select("event_id", (i % 3).alias("analyzer"), F.when(i % 9 == 4, F.concat(F.lit("{"), body)).otherwise(body).alias("raw"))


@query("s07_variant_results", f"SELECT event_id, CASE WHEN ok AND analyzer = 0 THEN json_extract(raw, '$.quality.sharpness')::BIGINT END AS sharpness, CASE WHEN ok AND analyzer = 1 THEN json_extract_string(raw, '$.defects[1]') END AS second_defect, CASE WHEN ok AND analyzer = 2 THEN json_extract(raw, '$.compliant')::BOOLEAN END AS compliant, CASE WHEN ok THEN json_extract_string(raw, '$.k')::BIGINT END AS k FROM (SELECT *, event_id % 9 <> 4 AS ok FROM ({RAW}))")
def _(r):
    fields = {"sharpness": ("$.quality.sharpness", "long"), "second_defect": ("$.defects[1]", "string"), "compliant": ("$.compliant", "boolean"), "k": ("$.k", "long")}
    return S.decode_variants(raw_results(r), "raw").select("event_id", *S.variant_fields("raw", fields))


@query("s07_variant_schema", f"SELECT analyzer, CASE analyzer WHEN 0 THEN 'OBJECT<k: BIGINT, quality: OBJECT<sharpness: BIGINT>>' WHEN 1 THEN 'OBJECT<defects: ARRAY<STRING>, k: STRING>' ELSE 'OBJECT<compliant: BOOLEAN>' END AS schema FROM ({RAW}) GROUP BY 1")
def _(r):
    return S.merged_schema(S.decode_variants(raw_results(r), "raw"), "raw", "analyzer")


@query("s08_save_load_results", "SELECT item_id, session_id, final_decision FROM results WHERE session_id = 3")
def _(r):
    path = f"{checkpoint_root(r.spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    rows = settle(r.results.select("item_id", "session_id", "final_decision"))  # a batch that is saved again has the same rows, which sums of doubles made anew need not give
    for batch in ("0", "1", "0"):  # the repeated batch changes nothing
        S.save_results(rows.where(F.col("item_id") % 2 == int(batch)), path, batch)
    return S.load_results(r.spark, path, 3).select("item_id", F.col("session_id").cast("long").alias("session_id"), "final_decision")


@query("s09_export_csv", "SELECT filename, source_folder, final_decision, replace(reasons, ',', '; ') AS rejection_reasons, coalesce(overall, 0.0e0) AS quality_score, human_override, processing_time, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM results", "quality_score processing_time")
def _(r):
    return S.export_rows(results(r))


@query("s10_export_json", "SELECT item_id, filename, final_decision AS decision, len(list_filter(string_split(reasons, ','), lambda x: x <> ''))::BIGINT AS n_reasons, overall FROM results", "overall")
def _(r):
    rows = S.export_json_rows(results(r))
    back = F.from_json("record", "struct<filename: string, decision: string, reasons: array<string>, quality: struct<overall: double>>")
    return rows.select("item_id", back.alias("x")).select("item_id", "x.filename", "x.decision", F.size("x.reasons").cast("long").alias("n_reasons"), "x.quality.overall")


@query("s11_export_partitioned", "SELECT item_id, ((row_number() OVER (ORDER BY image_path, item_id) - 1) // 200 + 1)::BIGINT AS folder FROM items")
def _(r):
    path = f"{checkpoint_root(r.spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    S.export_partitioned(W.assign_folders(r.items).select("item_id", "folder"), path)
    return r.spark.read.parquet(path).select("item_id", F.col("folder").cast("long").alias("folder"))


GRID = "SELECT vec_id AS item_id, ((generate_subscripts(embedding, 1) - 1) // 8)::INT AS y, ((generate_subscripts(embedding, 1) - 1) % 8)::INT AS x, floor((unnest(embedding)::DOUBLE + 1) * 127.5)::BIGINT AS gray FROM embeddings"


def grid(r):
    each = r.embeddings.select(F.col("vec_id").alias("item_id"), F.posexplode("embedding").alias("k", "v"))
    return each.select("item_id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), F.floor((F.col("v").cast("double") + 1) * 127.5).cast("long").alias("gray"))


@query(
    "r01_sharpness",
    f"""WITH p AS ({GRID}), q AS (SELECT a.item_id, a.y, a.x, sum(b.gray * CASE WHEN s.dy = 0 AND s.dx = 0 THEN -4 ELSE 1 END) AS v FROM p a, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx), p b
      WHERE b.item_id = a.item_id AND b.y = CASE WHEN a.y + s.dy < 0 THEN 1 WHEN a.y + s.dy > 7 THEN 6 ELSE a.y + s.dy END AND b.x = CASE WHEN a.x + s.dx < 0 THEN 1 WHEN a.x + s.dx > 7 THEN 6 ELSE a.x + s.dx END GROUP BY ALL)
    SELECT item_id, var_pop(v) AS sharpness FROM q GROUP BY item_id""",
    "sharpness",
)
def _(r):
    return R.pixel_sharpness(grid(r), 8, 8)


@query("r03_exposure_stats", f"SELECT item_id, avg(gray) / 255 AS brightness, stddev_pop(gray) / 255 AS contrast, avg((gray > 130)::INT) AS over_pct, avg((gray < 120)::INT) AS under_pct FROM ({GRID}) GROUP BY 1".replace("> 130", "> 240").replace("< 120", "< 15"), "brightness contrast over_pct under_pct")
def _(r):
    return R.pixel_metrics(grid(r))


@query("r06_degraded", "SELECT item_id, item_id % 5 = 0 AS degraded, CASE WHEN item_id % 5 = 0 THEN 0.5e0 ELSE overall END AS overall FROM scored", "overall")
def _(r):
    parts = F.struct("sharpness", "noise", F.col("brightness").alias("exposure"), "overall", (F.col("overall") > 0.6).alias("passed"))
    df = r.scored.select("item_id", F.when(F.col("item_id") % 5 != 0, parts).alias("quality"))
    return R.degraded(df, "quality").select("item_id", "degraded", "quality.overall")


@query("sim01_average_hash", f"WITH p AS ({GRID}), m AS (SELECT item_id, avg(gray) AS m FROM p GROUP BY 1) SELECT item_id, format('{{:016x}}', sum(CASE WHEN gray > m THEN 1::UBIGINT << (63 - (y * 8 + x)) ELSE 0 END)::UBIGINT) AS ahash FROM p JOIN m USING (item_id) GROUP BY item_id")
def _(r):
    return R.average_hash(grid(r))


#: Colour images of 8 by 8 pixels from the same grid, a byte a channel, in the order blue, green, red.
COLOUR = f"SELECT item_id, y, x, gray AS b, (7 * gray) % 256 AS g, 255 - gray AS r, floor(0.299e0 * (255 - gray) + 0.587e0 * ((7 * gray) % 256) + 0.114e0 * gray + 0.5e0) AS gray FROM ({GRID})"


def images(r):
    value = lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("long")
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.concat(byte(value(v)), byte((7 * value(v)) % 256), byte(255 - value(v)))), ""))
    return r.embeddings.select(F.col("vec_id").cast("string").alias("item_id"), F.lit(192).cast("long").alias("file_size"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), data.alias("data"))


#: Of every fifty images one is no image, one is empty, one has another ending and one has it in capitals.
TREE = "SELECT vec_id, concat('f', vec_id % 7, '/', vec_id, CASE vec_id % 50 WHEN 3 THEN '.jpg' WHEN 5 THEN '.txt' WHEN 6 THEN '.PNG' ELSE '.png' END) AS path, vec_id % 50 AS kind FROM embeddings"


def image_tree(r) -> str:
    """The images as files below a fresh root on shared storage."""
    root = f"{checkpoint_root(r.spark).rstrip('/')}/images-{uuid.uuid4().hex}"
    i, kind = F.col("item_id").cast("long"), F.col("item_id").cast("long") % 50
    ending = F.when(kind == 3, ".jpg").when(kind == 5, ".txt").when(kind == 6, ".PNG").otherwise(".png")
    df = encode_png(images(r)).withColumn("path", F.concat(F.lit("f"), (i % 7).cast("string"), F.lit("/"), "item_id", ending))
    content = F.when(kind == 3, F.lit("no image").cast("binary")).when(kind != 4, F.col("content"))
    write_image_files(df.select("path", content.alias("content")), root)
    return root


def below(column: str = "item_id"):
    """The last two parts of a path."""
    return F.array_join(F.slice(F.split(column, "/"), -2, 2), "/")


PIXELS = f"SELECT item_id, string_agg(printf('%02X%02X%02X', b, g, r), '' ORDER BY y, x) AS pixels FROM ({COLOUR}) GROUP BY item_id"


@query("s01_scan_images", f"SELECT path, 268::BIGINT AS file_size, 8 AS height, 8 AS width, 3 AS channels, pixels FROM ({TREE}) t JOIN ({PIXELS}) p ON p.item_id = vec_id WHERE kind NOT IN (3, 4, 5)")
def _(r):
    root = image_tree(r)
    return S.scan_images(r.spark, root).select(below().alias("path"), "file_size", "height", "width", "channels", F.hex("data").alias("pixels"))


@query("s02_count_inputs", f"SELECT split_part(path, '/', 1) AS folder, count(*) AS n_files, sum(CASE kind WHEN 3 THEN 8 WHEN 4 THEN 0 ELSE 268 END)::BIGINT AS bytes FROM ({TREE}) WHERE kind <> 5 GROUP BY 1")
def _(r):
    return S.count_by_folder(r.spark, image_tree(r))


@query("s03_image_metadata", f"SELECT path, split_part(path, '/', 2) AS filename, '.png' AS extension, 268::BIGINT AS file_size, 8 AS width, 8 AS height, 3 AS channels FROM ({TREE}) WHERE kind NOT IN (3, 4, 5)")
def _(r):
    root = image_tree(r)
    return S.image_metadata(S.scan_images(r.spark, root)).select(below().alias("path"), "filename", "extension", "file_size", "width", "height", "channels")


@query("r07_pixel_table", f"SELECT item_id::VARCHAR AS item_id, y, x, b::INT AS b, g::INT AS g, r::INT AS r FROM ({COLOUR})")
def _(r):
    return R.pixel_table(images(r))


MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(
    "r02_noise",
    f"""WITH p AS ({COLOUR}), t AS (SELECT k - 2 AS d, w / 16e0 AS w FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([1, 4, 6, 4, 1]) AS w)),
      s AS (SELECT a.item_id, a.y, a.x, a.gray, floor(sum(b.gray * u.w * v.w) + 0.5e0) AS soft FROM p a, t u, t v, p b WHERE b.item_id = a.item_id AND b.y = {MIRROR.format("a.y + u.d")} AND b.x = {MIRROR.format("a.x + v.d")} GROUP BY ALL)
    SELECT item_id::VARCHAR AS item_id, stddev_pop(abs(gray - soft)) / 255 AS noise FROM s GROUP BY 1""",
    "noise",
)
def _(r):
    return R.quality_metrics(images(r)).select("item_id", "noise")


@query("r04_channel_means", f"SELECT item_id::VARCHAR AS item_id, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM ({COLOUR}) GROUP BY 1", "b g r")
def _(r):
    return R.quality_metrics(images(r)).select("item_id", "b", "g", "r")


@query(
    "r05_quality_metrics",
    f"""WITH p AS ({COLOUR}), q AS (SELECT a.item_id, a.y, a.x, sum(b.gray * CASE WHEN s.dy = 0 AND s.dx = 0 THEN -4 ELSE 1 END) AS v FROM p a, (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx), p b
      WHERE b.item_id = a.item_id AND b.y = {MIRROR.format("a.y + s.dy")} AND b.x = {MIRROR.format("a.x + s.dx")} GROUP BY ALL),
      h AS (SELECT item_id, stddev_pop(n) AS s FROM (SELECT i.item_id, k, count(p.item_id) / 64 AS n FROM (SELECT DISTINCT item_id FROM p) i CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) LEFT JOIN p ON p.item_id = i.item_id AND greatest(0, (gray::INT - 1) // 51) = k GROUP BY ALL) GROUP BY 1)
    SELECT p.item_id::VARCHAR AS item_id, 8 AS width, 8 AS height, any_value(z.sharpness) AS sharpness, avg(gray) / 255 AS brightness, stddev_pop(gray) / 255 AS contrast, avg((gray > 240)::INT) AS over_pct, avg((gray < 15)::INT) AS under_pct, 1 - any_value(h.s) AS histogram_balance, true AS decoded
    FROM p JOIN (SELECT item_id, var_pop(v) AS sharpness FROM q GROUP BY 1) z USING (item_id) JOIN h USING (item_id) GROUP BY p.item_id""",
    "sharpness brightness contrast over_pct under_pct histogram_balance",
)
def _(r):
    return R.quality_metrics(images(r)).select("item_id", "width", "height", "sharpness", "brightness", "contrast", "over_pct", "under_pct", "histogram_balance", "decoded")


HEX64 = "format('{{:016x}}', sum(CASE WHEN {0} THEN 1::UBIGINT << (63 - (y * 8 + x)) ELSE 0 END)::UBIGINT)"


@query(
    "sim01_perceptual_hashes",
    f"""WITH p AS (SELECT item_id, y, x, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS gray FROM ({COLOUR})), m AS (SELECT *, avg(gray) OVER (PARTITION BY item_id) AS mean, lag(gray) OVER (PARTITION BY item_id, y ORDER BY x) AS before FROM p),
      c AS (SELECT u, y, sum(cos(pi() * (2 * k + 1) * u / 64)) AS w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS k, unnest(range(32)) // 4 AS y) GROUP BY ALL),
      l AS (SELECT item_id, cu.u AS y, cv.u AS x, sum(gray * cu.w * cv.w) AS v FROM p JOIN c cu ON cu.y = p.y JOIN c cv ON cv.y = p.x GROUP BY ALL), d AS (SELECT *, median(v) OVER (PARTITION BY item_id) AS mid FROM l)
    SELECT a.item_id::VARCHAR AS item_id, phash, dhash, ahash FROM (SELECT item_id, {HEX64.format('round(gray, 9) > round(before, 9)')} AS dhash, {HEX64.format('round(gray, 9) > round(mean, 9)')} AS ahash FROM m GROUP BY 1) a JOIN (SELECT item_id, {HEX64.format('round(v, 9) > round(mid, 9)')} AS phash FROM d GROUP BY 1) b USING (item_id)""",
)
def _(r):
    return perceptual_hashes(images(r))
