"""Filters, projections, joins, pages and set operations on results and sessions (P, J, L, U)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.exprs import col, ratio

#: Reason keys and their labels.
REASON_LABELS = {
    "low_quality": "Low image quality", "defects_detected": "Defects found", "similar_images": "Similar to other images",
    "privacy_violation": "Privacy violation", "metadata_issues": "Metadata problems", "copyright": "Copyright concern",
}


def filter_results(df: DataFrame, decision=None, rejection_reason=None, source_folder=None, human_override=None, search=None, labels: Mapping[str, str] = REASON_LABELS) -> DataFrame:
    """All given conditions; a reason can be a key or its label; ``%`` and ``_`` in ``search`` are wildcards."""
    if decision is not None:
        df = df.where(F.col("final_decision") == decision)
    if rejection_reason is not None:
        key = next((k for k, v in labels.items() if v == rejection_reason), rejection_reason)
        df = df.where(F.array_contains("reasons", key))
    if source_folder is not None:
        df = df.where(F.col("source_folder") == source_folder)
    if human_override is not None:
        df = df.where(F.col("human_override") == human_override)
    return df if search is None else df.where(F.col("filename").ilike(f"%{search}%"))


def review_queue(df: DataFrame, decision=None, reason=None, human_reviewed=None, source_folder=None) -> DataFrame:
    df = filter_results(df, decision, reason, source_folder)
    return df if human_reviewed is None else df.where(F.col("human_review_at").isNotNull() == human_reviewed)


def list_sessions(sessions: DataFrame, project_id=None, status: Sequence[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first."""
    df = sessions if project_id is None else sessions.where(F.col("project_id") == project_id)
    df = df if status is None else df.where(F.col("status").isin(*status))
    df = df.orderBy(F.desc("created_at"), F.desc("id"))
    return df if limit is None else df.offset(offset).limit(limit)


def list_projects(projects: DataFrame, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first."""
    df = projects if status is None else projects.where(F.col("status") == status)
    df = df.orderBy(F.desc("created_at"), F.desc("id"))
    return df if limit is None else df.offset(offset).limit(limit)


def active_projects(projects: DataFrame) -> DataFrame:
    """Running and paused projects, the last changed first."""
    return projects.where(F.col("status").isin("running", "paused")).orderBy(F.desc("updated_at"), F.desc("id"))


def concurrent_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that are running or about to, newest first."""
    return list_sessions(sessions, status=["running", "created"])


def session_status(sessions: DataFrame) -> DataFrame:
    percent = lambda a, b: F.round(100 * ratio(F.col(a), F.col(b)), 2)
    return sessions.select("id", "status", percent("processed_images", "total_images").alias("progress"), percent("approved_images", "processed_images").alias("approval"))


def activity_type() -> Column:
    return F.when(F.col("human_override"), "human_override").when(F.col("final_decision").isin("approved", "rejected"), F.col("final_decision")).otherwise("processed")


def grid_view(results: DataFrame) -> DataFrame:
    """Flat metrics of the nested quality, 0 where absent."""
    q = lambda c: F.coalesce(F.col("quality")[c], F.lit(0.0)).alias(c)
    return results.select("item_id", q("overall"), q("sharpness"), q("noise"), q("exposure"), F.coalesce("source_folder", F.lit("Unknown")).alias("folder"))


def decision_summary(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    rounded = lambda c, n: F.round(F.col(c).cast("decimal(20,10)"), n).cast("double").alias(c)
    first = F.array_join(F.slice(F.transform("reasons", lambda x: x["reason"]), 1, 3), ",")
    return df.select("item_id", "decision", *(rounded(s, 3) for s in scores), rounded("processing_time", 4), F.size("reasons").alias("rejection_count"), first.alias("first_reasons"))


def select_analyses(analyses: Mapping[str, DataFrame], types: Sequence[str]) -> dict[str, DataFrame]:
    """The requested of quality, defect, compliance and similarity; the others are never computed."""
    if unknown := set(types) - {"quality", "defect", "compliance", "similarity"}:
        raise ValueError(f"unknown analyses: {sorted(unknown)}")
    return {t: analyses[t] for t in types}


CHECKPOINT_STATE = "struct<processed_count: long, current_batch: long, error_count: long>"


def checkpoint_listing(checkpoints: DataFrame) -> DataFrame:
    """Newest first, with the fields of the JSON state; rows whose state can't be read are left out."""
    df = checkpoints.withColumn("state", F.from_json("session_state", CHECKPOINT_STATE))
    return df.where("state.processed_count is not null").select("id", "session_id", "created_at", "checkpoint_type", "state.*").orderBy(F.desc("created_at"), F.desc("id"))


def resumable_sessions(sessions: DataFrame, input_folder: str, output_folder: str, statuses: Sequence[str] = ("running", "paused", "failed")) -> DataFrame:
    return sessions.where(F.col("status").isin(*statuses) & (F.col("input_folder") == input_folder) & (F.col("output_folder") == output_folder))


def with_groups(items: DataFrame, clusters: DataFrame) -> DataFrame:
    return items.join(clusters.select("item_id", F.col("cluster_id").alias("similarity_group")), "item_id", "left").na.fill(0, ["similarity_group"])


def assemble(items: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row per item with a struct per analysis, null where it has none. All joins share the key item_id."""
    for name, df in parts.items():
        items = items.join(df.select("item_id", F.struct(*(c for c in df.columns if c != "item_id")).alias(name)), "item_id", "left")
    return items


def sessions_with_project(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return sessions.join(names, "project_id", "left").na.fill("Unknown", ["project_name"])


def group_neighbours(results: DataFrame) -> DataFrame:
    r = results.where("similarity_group is not null and similarity_group <> 0").select("session_id", "similarity_group", "item_id")
    return r.join(r.withColumnRenamed("item_id", "other_id"), ["session_id", "similarity_group"]).where("item_id <> other_id").select("item_id", "other_id")


def expand_similar(results: DataFrame) -> DataFrame:
    """From results with similar_images array<struct<path, similarity>>: the rows they name, in the order of rank."""
    each = results.select("session_id", "item_id", F.explode("similar_images").alias("s")).select("session_id", "item_id", F.col("s.path").alias("image_path"), F.coalesce("s.similarity", F.lit(0.0)).alias("similarity"))
    other = results.select("session_id", F.col("item_id").alias("other_id"), "image_path")
    return each.join(other, ["session_id", "image_path"]).where("item_id <> other_id").select("item_id", "other_id", "similarity").orderBy("item_id", F.desc("similarity"), "other_id")


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """Unordered pairs inside clusters. For statistics of large clusters use pairs of the similarity joins instead."""
    c = clusters.where("cluster_id <> 0").select("cluster_id", F.col("item_id").alias("a"))
    return c.join(c.withColumnRenamed("a", "b"), "cluster_id").where("a < b")


def translate_reasons(reasons: str | Column, labels: Mapping[str, str] = REASON_LABELS) -> Column:
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.transform(col(reasons), lambda r: F.coalesce(F.try_element_at(table, r), r))


def remaining_items(items: DataFrame, results: DataFrame) -> DataFrame:
    return items.join(results.select("item_id"), "item_id", "left_anti")


def orphans(artifacts: DataFrame, results: DataFrame, key: str = "item_id") -> DataFrame:
    return artifacts.join(results.select(key), key, "left_anti")


def select_for_review(results: DataFrame, ids: DataFrame) -> DataFrame:
    return results.join(ids, "item_id", "left_semi")


def missing_ids(results: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(results, "item_id", "left_anti").distinct()


def latest_checkpoint(sessions: DataFrame, checkpoints: DataFrame) -> DataFrame:
    rest = [c for c in checkpoints.columns if c != "session_id"]
    newest = checkpoints.groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("c"))
    return sessions.join(newest, sessions.id == newest.session_id).select(F.col("session_id"), F.col("status"), F.col("c.id").alias("checkpoint_id"), F.col("c.processed_count").alias("processed_count"))


SORT_KEYS = {"filename": "filename", "confidence": "overall", "processing_time": "processing_time"}


def sorted_page(df: DataFrame, sort_by: str = "created_at", order: str = "desc", page: int = 1, size: int = 50) -> DataFrame:
    """A page of rows: a top-k over offset and limit, ties by item_id."""
    key = F.col(SORT_KEYS.get(sort_by, "created_at"))
    return df.orderBy(key.desc_nulls_last() if order == "desc" else key.asc_nulls_first(), "item_id").offset((page - 1) * size).limit(size)


def page_info(df: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    one = df.agg(F.count("*").alias("total_count"))
    pages = F.ceil(F.col("total_count") / size)
    return one.select("total_count", pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def recent(df: DataFrame, n: int, time: str = "created_at", key: str = "item_id") -> DataFrame:
    return df.orderBy(F.col(time).desc_nulls_last(), key).limit(n)


def results_page(df: DataFrame, skip: int = 0, limit: int = 50, decision=None) -> DataFrame:
    return filter_results(df, decision).orderBy(F.col("created_at").desc_nulls_last(), "item_id").offset(skip).limit(limit)


def compare_structure(in_dirs: DataFrame, out_dirs: DataFrame) -> DataFrame:
    """name and side (missing or extra) of the directories that only one side has; inputs count if all digits."""
    source, target = in_dirs.where(F.col("name").rlike(r"^[0-9]+$")).select("name"), out_dirs.select("name")
    return source.subtract(target).withColumn("side", F.lit("missing")).unionByName(target.subtract(source).withColumn("side", F.lit("extra")))


def structure_valid(in_dirs: DataFrame, out_dirs: DataFrame) -> DataFrame:
    """One row: n_missing, n_extra, and valid if both sides have the same directories."""
    n = lambda side: F.count_if(F.col("side") == side)
    return compare_structure(in_dirs, out_dirs).agg(n("missing").alias("n_missing"), n("extra").alias("n_extra"), (F.count("*") == 0).alias("valid"))


def union_defects(objects: DataFrame, edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """item_id, object_type, defect_type, confidence, description of three detectors."""
    edge = edges.select("item_id", F.lit("edge_feature").alias("object_type"), "defect_type", "confidence", F.format_string("%s with %s severity", "defect_type", "severity").alias("description"))
    shape = shapes.select("item_id", F.col("shape").alias("object_type"), F.lit("shape_anomaly").alias("defect_type"), "confidence", F.lit("unusual shape").alias("description"))
    own = objects.select("item_id", "object_type", "defect_type", "confidence", F.concat_ws(" on ", "defect_type", "object_type").alias("description"))
    return own.unionByName(edge).unionByName(shape)


def distinct_reasons(*lists: str) -> Column:
    return F.array_distinct(F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists)))


def mirror_path(path: str | Column, in_root: str, out_root: str | None = None) -> Column:
    """The path below the output root; null if it isn't below the input root."""
    root, out = in_root.rstrip("/"), (out_root or in_root.rstrip("/") + "_processed").rstrip("/")
    return F.when(F.startswith(col(path), F.lit(root + "/")), F.concat(F.lit(out), F.substring(col(path), len(root) + 1, 1 << 30)))
