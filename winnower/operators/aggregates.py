"""Aggregations (A-01 to A-31): one pass of partial sums per result, long forms by explode or stack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.durable import settle
from winnower.functions.exprs import present, ratio
from winnower.operators.windows import global_rank


def _is(decision: str) -> Column:
    return F.count_if(F.col("final_decision") == decision)


def session_summary(results: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    used = F.when(F.col("processing_time") != 0, F.col("processing_time"))
    df = results.groupBy(*keys).agg(
        F.count("*").alias("total"), _is("approved").alias("approved"), _is("rejected").alias("rejected"),
        F.coalesce(F.sum(used), F.lit(0.0)).alias("total_time"), F.coalesce(F.avg(used), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.avg("overall"), F.lit(0.0)).alias("avg_quality"), F.count_if(F.col("human_override")).alias("overrides"),
    )
    return df.withColumns({"pending": F.col("total") - F.col("approved") - F.col("rejected"), "approval_rate": ratio(F.col("approved"), F.col("total"))})


def rejection_breakdown(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count per reason of the rejected rows, and its percentage of these rows."""
    bad = results.where("final_decision = 'rejected'")
    rows = bad.groupBy(*keys).agg(F.count("*").alias("rows"))
    counts = bad.select(*keys, F.explode("reasons").alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    joined = counts.join(rows, list(keys)) if keys else counts.crossJoin(F.broadcast(rows))  # the one row of totals
    return joined.select(*keys, "reason", "n", (100 * F.col("n") / F.col("rows")).alias("percent"))


def decision_aggregate(decisions: DataFrame) -> DataFrame:
    n = lambda d: F.count_if(F.col("decision") == d)
    df = decisions.agg(F.count("*").alias("total"), n("approved").alias("approved"), n("rejected").alias("rejected"), n("review_required").alias("review_required"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"), F.coalesce(F.avg("overall_score"), F.lit(0.0)).alias("avg_overall"))
    return df.withColumn("approval_rate", ratio(F.col("approved"), F.col("total")))


def reason_categories(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.explode("reasons").alias("x")).groupBy(F.col("x.category").alias("category")).agg(F.count("*").alias("n"))


def top_reasons(decisions: DataFrame, k: int = 10) -> DataFrame:
    return decisions.select(F.explode("reasons").alias("x")).groupBy(F.col("x.reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def processing_statistics(results: DataFrame) -> DataFrame:
    t = F.when(F.col("processing_time") > 0, F.col("processing_time"))
    return results.agg(*(F.coalesce(f(t), F.lit(0.0)).alias(n) for n, f in (("avg_time", F.avg), ("min_time", F.min), ("max_time", F.max), ("total_time", F.sum))))


def approval_chart(results: DataFrame) -> DataFrame:
    s = session_summary(results, ())
    each = s.selectExpr("total", "stack(3, 'approved', approved, 'rejected', rejected, 'pending', pending) AS (label, value)")
    return each.select("label", "value", (100 * ratio(F.col("value"), F.col("total"))).alias("percent"))


def quality_histogram(results: DataFrame, column: str = "overall", bins: int = 10) -> DataFrame:
    """Counts in equal bins of 0 to 1, the last one closed; empty bins are 0; no rows without a score."""
    bin_of = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counts = results.where(F.col(column).between(0, 1)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    some = results.agg(F.count(column).alias("scores")).where("scores > 0")
    every = results.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(some))  # bins rows by one
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def hourly_timeline(results: DataFrame) -> DataFrame:
    df = results.where("created_at is not null").groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(_is("approved").alias("approved"), _is("rejected").alias("rejected"))
    return df.withColumn("value", F.col("approved") + F.col("rejected"))


def folder_breakdown(results: DataFrame) -> DataFrame:
    df = results.groupBy(F.coalesce("source_folder", F.lit("Unknown")).alias("folder")).agg(F.count("*").alias("total"), _is("approved").alias("approved"), _is("rejected").alias("rejected"))
    return df.withColumn("rate", 100 * ratio(F.col("approved"), F.col("total")))


def facet_values(results: DataFrame) -> DataFrame:
    """One row of all values to filter by, as asked: it grows with the number of different folders and reasons. ``facet_counts`` has a row for each."""
    reasons = results.select(F.explode("reasons").alias("x")).agg(F.array_sort(F.collect_set("x")).alias("reasons"))
    one = results.agg(
        F.array_sort(F.collect_set("final_decision")).alias("decisions"), F.array_sort(F.collect_set("source_folder")).alias("folders"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
        F.coalesce(F.min("overall"), F.lit(0.0)).alias("min_score"), F.coalesce(F.max("overall"), F.lit(1.0)).alias("max_score"),
    )
    return one.crossJoin(F.broadcast(reasons))  # one row by one row


def facet_counts(results: DataFrame) -> DataFrame:
    """facet, label, n in long form, in one pass."""
    pair = lambda f, v: F.struct(F.lit(f).alias("facet"), v.alias("label"))
    fixed = F.array(
        pair("all", F.lit("all")), pair("decision", F.coalesce("final_decision", F.lit("pending"))), pair("folder", F.coalesce("source_folder", F.lit("unknown"))),
        pair("reviewed", F.when(F.col("human_review_at").isNotNull(), "reviewed").otherwise("not_reviewed")),
    )
    each = F.concat(fixed, F.transform("reasons", lambda x: pair("reason", x)))
    return results.select(F.explode(each).alias("x")).groupBy("x.facet", "x.label").agg(F.count("*").alias("n"))


def compare_sessions(results: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    s = session_summary(results if ids is None else results.where(F.col("session_id").isin(*ids)))
    return s.withColumns({"per_minute": ratio(F.col("total"), F.col("total_time") / 60), "efficiency": F.col("approval_rate") * (1 - ratio(F.col("overrides"), F.col("total")))})


def comparison_recommendations(compared: DataFrame) -> DataFrame:
    one = compared.agg(F.max("approval_rate").alias("best"), F.max("efficiency").alias("fast"), F.avg("approval_rate").alias("mean"))
    return one.select(F.explode(present((F.col("best") > 0.8, "use_best_approval"), (F.col("fast") > 0.7, "use_best_efficiency"), (F.col("mean") < 0.5, "review_thresholds"))).alias("code"))


def project_statistics(sessions: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("total_images", "status"), F.struct("created_at", "id"))
    df = sessions.groupBy("project_id").agg(F.count("*").alias("sessions"), F.sum("processed_images").alias("processed"), F.sum("approved_images").alias("approved"), F.sum("rejected_images").alias("rejected"), newest.alias("newest"))
    return df.select("project_id", "sessions", "processed", "approved", "rejected", (100 * ratio(F.col("approved"), F.col("processed"))).alias("approval"), F.col("newest.total_images").alias("latest_total"), F.col("newest.status").alias("latest_status"))


def batch_statistics(items: DataFrame) -> DataFrame:
    """From one row per item with run_id, batch, failed, seconds and memory_mb: first per batch, then per run."""
    batch = items.groupBy("run_id", "batch").agg(F.count("*").alias("n"), F.count_if("failed").alias("errors"), F.sum("seconds").alias("seconds"), F.avg("memory_mb").alias("memory"))
    df = batch.groupBy("run_id").agg(F.sum("n").alias("processed"), F.sum("errors").alias("errors"), F.avg("seconds").alias("avg_batch_time"), F.avg("memory").alias("avg_memory"))
    return df.withColumn("success", 100 * ratio(F.col("processed") - F.col("errors"), F.col("processed")))


def unified_batch_statistics(items: DataFrame) -> DataFrame:
    models = items.select(F.explode("models").alias("m")).agg(F.count_distinct("m").alias("models"))
    yes = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    one = items.agg(yes(F.col("decision") == "approved").alias("approval_rate"), yes(F.col("decision") == "rejected").alias("rejection_rate"), yes(F.col("score")).alias("mean_score"), yes(F.col("confidence")).alias("mean_confidence"), yes(F.col("fallback")).alias("fallback_rate"))
    return one.crossJoin(F.broadcast(models))  # one row by one row


def defect_rollup(items: DataFrame, detections: DataFrame) -> DataFrame:
    d = detections.groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("defect_type").alias("kinds"), F.avg("confidence").alias("mean"), F.count_if(F.col("confidence") > 0.5).alias("high"))
    df = items.select("item_id").join(d, "item_id", "left").na.fill(0, ["n", "kinds", "mean", "high"])
    df = df.withColumn("anomaly", F.least(F.lit(1.0), F.col("n") * F.col("mean") / 10))
    return df.withColumn("passed", (F.col("anomaly") <= 0.3) & (F.col("n") <= 3) & (F.col("high") <= 1))


def detector_rollup(detections: DataFrame) -> DataFrame:
    d = detections.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") > 0.8).alias("confident"), F.collect_set("defect_type").alias("types"))
    base, mass = F.least(F.lit(1.0), F.col("n") * F.col("mean_confidence") / 10), F.col("n") * F.col("mean_confidence") * F.size("types") / 10
    return d.withColumn("score", 0.4 * base + 0.6 * F.least(F.lit(1.0), mass))


def detector_types(detections: DataFrame) -> DataFrame:
    return detections.groupBy("item_id", "defect_type").agg(F.count("*").alias("n"))


def compliance_rollup(items: DataFrame, logos: DataFrame, privacy: DataFrame, issues: DataFrame, relevance: str = "relevance") -> DataFrame:
    """Counts by kind over one union, and compliant where none is found and the relevance suffices."""
    kind = lambda df, k: df.select("item_id", F.lit(k).alias("kind"), F.col("issue"))
    long = kind(logos, "logo").unionByName(kind(privacy, "privacy")).unionByName(kind(issues, "metadata"))
    c = long.groupBy("item_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("logo", "privacy", "metadata")), F.array_sort(F.collect_set("issue")).alias("main_issues"))
    df = items.join(c, "item_id", "left").na.fill(0, ["logo", "privacy", "metadata"])
    return df.withColumns({"main_issues": F.coalesce("main_issues", F.array().cast("array<string>")), "compliant": (F.col("logo") + F.col("privacy") + F.col("metadata") == 0) & (F.col(relevance) >= 0.5)})


def cluster_stats(pairs: DataFrame, key: str = "cluster_id", similarity: str = "similarity") -> DataFrame:
    """From pairs: mean, extremes and variance of each cluster's similarities, counts per level, quality and recommendation."""
    from winnower.operators.similarity import similarity_level

    s, level = F.col(similarity), similarity_level(similarity)
    return graded_stats(pairs.groupBy(key).agg(F.avg(s).alias("avg"), F.max(s).alias("max"), F.min(s).alias("min"), F.var_pop(s).alias("variance"), *(F.count_if(level == x).alias(x) for x in ("identical", "near_duplicate", "similar", "somewhat_similar"))))


def graded_stats(df: DataFrame) -> DataFrame:
    """Quality and recommendation by the mean, and rounding, for rows of statistics whatever made them."""
    avg = F.col("avg")
    return df.withColumns({
        "quality": F.when(avg > 0.85, "high").when(avg > 0.75, "medium").otherwise("low"),
        "recommendation": F.when(avg >= 0.95, "remove_duplicates").when(avg >= 0.90, "review_duplicates").when(avg >= 0.75, "review_similar").otherwise("keep_all"),
        **{c: F.round(c, 3) for c in ("avg", "max", "min", "variance")},
    })


def group_statistics(groups: DataFrame) -> DataFrame:
    """From one row per group with size and kind (duplicate, similar, singleton)."""
    of = lambda k: F.col("kind") == k
    spare = lambda k: F.coalesce(F.sum(F.when(of(k), F.col("size") - 1)), F.lit(0))
    df = groups.agg(F.count("*").alias("groups"), F.count_if(of("singleton")).alias("singletons"), F.count_if(of("duplicate")).alias("duplicate_groups"), F.count_if(of("similar")).alias("similar_groups"), spare("duplicate").alias("duplicates"), spare("similar").alias("similars"))
    return df.withColumns({"keeps": F.col("groups"), "removes": F.col("duplicates") + F.col("similars")})


def integrity_counts(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """sessions: id, processed_images, approved_images, rejected_images, start_index; results: session_id, final_decision."""
    c = results.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("total"), _is("approved").alias("approved"), _is("rejected").alias("rejected"))
    df = sessions.withColumn("known", F.lit(True)).join(c, "id", "full").na.fill(0, ["total", "approved", "rejected"])
    beyond = F.coalesce(F.col("start_index") > F.col("total"), F.lit(False))
    issues = present((F.col("processed_images") != F.col("total"), "total_mismatch"), (F.col("approved_images") != F.col("approved"), "approved_mismatch"), (F.col("rejected_images") != F.col("rejected"), "rejected_mismatch"), (beyond, "index_beyond_results"), (F.col("known").isNull(), "missing_session"))
    return df.select("id", "total", "approved", "rejected", issues.alias("issues"), (~(F.col("known").isNull() | beyond)).alias("safe"))


def duplicate_results(results: DataFrame) -> DataFrame:
    return results.groupBy("session_id", "image_path").agg(F.count("*").alias("n")).where("n > 1")


def error_statistics(errors: DataFrame) -> DataFrame:
    """kind, label, n in long form from errors with category and severity, in one pass."""
    pair = lambda k, v, n=None: F.struct(F.lit(k).alias("kind"), v.alias("label"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    each = F.array(pair("total", F.lit("all")), pair("category", F.col("category")), pair("severity", F.col("severity")), pair("exception", F.col("exception_type")), pair("resolved", F.when(F.col("resolved"), "resolved").otherwise("unresolved")), pair("retries", F.lit("all"), F.col("retry_count")))
    return errors.select(F.explode(each).alias("x")).groupBy("x.kind", "x.label").agg(F.sum("x.n").alias("n"))


def folder_usage(files: DataFrame, folder: str = "folder", size: str = "length") -> DataFrame:
    """Count and bytes per folder, and for all in the row of folder ``total``."""
    r = files.rollup(folder).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.grouping(folder).alias("g"))
    return r.select(F.when(F.col("g") == 1, "total").otherwise(F.col(folder)).alias("folder"), "files", "bytes")


def run_performance(metrics: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    df = metrics.groupBy("session_id").agg(F.count("*").alias("n"), F.max("memory_mb").alias("peak_memory"), F.max("gpu_mb").alias("peak_gpu"), seconds.alias("elapsed"))
    return df.withColumns({"per_second": ratio(F.col("n"), F.col("elapsed")), "seconds_per_item": ratio(F.col("elapsed"), F.col("n"))})


def issue_counts(decisions: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    has = lambda c: F.count_if(F.exists("reasons", lambda x: x["category"] == c))
    df = decisions.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "approved").alias("approved"), *(has(c).alias(f"{c}_issues") for c in ("quality", "defect", "similarity", "compliance")))
    return df.withColumn("approval", 100 * ratio(F.col("approved"), F.col("total")))


def copy_summary(copies: DataFrame) -> DataFrame:
    return copies.agg(F.count("*").alias("total"), F.count_if("good").alias("succeeded"), F.count_if(~F.col("good")).alias("failed"), F.count_distinct("folder").alias("folders"))


def crash_summary(stale: DataFrame) -> DataFrame:
    """Of stale sessions with crash_type, processed, total and recoverable: one row per crash type and one for all."""
    df = stale.rollup("crash_type").agg(F.count("*").alias("crashed"), F.count_if("recoverable").alias("recoverable"), F.sum("processed").alias("processed"), F.sum("total").alias("total"), F.grouping("crash_type").alias("g"))
    return df.select(F.when(F.col("g") == 1, "all").otherwise(F.col("crash_type")).alias("crash_type"), "crashed", "recoverable", (F.col("crashed") - F.col("recoverable")).alias("unrecoverable"), "processed", "total", (100 * ratio(F.col("recoverable"), F.col("crashed"))).alias("recovery"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def score_statistics(decisions: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Per score column mean, median, sample deviation, extremes and quartiles; no rows for empty input.

    Quantiles are exact: values are ranked over sorted ranges, and the two that a quantile lies between are picked by rank.
    """
    each = decisions.select(F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("x")) for s in scores))).alias("y")).select("y.*").where("x is not null")
    ranked = settle(global_rank(each.withColumn("_tie", F.monotonically_increasing_id()), ("score", "x", "_tie"), "_k"))
    stats = ranked.groupBy("score").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.min("_k").alias("_first"), F.count("*").alias("_n"))
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    at = lambda p: (F.col("_n") - 1) * p
    part = lambda q, k, w: F.struct(F.lit(q).alias("q"), (F.col("_first") + k).cast("long").alias("_at"), w.alias("w"))
    parts = [x for q, p in names.items() for x in (part(q, F.floor(at(p)), 1 - (at(p) - F.floor(at(p)))), part(q, F.floor(at(p)) + 1, at(p) - F.floor(at(p))))]
    needed = stats.select(F.col("score").alias("s"), F.explode(F.array(*parts)).alias("p")).select("s", "p.*")  # six rows a score
    own = ranked.join(F.broadcast(needed), (F.col("score") == F.col("s")) & (F.col("_k") == F.col("_at")))
    quantiles = own.groupBy("score").agg(*(F.sum(F.when(F.col("q") == q, F.col("x") * F.col("w"))).alias(q) for q in names))
    return stats.join(quantiles, "score").select("score", "mean", "median", "std", "min", "max", "q25", "q75")
