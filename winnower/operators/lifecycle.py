"""Reviews, resumption and changes of session tables (X-01 to X-11): each returns the changed table."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnower.functions.durable import settle
from winnower.sources.tables import change_table

ERROR_FIELDS = [T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType())]


def apply_analyzer(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType, key: str = "item_id") -> DataFrame:
    """``fn`` on each row as a dict; a failure becomes a row of status ``error`` with its message, others are unaffected."""
    out = T.StructType([df.schema[key], *schema.fields, *ERROR_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                began = time.perf_counter()
                try:
                    made, status, error = fn(row), "ok", None
                except Exception as e:  # any failure of the user's function is data here
                    made, status, error = {}, "error", traceback.format_exception_only(e)[-1].strip()
                rows.append([row[key], *(made.get(n) for n in schema.names), status, error, time.perf_counter() - began])
            yield pd.DataFrame(rows, columns=out.names)

    return df.mapInPandas(run, out)


def apply_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, key: str = "item_id") -> DataFrame:
    """``fn`` on whole batches of rows: one call a batch as long as nothing fails. A batch that fails is halved until the bad rows are
    alone, which become rows of status ``error`` as with ``apply_analyzer``; ``fn`` must return a row for each that it gets, in their order.
    If the first half passes, the other must hold the failure and is halved without a call of its own. Each batch gives one batch of rows."""
    out = T.StructType([df.schema[key], *schema.fields, *ERROR_FIELDS])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, parts, at = len(pdf), [], []  # what was made, and of which rows
        status, error, seconds = np.full(rows, "ok", object), np.full(rows, None, object), np.zeros(rows)

        def attempt(lo: int, hi: int, bad: bool = False) -> bool:
            """Whether all rows from lo to hi pass; ``bad`` if it is known that they don't."""
            if not bad or hi - lo == 1:
                began = time.perf_counter()
                try:
                    made = fn(pdf.iloc[lo:hi])[schema.names]
                    if len(made) != hi - lo:
                        raise ValueError(f"{len(made)} rows made of {hi - lo}")
                    parts.append(made)
                    at.append((lo, hi))
                    seconds[lo:hi] = (time.perf_counter() - began) / (hi - lo)
                    return True
                except Exception as e:  # any failure of the user's function is data here
                    if hi - lo == 1:
                        status[lo], error[lo], seconds[lo] = "error", traceback.format_exception_only(e)[-1].strip(), time.perf_counter() - began
                        return False
            mid = (lo + hi) // 2
            attempt(mid, hi, attempt(lo, mid))
            return False

        attempt(0, rows)
        places = np.concatenate([np.arange(lo, hi) for lo, hi in at]) if at else np.zeros(0, np.int64)
        made = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=schema.names, dtype=object)
        if len(places) < rows:  # whole numbers stay whole beside the nulls of bad rows
            made = made.astype({c: object for c in made.columns if made[c].dtype.kind in "iub"}).set_axis(places).reindex(range(rows))
        made.insert(0, key, pdf[key].to_numpy())
        return made.assign(status=status, error=error, seconds=seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield whole(pdf)

    return df.mapInPandas(run, out)


def apply_model(df: DataFrame, make_predict: Callable, column: str, batch_size: int = 256, output: str = "prediction", dims: int | None = None) -> DataFrame:
    """A user's model over batches of a vector column; ``make_predict`` loads it once per worker."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[dims]] if dims else None)
    return df.withColumn(output, udf(F.col(column)))


def largest_model() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in model: the largest component of the vector."""
    return lambda x: x.max(axis=1).astype(np.float64)


def safe_apply(df: DataFrame, fns: Sequence[tuple[str, Callable[[dict], dict], T.StructType]], key: str = "item_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """The good rows of each function, and all failures together; each function runs once."""
    good, bad = {}, None
    for name, fn, schema in fns:
        out = settle(apply_analyzer(df, fn, schema, key))
        good[name] = out.where("status = 'ok'").drop("status", "error")
        failed = out.where("status = 'error'").select(key, F.lit(name).alias("function"), "error", "seconds")
        bad = failed if bad is None else bad.unionByName(failed)
    return good, bad


def review(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """reviews: item_id, action (approve or reject), reason, reviewed_at; the last per item counts."""
    last = reviews.groupBy("item_id").agg(F.max_by(F.struct("action", "reason", "reviewed_at"), F.struct("reviewed_at", "action")).alias("r"))
    df = results.join(last, "item_id", "left")
    new = F.when(F.col("r.action") == "approve", "approved").when(F.col("r.action") == "reject", "rejected")
    added = F.when((F.col("r.action") == "reject") & F.col("r.reason").isNotNull(), F.array_union("reasons", F.array("r.reason"))).otherwise(F.col("reasons"))
    return df.withColumns({"final_decision": F.coalesce(new, "final_decision"), "reasons": added, "human_override": F.coalesce(F.col("human_override"), F.lit(False)) | new.isNotNull(), "human_review_at": F.coalesce(F.when(new.isNotNull(), F.col("r.reviewed_at")), F.col("human_review_at"))}).drop("r")


def _changes(before: DataFrame, after: DataFrame) -> DataFrame:
    old = before.select("item_id", F.col("final_decision").alias("old"))
    return after.select("item_id", "session_id", F.col("final_decision").alias("new")).join(old, "item_id").where(~F.col("old").eqNullSafe(F.col("new")))


def counter_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    step = lambda d: F.sum((F.col("new") == d).cast("int") - (F.coalesce(F.col("old"), F.lit("")) == d).cast("int"))
    return _changes(before, after).groupBy("session_id").agg(step("approved").alias("approved"), step("rejected").alias("rejected"))


def export_actions(before: DataFrame, after: DataFrame) -> DataFrame:
    action = F.when((F.col("old") == "rejected") & (F.col("new") == "approved"), "copy").when((F.col("old") == "approved") & (F.col("new") == "rejected"), "remove").otherwise("none")
    return _changes(before, after).select("item_id", action.alias("action"))


def resume(results: DataFrame, option: str, batch_start: int = 0) -> DataFrame:
    """Results (with their index) that stay: all, those before the current batch, or none."""
    keep = {"continue": F.lit(True), "restart_batch": F.col("index") < batch_start, "fresh_start": F.lit(False)}
    if option not in keep:
        raise ValueError(f"unknown option: {option}")
    return results.where(keep[option])


def resume_sessions(sessions: DataFrame, results: DataFrame, checkpoints: DataFrame, option: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and results after resumption from checkpoints (session_id, processed_count, batch_start, at most one a session).

    ``results`` have their index within the session. continue keeps all of them, restart_batch those before the batch, fresh_start none. Sessions with a checkpoint
    run again without an error message; unless they continue, their counters are those of the results that stay. Others don't change.
    """
    start = {"continue": F.lit(None).cast("long"), "restart_batch": F.col("batch_start").cast("long"), "fresh_start": F.lit(0).cast("long")}
    if option not in start:
        raise ValueError(f"unknown option: {option}")
    points = checkpoints.select(F.col("session_id").alias("_id"), start[option].alias("_start"), F.lit(True).alias("_again"))
    kept = results.join(points, results.session_id == points["_id"], "left").where(F.col("_start").isNull() | (F.col("index") < F.col("_start"))).drop("_id", "_start", "_again")
    found = sessions.join(points, sessions.id == points["_id"], "left").drop("_id", "_start")
    again = F.coalesce("_again", F.lit(False))
    found = found.withColumns({"status": F.when(again, "running").otherwise(F.col("status")), "error_message": F.when(~again, F.col("error_message"))})
    if option == "continue":
        return found.drop("_again"), kept
    names = ("processed_images", "approved_images", "rejected_images")
    counted = update_counters(found.where("_again"), kept.join(points.select(F.col("_id").alias("session_id")), "session_id", "left_semi"))
    return found.where(~again).unionByName(counted.select(*(F.col(c).cast(found.schema[c].dataType).alias(c) if c in names else c for c in found.columns))).drop("_again"), kept


def update_counters(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Session counters counted again from the results."""
    c = results.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("processed_images"), F.count_if(F.col("final_decision") == "approved").alias("approved_images"), F.count_if(F.col("final_decision") == "rejected").alias("rejected_images"))
    return sessions.drop("processed_images", "approved_images", "rejected_images").join(c, "id", "left").na.fill(0, ["processed_images", "approved_images", "rejected_images"])


def start_sessions(projects: DataFrame, sessions: DataFrame, counts: DataFrame) -> DataFrame:
    """project_id, session_id, reused, total_images: an open session of the project, else a new one named by a hash."""
    live = sessions.where(F.col("status").isin("running", "created")).groupBy("project_id").agg(F.max("id").alias("open_id"))
    df = projects.select(F.col("id").alias("project_id")).join(live, "project_id", "left").join(counts, "project_id", "left")
    fresh = F.concat(F.lit("new-"), F.substring(F.sha2(F.col("project_id").cast("string"), 256), 1, 12))
    return df.select("project_id", F.coalesce(F.col("open_id").cast("string"), fresh).alias("session_id"), F.col("open_id").isNotNull().alias("reused"), F.coalesce("total_images", F.lit(0)).alias("total_images"))


def set_status(sessions: DataFrame, action: str, chosen: Column | None = None) -> DataFrame:
    """pause acts on running sessions, resume on paused and failed ones; others stay."""
    chosen = F.lit(True) if chosen is None else chosen
    old, new = {"pause": (["running"], "paused"), "resume": (["paused", "failed"], "running")}[action]
    return sessions.withColumn("status", F.when(chosen & F.col("status").isin(*old), new).otherwise(F.col("status")))


def delete_sessions(sessions: DataFrame, gone: DataFrame, *children: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without the sessions of ``gone`` (id) and what belongs to them by session_id."""
    ids = gone.select(F.col("id").alias("session_id"))
    return sessions.join(gone, "id", "left_anti"), *(c.join(ids, "session_id", "left_anti") for c in children)


def purge_sessions(sessions: DataFrame, *children: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, ...]:
    old = sessions.where((F.col("status") == "completed") & (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS")))
    return delete_sessions(sessions, old.select("id"), *children)


def review_table(spark: SparkSession, path: str, reviews: DataFrame, by: str = "session_id") -> int:
    """Reviews in a results table in place: only partitions with a reviewed item are written again; their number."""
    return change_table(spark, path, by, reviews, ["item_id"], lambda rows: review(rows, reviews).select(*rows.columns))


def purge_table(spark: SparkSession, path: str, gone: DataFrame, by: str = "session_id") -> int:
    """Removes the rows of sessions (id) from a results or checkpoints table in place; the number of partitions that changed."""
    ids = gone.select(F.col("id").alias("session_id"))
    return change_table(spark, path, by, ids, ["session_id"], lambda rows: rows.join(ids, "session_id", "left_anti").select(*rows.columns))


def set_status_table(spark: SparkSession, path: str, action: str, chosen: DataFrame, by: str) -> int:
    """Pauses or resumes the chosen sessions (id) in place; the number of partitions that changed."""
    mine = chosen.select("id").distinct().withColumn("_chosen", F.lit(True))

    def change(rows: DataFrame) -> DataFrame:
        marked = rows.join(mine, "id", "left")
        return set_status(marked, action, F.coalesce(F.col("_chosen"), F.lit(False))).select(*rows.columns)

    return change_table(spark, path, by, chosen, ["id"], change)
