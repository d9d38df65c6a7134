"""Sources and sinks (S-01 to S-11): image trees, digests, manifests, JSON columns, exports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.functions.exprs import col
from winnower.sources.image_files import read_image_files

#: Fixed value: the file endings that count as images.
EXTENSIONS = ["jpg", "jpeg", "png", "JPG", "JPEG", "PNG"]
PATTERN = "*.{" + ",".join(EXTENSIONS) + "}"


def _read(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """A reader of its own session, in which a small file counts as 64 KB: Spark's 4 MB make a task of every 32 files."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", 64 << 10)
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of the files with an image ending; contents are not read."""
    return _read(spark, "binaryFile", root).load(root).select("path", "length", "modificationTime")


def scan_images(spark: SparkSession, root: str, drop_invalid: bool = True) -> DataFrame:
    """Decoded images with item_id (the path), size, height, width, channels and BGR data, in the order of paths.

    Empty and undecodable files are left out; a missing root is an error of the read.
    """
    images = _read(spark, "image", root).option("dropInvalid", str(drop_invalid).lower()).load(root).select("image.*")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("origin")  # noqa: E731  the two sources write local paths differently
    files = list_files(spark, root).select(plain("path"), "length")
    return images.select(plain("origin"), "height", "width", "nChannels", "data").join(files, "origin").select(F.col("origin").alias("item_id"), F.col("length").alias("file_size"), "height", "width", F.col("nChannels").alias("channels"), "data").orderBy("item_id")


def input_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root) and length of all files with an image ending, empty and undecodable ones too; contents aren't read."""
    return read_image_files(spark, root, ",".join(f".{x}" for x in EXTENSIONS), content=False).select("path", "length")


def count_inputs(spark: SparkSession, root: str) -> int:
    """Number of files with an image ending that hold something, decodable or not; 0 if the folder is missing. Spark lists no empty files."""
    try:
        return list_files(spark, root).count()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise


def count_by_folder(spark: SparkSession, root: str) -> DataFrame:
    """folder (the first part of the path below the root), n_files and bytes of all files with an image ending, empty ones too; contents aren't read."""
    files = read_image_files(spark, root, ",".join(f".{x}" for x in EXTENSIONS), content=False)
    return files.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def image_metadata(images: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """item_id, filename, lower-case extension, sizes and channels of scanned images, with tag maps where given."""
    name = file_name("item_id")
    df = images.select("item_id", name.alias("filename"), F.lower(F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).alias("extension"), "file_size", "width", "height", "channels")
    return df if tags is None else df.join(tags, "item_id", "left")


def content_digest(content: str | Column, algo: str = "sha256") -> Column:
    if algo not in ("md5", "sha256"):
        raise ValueError(f"unknown digest: {algo}")
    return F.md5(col(content)) if algo == "md5" else F.sha2(col(content), 256)


def manifest_build(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("path"), content_digest(content).alias("digest"))


def manifest_verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path and state ok, changed, missing or new; new counts as good."""
    now = files.select("path", F.col("digest").alias("now"))
    both = manifest.join(now, "path", "full")
    state = F.when(F.col("digest").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("digest") == F.col("now"), "ok").otherwise("changed")
    return both.select("path", state.alias("state"), state.isin("ok", "new").alias("good"))


def verify_copies(src: DataFrame, dst: DataFrame) -> DataFrame:
    """path and whether digest and size of the copy agree with the source's."""
    copy = dst.select("path", F.col("digest").alias("d2"), F.col("length").alias("l2"))
    return src.join(copy, "path", "left").select("path", (F.col("digest").eqNullSafe(F.col("d2")) & F.col("length").eqNullSafe(F.col("l2"))).alias("good"))


def decode_results(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """The JSON column as a struct; malformed JSON is null and its row stays."""
    return raw.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def decode_variants(raw: DataFrame, column: str) -> DataFrame:
    """The JSON column as a variant, whatever its shape; malformed JSON is null and its row stays."""
    return raw.withColumn(column, F.try_parse_json(column))


def variant_fields(column: str | Column, fields: Mapping[str, tuple[str, str]]) -> list[Column]:
    """Columns from a variant: name to (JSON path, type); null where the path is missing or the value doesn't fit."""
    return [F.try_variant_get(col(column), path, kind).alias(name) for name, (path, kind) in fields.items()]


def merged_schema(decoded: DataFrame, column: str, *by: str) -> DataFrame:
    """The schema that all variants of a column (of each group) fit, types merged."""
    return decoded.groupBy(*by).agg(F.schema_of_variant_agg(column).alias("schema"))


def failed_result(message: str | Column) -> dict[str, Column]:
    """Decision and reasons of an item whose processing failed."""
    return {"final_decision": F.lit("rejected"), "reasons": F.array(F.concat(F.lit("Processing error: "), col(message)))}


_LEDGER = "batch string, attempt string, n_rows long, digest decimal(38,0)"


def _digest(rows: DataFrame) -> tuple[int, object]:
    """Number of rows and the sum of their hashes, which doesn't hang on their order; 0 without rows."""
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(c for c in rows.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a results table: batch, attempt, n_rows and digest of every batch that was committed."""
    try:
        return spark.read.schema(_LEDGER).json(f"{path}/_ledger/*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _LEDGER)
        raise


#: Fixed value: the folders that the sessions of a batch are dealt to.
BUCKETS = 32


def _bucket(session_id: Column) -> Column:
    """The folder of a session."""
    return F.concat(F.lit("s-"), F.pmod(F.xxhash64(session_id.cast("string")), F.lit(BUCKETS)).cast("string"))


def save_results(results: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds the rows below one of ``BUCKETS`` folders by session, as a batch that is visible as a whole or not at all; whether it was new.

    Rows go to a folder of this attempt. The batch then counts by one small file of the ledger, whose folder bears its name and can only be made
    once: a job that dies before leaves rows that nobody reads, and a batch that is saved again changes nothing (an error if its
    rows differ). Without a name every call is a batch of its own.
    """
    spark, batch, attempt = results.sparkSession, batch or uuid.uuid4().hex, uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    known = committed(spark, path).where(F.col("batch") == batch).first()
    if known is None:
        target = f"{path}/data/batch=b-{batch}/attempt=a-{attempt}"  # never digits alone, which would come back as numbers
        # A folder's rows come from one task: files don't grow with the number of sessions or of tasks.
        results.withColumn("_bucket", _bucket(F.col("session_id"))).repartition(BUCKETS, "_bucket").write.partitionBy("_bucket").parquet(target)
        n, digest = _digest(spark.read.schema(results.schema).parquet(target).select(*results.columns))
        entry = spark.createDataFrame([(batch, attempt, n, digest)], _LEDGER)
        try:
            entry.coalesce(1).write.mode("errorifexists").json(f"{path}/_ledger/batch-{batch}")
            return True
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
        known = committed(spark, path).where(F.col("batch") == batch).first()  # another attempt was first
    if (known["n_rows"], known["digest"]) != _digest(results):
        raise ValueError(f"batch {batch} was committed with other rows")
    return False


def load_results(spark: SparkSession, path: str, session_id: int | None = None) -> DataFrame:
    """Rows of committed batches; a session's rows come from its folder of each batch alone, and attempts that the ledger doesn't name aren't read."""
    ledger = committed(spark, path).select("batch", "attempt")
    df = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    df = df if session_id is None else df.where((F.col("_bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
    named = ledger.select(F.concat(F.lit("b-"), "batch").alias("batch"), F.concat(F.lit("a-"), "attempt").alias("attempt"))
    return df.join(named, ["batch", "attempt"], "left_semi").drop("batch", "attempt", "_bucket")


def export_rows(results: DataFrame) -> DataFrame:
    """The columns of the CSV export, all text or numbers."""
    return results.select(
        "filename", "source_folder", "final_decision", F.array_join("reasons", "; ").alias("rejection_reasons"), F.coalesce("overall", F.lit(0.0)).alias("quality_score"),
        "human_override", "processing_time", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def export_csv(results: DataFrame, path: str) -> None:
    export_rows(results).write.mode("overwrite").option("header", "true").csv(path)


def export_json_rows(results: DataFrame) -> DataFrame:
    """item_id and the JSON record of each item with its nested quality."""
    record = F.struct("filename", F.col("final_decision").alias("decision"), "reasons", F.struct("overall", "sharpness", "noise").alias("quality"))
    return results.select("item_id", F.to_json(record).alias("record"))


def export_json(results: DataFrame, path: str) -> None:
    """Records below ``items``, and below ``summary`` the summary of each session."""
    from winnower.operators.aggregates import session_summary

    export_json_rows(results).select("record").write.mode("overwrite").text(f"{path}/items")
    session_summary(results).write.mode("overwrite").json(f"{path}/summary")


def export_partitioned(planned: DataFrame, path: str) -> None:
    """Rows below the folder that each is assigned to."""
    planned.write.mode("overwrite").partitionBy("folder").parquet(path)
