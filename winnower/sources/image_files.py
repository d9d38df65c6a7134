"""A Spark data source of image files: rows (path, content) are written as one file each, and read back with their length.

Paths are relative to the root. Files are reached through ``pyarrow.fs``, so the root may lie on any store that it knows (a mounted
folder, HDFS, object stores); the executors write and read, the driver only lists names. A written file is complete or absent: it is
made under a hidden name and renamed, and a task that runs again writes the same files again. ``_SUCCESS`` marks a finished write.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "image_files"


def _store(root: str):
    from pyarrow import fs

    if "://" not in root and root.startswith("file:"):
        root = "file://" + root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


@dataclass
class Files(InputPartition):
    """Some files with their lengths."""

    names: list[str]
    lengths: list[int]


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class ImageFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content = options["path"], options.get("content", "true").lower() == "true"
        self.endings = tuple(x for x in options.get("endings", "").split(",") if x)
        self.most = int(options.get("partition_bytes", 32 << 20))

    def partitions(self) -> list[Files]:
        """Files in the order of names, in runs of about ``partition_bytes``; a file counts as 4 KB at least. Hidden names and marks are left out."""
        from pyarrow import fs

        store, root = _store(self.root)
        found = sorted((x.path[len(root.rstrip("/")) + 1 :], x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File)
        out, size = [], 0
        for name, length in found:
            if any(p[:1] in ("_", ".") for p in name.split("/")) or self.endings and not name.endswith(self.endings):
                continue
            if not out or size >= self.most:
                out, size = [*out, Files([], [])], 0
            out[-1].names.append(name)
            out[-1].lengths.append(length)
            size += max(length, 4096)
        return out or [Files([], [])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.root)
        names, lengths, contents, size = [], [], [], 0
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        for name, length in zip(part.names, part.lengths, strict=True):
            if self.content:
                with store.open_input_stream(f"{root}/{name}") as f:
                    contents.append(f.read())
            else:
                contents.append(None)
            names.append(name)
            lengths.append(length)
            size += length if self.content else 64
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())], schema=schema)
                names, lengths, contents, size = [], [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())], schema=schema)


class ImageFilesWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        if overwrite:
            raise ValueError("image files are only added: choose a fresh root instead of overwriting")

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.root)
        n = size = 0
        made: set[str] = set()
        for row in rows:
            name = row["path"]
            if not name or name.startswith("/") or any(p in ("", ".", "..") or p[0] in "_." for p in name.split("/")):
                raise ValueError(f"not a relative path of visible names: {name!r}")
            folder, _, leaf = f"{root}/{name}".rpartition("/")
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            hidden, content = f"{folder}/.{uuid.uuid4().hex}", bytes(row["content"] or b"")
            with store.open_output_stream(hidden) as f:
                f.write(content)
            store.move(hidden, f"{folder}/{leaf}")
            n, size = n + 1, size + len(content)
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(f"{sum(m.files for m in messages if m)} files, {sum(m.size for m in messages if m)} bytes\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Whole files of finished tasks stay, without the mark; the next attempt replaces them."""


class ImageFiles(DataSource):
    """Options: path (the root); for reading, endings (comma-separated, all if empty), content (false: names and lengths alone), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> ImageFilesReader:
        return ImageFilesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ImageFilesWriter:
        return ImageFilesWriter(dict(self.options), overwrite)


def write_image_files(files: DataFrame, root: str) -> None:
    """One file for each row (path, content) of ``files``; a null content makes an empty file."""
    files.sparkSession.dataSource.register(ImageFiles)
    files.select("path", F.length("content").cast("long").alias("length"), "content").write.format(FORMAT).mode("append").option("path", root).save()


def read_image_files(spark: SparkSession, root: str, endings: str = "", content: bool = True) -> DataFrame:
    """path, length and content of the files below ``root``; a missing root is an error."""
    spark.dataSource.register(ImageFiles)
    return spark.read.format(FORMAT).option("path", root).option("endings", endings).option("content", str(content).lower()).load()


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An 8-bit PNG of BGR (or gray) bytes, stored without compression, so that its length follows from the size alone."""
    step = width * channels
    lines = [data[k * step : (k + 1) * step] for k in range(height)]
    if channels == 3:
        lines = [bytes(b for k in range(0, step, 3) for b in line[k : k + 3][::-1]) for line in lines]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines), 0)) + chunk(b"IEND", b"")


def encode_png(images: DataFrame) -> DataFrame:
    """``images`` (height, width, channels, data) with the PNG bytes as column content."""

    @F.pandas_udf("binary")
    def encoded(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([png(int(h), int(w), int(c), bytes(d)) for h, w, c, d in zip(height, width, channels, data, strict=True)])

    return images.withColumn("content", encoded("height", "width", "channels", "data"))
