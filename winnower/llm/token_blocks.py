"""Texts as blocks of token numbers, for operators that go over the corpus more than once.

A block is one row: about half a million tokens of whole texts, as numbers into the block's own dictionary of 64-bit
token hashes, most frequent first. Texts are read, split and hashed once; the table of blocks is a third of
their size. A text above the bound makes a block of its own, so a task's memory follows the longest text.

Arrays travel as byte planes (all lowest bytes, then all second ones …): small numbers and the steps between sorted
hashes then leave most planes zero, which Spark's compression removes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnower.llm import textbytes as tb
from winnower.llm.shared import shared_path, small_batches

#: (token hashes, starts and ends of tokens in the bytes or -1, number of tokens of each text)
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

_COMMON = "block long, shard int, lengths binary, ids binary, hashes binary, words binary"


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as planes of their differences."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint64), dtype=np.uint64)


def _packed(pending: list, keys: list[str], block: int, shards: int, with_words: bool, schema: pa.Schema) -> pa.RecordBatch:
    datas, tokens, columns = zip(*pending)
    h = np.concatenate([t[0] for t in tokens])
    lengths = np.concatenate([t[3] for t in tokens]).astype(np.int32)
    u, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(u), np.int32)
    rank[order] = np.arange(len(u), dtype=np.int32)
    words = b""
    if with_words:
        shift = np.cumsum([0, *map(len, datas[:-1])])
        starts = np.concatenate([t[1] + s for t, s in zip(tokens, shift)])[first[order]]
        sizes = np.concatenate([t[2] - t[1] for t in tokens])[first[order]]
        text = np.concatenate(datas).tobytes()
        words = b"\n".join([text[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())])
    lists = [pa.concat_arrays([c[k] for c in columns]) for k in range(len(keys))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    row = [pa.array([block]), pa.array([block % shards], pa.int32()), *(pa.array([b], pa.binary()) for b in (planes(lengths), planes(rank[inverse]), u[order].tobytes(), words)), *lists]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(row, schema)], schema=schema)


def write_blocks(docs: DataFrame, keys: list[str], tokenise: Callable[[np.ndarray, np.ndarray], Tokens], name: str, shards: int = 1, size: int = 1 << 19, with_words: bool = False) -> tuple[str, str]:
    """Path and schema of the written blocks of ``docs`` (the key columns and text), below one folder per shard.

    Blocks are dealt to the shards in turn; ``tokenise`` gets lower-cased bytes. The key columns become arrays with an entry for each text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = dict(docs.dtypes)
    schema = _COMMON + "".join(f", {k} array<{kinds[k]}>" for k in keys)
    arrow = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((x, pa.binary()) for x in ("lengths", "ids", "hashes", "words")), *((k, pa.list_({"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[kinds[k]])) for k in keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, pending, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for lo, hi, data, bounds in tb.chunks(batch.column(len(keys))):
                data = tb.LOWER[data]
                tokens = tokenise(data, bounds)
                pending.append((data if with_words else data[:0], tokens, [batch.column(k).slice(lo, hi - lo) for k in range(len(keys))]))
                n += len(tokens[0]) + hi - lo
                if n >= size:
                    yield _packed(pending, keys, (part << 32) + part + made, shards, with_words, arrow)
                    pending, n, made = [], 0, made + 1
        if pending:
            yield _packed(pending, keys, (part << 32) + part + made, shards, with_words, arrow)

    path = shared_path(spark, name)
    blocks = docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    blocks.write.partitionBy("shard").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return path, schema


def read_blocks(spark: SparkSession, written: tuple[str, str], *columns: str) -> DataFrame:
    """The blocks; an empty table has no files, hence the schema."""
    return spark.read.schema(written[1]).parquet(written[0]).select(*columns)


def slot_bits(slots: DataFrame, bits: int) -> np.ndarray:
    """Bit array of 2**bits bits (as bytes) with the bits of column ``slot`` set: all that the driver gets, whatever the rows.

    Rows are made distinct and packed in groups of 65,536 neighbouring slots, by tasks; the array holds one such group at least.
    """
    page = F.shiftright("slot", 16).cast("int").alias("page")
    pages = slots.select(F.col("slot").cast("int").alias("slot")).distinct().select(page, "slot")

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, bool)
        own[table["slot"].to_numpy() & 0xFFFF] = True
        return pa.table({"page": table["page"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << max(16, bits) - 3, np.uint8)
    for r in pages.groupBy("page").applyInArrow(pack, "page int, bits binary").collect():
        out[r.page << 13 : (r.page + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return out


def bit_at(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
