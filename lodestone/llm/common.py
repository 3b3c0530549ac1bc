"""What the training-data operators share: tables, lineage cuts and a bounded Bloom filter."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all of it runs on one machine a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A user's column by its very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and nothing else, so that extra columns can't clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and n + 1 offsets into it (no copy of the text for ordinary arrays)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Bloom:
    """Bits of a Bloom filter of 2**log2 bits with three probes, as bytes that tasks can read."""

    PAGE = 8192  # bytes

    def __init__(self, log2: int, bits: np.ndarray | None = None):
        self.log2, self.bits = log2, np.zeros(1 << (log2 - 3), np.uint8) if bits is None else bits

    def probes(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = h.astype(np.uint64, copy=False)
        step = (h >> np.uint64(33)) | np.uint64(1)
        for i in range(3):
            at = (h + np.uint64(i) * step) & np.uint64((1 << self.log2) - 1)
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at, bit in self.probes(h):
            found &= (self.bits[at] & bit) != 0
        return found

    def add(self, h: np.ndarray) -> None:
        for at, bit in self.probes(h):
            np.bitwise_or.at(self.bits, at, bit)


#: The broadcast filter is never larger than 2**MOST_LOG2 bits (64 MB). On more keys it only lets more unique ones through; results don't change.
MOST_LOG2 = 29


def filter_log2(n: int, bits_each: int = 12) -> int:
    return min(MOST_LOG2, max(16, int(np.ceil(np.log2(max(1, n) * bits_each)))))


def repeated_filter(hashes: DataFrame, log2: int, least: int = 2) -> Bloom:
    """First pass of two-pass Bloom filtering: a filter of all values that may occur ``least`` (1 or 2) times or more in ``hashes`` (one LONG column h, not null).

    Every task keeps a filter of what it has seen and one of what it has seen again, and sends the touched pages of both,
    compressed. Merging ORs the "again" pages and what two tasks have both seen. The driver gets at most 2**log2 bits.
    """
    page = Bloom.PAGE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(log2), Bloom(log2)
        for batch in batches:
            h = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            first, counts = np.unique(h, return_counts=True)
            if least > 1:
                twice.add(first[(counts > 1) | once.has(first)])
            once.add(first)
        a, b = once.bits.reshape(-1, min(page, len(once.bits))), twice.bits.reshape(-1, min(page, len(once.bits)))
        for i in np.flatnonzero(a.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([zlib.compress(a[i].tobytes(), 1)], pa.binary()), pa.array([zlib.compress(b[i].tobytes(), 1) if b[i].any() else b""], pa.binary())], ["page", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        once = twice = None
        for o, t in zip(rows["once"].to_pylist(), rows["twice"].to_pylist(), strict=True):
            o = np.frombuffer(zlib.decompress(o), np.uint8)
            once, twice = (np.zeros_like(o), np.zeros_like(o)) if once is None else (once, twice)
            twice = twice | (once & o)
            once = once | o
            if t:
                twice = twice | np.frombuffer(zlib.decompress(t), np.uint8)
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "twice": pa.array([zlib.compress((twice if least > 1 else once).tobytes(), 1)], pa.binary())})

    # written first: the pages of all tasks are then read in a few parts, not by a job for each task
    pages = cut(hashes.mapInArrow(scan, "page int, once binary, twice binary").groupBy("page").applyInArrow(merge, "page int, twice binary"))
    out = Bloom(log2)
    for row in pages.toLocalIterator():
        bits = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        out.bits[row["page"] * page : row["page"] * page + len(bits)] = bits
    drop(pages)
    return out
