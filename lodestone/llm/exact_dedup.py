"""Exact dedup by two-pass Bloom filtering.

Pass 1 builds a bounded filter of hashes that may occur more than once; pass 2 sends only the rows that it lets through to
the shuffle that compares full digests. All other rows are unique for certain and pass straight through.

Defined results: null text counts as empty; empty and all-blank texts are equal to each other; ties of length go to the
smallest doc_id (null last); a row repeated with its doc_id counts once for each copy, and only the doc_id decides which one
stays, so that both copies say kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filter_log2, repeated_filter, slices, text_rows

BLANKS = b" \t\n\x0b\x0c\r"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_points (code points of the text), h (64 bits of the digest), digest (SHA-256 of the text without blanks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            keys = [hashlib.sha256(t.encode().translate(None, BLANKS)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), pa.array(keys, pa.binary())],
                ["doc_id", "n_points", "h", "digest"],
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_points long, h long, digest binary")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = cut(digests(docs))
    seen = spark.sparkContext.broadcast(repeated_filter(rows.select("h"), filter_log2(rows.count())))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = seen.value.has(batch.column(2).to_numpy(zero_copy_only=False).view("uint64"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], [*batch.schema.names, "maybe"])

    tested = rows.mapInArrow(test, "doc_id long, n_points long, h long, digest binary, maybe boolean")
    passing = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    compared = tested.filter("maybe")
    best = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = cut(compared.groupBy("digest").agg(F.min(best)["doc_id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    held = compared.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return passing.unionByName(held)
