"""Releases: tables as CSV with their dictionary and inventory, which readers see whole or not at all.

The schema is the source of everything: its columns are the files' columns, and type, nullability and the ``comment`` of a
column's metadata are its rows of the dictionary. All is written to a folder of its own first; digests and row counts of what was
written make the inventory; then one small file, renamed over the one before, says which folder is the release. A reader
gets the old or the new release; a run that fails leaves a folder that nothing names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .files import csv_line

MARK = "\ufeff"
DICTIONARY = ("table", "column", "description", "type", "nullable")
INVENTORY = ("path", "bytes", "sha256", "rows")


def dictionary(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row for each column of each table."""
    rows = [(name, f.name, f.metadata.get("comment", ""), f.dataType.simpleString(), str(f.nullable).lower()) for name, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in DICTIONARY))


def write_marked(df: DataFrame, path: str) -> None:
    """CSV files that each begin with a byte order mark and the header, every cell quoted, CRLF ends; nulls are empty cells."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([MARK + header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines = df.select(csv_line(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("value"))
    lines.mapInArrow(headed, "value string").write.text(path, lineSep="\r\n")


def read_marked(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as they were written."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False, nullValue="\u0000", emptyValue="", lineSep="\r\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def inventory(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """path (below the folder), bytes, sha256 and rows of every file of the tables."""
    out = None
    for name in tables:
        below = lambda c, name=name: F.concat(F.lit(f"{name}/"), F.regexp_extract(c, r"[^/]+$", 0))
        bytes_ = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
        sizes = bytes_.select(below(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        rows = read_marked(spark, f"{folder}/{name}").groupBy(below(F.input_file_name()).alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        found = sizes.join(rows, "path", "left").na.fill(0, ["rows"])
        out = found if out is None else out.unionByName(found)
    return out


def publish(tables: Mapping[str, DataFrame], path: str, version: str) -> str:
    """Write a release and make it the current one; the folder that it is in.

    A version that is out is not published again.
    """
    spark = next(iter(tables.values())).sparkSession
    now = current(spark, path)
    if now and version in now["versions"]:
        raise ValueError(f"version {version} is out")
    folder = f"{path}/releases/{version}-{uuid.uuid4().hex}"
    whole = {**tables, "data_dictionary": dictionary(spark, tables).coalesce(1)}
    for name, df in whole.items():
        write_marked(df, f"{folder}/{name}")
    write_marked(inventory(spark, folder, list(whole)).select(*INVENTORY).coalesce(1), f"{folder}/inventory")
    store.swap(spark, f"{path}/current.json", json.dumps({"version": version, "folder": folder, "versions": [*(now["versions"] if now else []), version]}))
    return folder


def current(spark: SparkSession, path: str) -> dict | None:
    found = store.read_text(spark, f"{path}/current.json")
    return json.loads(found) if found else None


def read_release(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the current release, as text; fails if there is none or if files of it have another size than its inventory says."""
    now = current(spark, path)
    if not now:
        raise ValueError(f"no release in {path}")
    if table != "inventory":
        listed = read_marked(spark, f"{now['folder']}/inventory").filter(F.startswith("path", F.lit(f"{table}/"))).select("path", "bytes")
        want = {r["path"]: int(r["bytes"]) for r in listed.collect()}  # one row for each file, as Spark itself lists them
        held = {f"{table}/{f.path.rpartition('/')[2]}": f.bytes for f in store.data_files(spark, f"{now['folder']}/{table}")}
        if want != held:
            raise ValueError(f"files of {table} aren't those of the inventory")
    return read_marked(spark, f"{now['folder']}/{table}")
