"""Small files and listings on whatever store Spark reads: through its file systems, from the driver."""

from __future__ import annotations

import hashlib
import re
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class File(NamedTuple):
    path: str
    bytes: int
    changed: int


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store, as libraries other than Hadoop's take it."""
    at, fs = _at(spark, path)
    uri = re.sub("^file:/+", "file:///", at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().toString())
    return re.sub("^s3[an]:", "s3:", uri)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it isn't there."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def data_files(spark: SparkSession, path: str) -> list[File]:
    """The data files below a path (not those that begin with _ or a dot), sorted; a file is its own listing."""
    at, fs = _at(spark, path)
    found, each = [], fs.listFiles(at, True)
    while each.hasNext():
        one = each.next()
        if one.getPath().getName()[0] not in "_.":
            found.append(File(one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return sorted(found)


def listing_digest(files: list[File], changed: bool = True) -> str:
    """Of names, sizes and, unless the files are known never to be replaced, times."""
    lines = "".join(f"{f.path.rpartition('/')[2]}\t{f.bytes}\t{f.changed if changed else ''}\n" for f in files)
    return hashlib.sha256(lines.encode()).hexdigest()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(fs, at, text: str) -> None:
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _rename(spark: SparkSession, fs, a, b, *how: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, len(how))
    for i, name in enumerate(how):
        options[i] = jvm.Options.Rename.valueOf(name)
    jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(a, b, options)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, or leave the one that is there: written aside, then renamed where nothing is yet. False if it was there."""
    at, fs = _at(spark, path)
    aside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    if fs.exists(at):
        return False
    _write(fs, aside, text)
    try:
        _rename(spark, fs, aside, at)  # fails where a file is
        return True
    except Exception:
        fs.delete(aside, False)
        if fs.exists(at):
            return False
        raise


def swap(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in the place of the one that is there, if any: readers see the one or the other."""
    at, fs = _at(spark, path)
    aside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    _write(fs, aside, text)
    _rename(spark, fs, aside, at, "OVERWRITE")
