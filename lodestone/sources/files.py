"""Files as tables and back: CSV, JSON lines, JSON documents, inventories with digests; and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def shared_root(spark: SparkSession) -> str:
    """Where driver and executors share files (spark.checkpoint.dir); only where none is named, a folder on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_root(spark)}/{kind}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that lineage ends."""
    path = shared_folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """RFC 4180 with a header: quoted line ends, doubled quotes, a byte order mark. Empty cells are empty strings, rows of empty cells only go."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    texts = [f.name for f in schema if f.dataType.typeName() == "string"]
    return df.dropna("all").na.fill("", texts)


def write_csv(df: DataFrame, path: str, columns: list[str], quote_all: bool = False) -> None:
    """The given columns (missing ones empty, others left out), CRLF ends."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cells).write.csv(path, header=True, lineSep="\r\n", emptyValue='""' if quote_all else "", quoteAll=quote_all, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def csv_line(*cells: F.Column) -> F.Column:
    """One row as text, every cell quoted."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    return F.concat_ws(",", *quoted)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line; blank lines are skipped, lines that don't parse are an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def docstore_articles(document: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Articles of a map of nodes (key -> struct with key, law, kind, article, text): those of kind article or none, the first of each key."""
    rows = document.select(F.posexplode(nodes).alias("ord", "id", "node")).filter("node.kind IS NULL OR node.kind = '조문'")
    first = Window.partitionBy("node.key").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("id", "node.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def write_partitioned(df: DataFrame, path: str, by: str, order: list[str]) -> None:
    """A table in folders by a column; each file sorted, so that readers of one group skip the rest."""
    df.repartition(by).sortWithinPartitions(by, *order).write.partitionBy(by).mode("overwrite").parquet(path)
