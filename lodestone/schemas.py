"""Tables and their schemas. Text that is missing is the empty string; null means "not stated" in tri-state and parsed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

CASES = StructType([StructField(c, StringType()) for c in ("accnum", "claim_year", "approval_status", "occupation", "occupation_std", "hazards", "summary", "approval_mismatch", "n_measurements")])
CHUNKS = StructType(
    [StructField(c, StringType()) for c in ("chunk_id", "document_id", "document_title", "domain")]
    + [StructField("chunk_index", IntegerType()), StructField("heading_path", ArrayType(StringType())), StructField("text", StringType()), StructField("source_pages", ArrayType(IntegerType())), StructField("previous_chunk_id", StringType()), StructField("next_chunk_id", StringType())]
)
EVENT = StructType([StructField("t", LongType()), StructField("action", StringType()), StructField("item", StringType()), StructField("rank", IntegerType()), StructField("query", StringType()), StructField("shown", ArrayType(StringType()))])
EVENT_BATCHES = StructType(
    [StructField("version", IntegerType()), StructField("session", StringType()), StructField("seq", IntegerType()), StructField("received", TimestampType()), StructField("conditions", MapType(StringType(), StringType())), StructField("events", ArrayType(EVENT))]
)
CHARGES = StructType([StructField("id", StringType()), StructField("provider", StringType()), StructField("started", StringType()), StructField("finished", StringType()), StructField("amount", LongType()), StructField("reserved", LongType())])
CODES = StructType([StructField(c, StringType()) for c in ("record_id", "axis", "std", "std_version", "code", "label")] + [StructField("level", IntegerType()), StructField("parent_code", StringType())])
DETECTIONS = StructType([StructField("image", StringType()), StructField("idx", IntegerType()), StructField("box", ArrayType(DoubleType())), StructField("conf", DoubleType()), StructField("keep", BooleanType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_text(df: DataFrame) -> DataFrame:
    """Null text cells as empty strings, which is what a missing value is."""
    return df.na.fill("")


def struct_from_dictionary(dictionary: list[dict]) -> StructType:
    """A schema from rows of a data dictionary (column, type, nullable)."""
    types = {"string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType(), "datetime": TimestampType()}
    return StructType([StructField(d["column"], types[d.get("type", "string")], d.get("nullable", True)) for d in dictionary])


def require_columns(df: DataFrame, columns: set[str]) -> DataFrame:
    if missing := columns - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df


def typed_cell(c: F.Column) -> dict[str, F.Column]:
    """What a text cell looks like: empty, true/false, a number with or without a point, or text."""
    kind = F.when(c == "", "empty").when(c.isin("True", "False"), "boolean").when(c.contains(".") & c.try_cast("double").isNotNull(), "float").when(c.try_cast("bigint").isNotNull(), "integer").otherwise("text")
    return {"kind": kind, "integer": F.when(kind == "integer", c.try_cast("bigint")), "float": F.when(kind == "float", c.try_cast("double")), "boolean": F.when(kind == "boolean", c == "True")}
