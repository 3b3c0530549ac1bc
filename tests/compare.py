"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    """Values in one form on both sides."""
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return bytes(value) if isinstance(value, bytearray) else value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return connection


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    found = connection.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(row[i]) for i in order) for row in found.fetchall())


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())


def difference(spark: SparkSession, query, sql: str, sf_dir: str) -> str:
    """Empty if both sides have the same columns and rows."""
    (names, rows), (other_names, other) = spark_rows(query(spark, sf_dir)), sql_rows(duck(sf_dir), sql)
    if names != other_names:
        return f"columns {names} and {other_names}"
    if rows != other:
        return f"{rows.total()} and {other.total()} rows; only Spark: {list((rows - other).items())[:3]}; only SQL: {list((other - rows).items())[:3]}"
    return ""
