"""Checks of data: evidence in its source, validation with reasons, keys and constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squash

#: Relations that a task joins and sorts at once, about.
PART = 500_000


def ungrounded(quotes: DataFrame, sources: DataFrame, on: str, quote: str, text: str) -> DataFrame:
    """Quotes whose source doesn't hold them (white space and forms aside), or that have no source."""
    joined = quotes.join(sources.select(on, F.col(text).alias("_text")), on, "left")
    held = F.coalesce(F.contains(squash(F.col("_text")), squash(F.col(quote))), F.lit(False))
    return joined.withColumn("_held", held).filter("NOT _held").drop("_text", "_held")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """The required columns that a table lacks, in the order given."""
    return [c for c in required if c not in df.columns]


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, if it has these columns."""
    if missing := missing_columns(df, columns):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def unknown_fields(rules: DataFrame, field: str, known: Sequence[str]) -> DataFrame:
    """Rules on a field (null too) that isn't known."""
    return rules.filter(~F.coalesce(F.col(field).isin(list(known)), F.lit(False)))


def first_reason(checks: Mapping[str, Column]) -> Column:
    """The name of the first check that a row fails; null if it passes all."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def cited(statements: DataFrame, known: Sequence[str], most: int = 8, longest: int = 600) -> DataFrame:
    """Statements (ord, text, cites) with at least one citation of the material, their unknown ones dropped; the first ``most``."""
    kept = statements.withColumn("cites", F.filter("cites", lambda c: c.isin(*known))).filter(F.size("cites") > 0).filter(F.length("text").between(1, longest))
    return kept.orderBy("ord").limit(most)


def valid_relations(relations: DataFrame, entities: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``relations`` (chunk, source, kind, target, quote_found, ord) with reason: why it is dropped, or null.

    Both are dealt by (chunk, name) into parts of about PART rows, so that what a task sorts doesn't grow with the tables.
    """
    shares = max(1, int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-relations.count() // PART))
    names = entities.select("chunk", "name").repartition(shares, "chunk", "name").distinct()
    ends = relations
    for end in ("source", "target"):
        ends = ends.repartition(shares, "chunk", end).join(names.select("chunk", F.col("name").alias(end), F.lit(True).alias(f"_{end}")), ["chunk", end], "left")
    checks = {"kind": F.col("kind").isin(*kinds), "endpoint": F.col("_source") & F.col("_target"), "loop": F.col("source") != F.col("target"), "evidence": F.col("quote_found")}
    checked = ends.withColumn("reason", first_reason(checks))
    again = F.row_number().over(Window.partitionBy("chunk", "source", "kind", "target", F.col("reason").isNull()).orderBy("ord")) > 1
    return checked.withColumn("_again", again).withColumn("reason", F.when(F.col("reason").isNull() & F.col("_again"), "duplicate").otherwise(F.col("reason"))).select(*relations.columns, "reason")


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violations(df: DataFrame, constraints: Mapping[str, Column]) -> DataFrame:
    """name and n: rows that break each constraint (one pass)."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in constraints.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in constraints])).alias("c")).select("c.*")


def exactly_one(parts: Mapping[str, Sequence[str]], columns: Sequence[str]) -> list[str]:
    """Columns that aren't in exactly one section."""
    return [c for c in columns if sum(c in names for names in parts.values()) != 1]


def accepted(df: DataFrame, checks: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the rest for quarantine."""
    ok = F.coalesce(reduce(Column.__and__, checks), F.lit(False))
    return df.filter(ok), df.filter(~ok)
