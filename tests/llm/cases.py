"""Small documents with what operators must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], **extra: str) -> DataFrame:
    df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)
    for name, value in extra.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Every awkward row at once."""
    long = words(20_000, 9, 3_000)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "Ünïcödé 日本 text ▁ with signs   end"), (5, "same text"), (6, "same text"), (6, "same text"), (7, long), (8, long + " tail"), (None, "no id"), (9, "A\x00B \x0b\x0c C"), (10, "x" * 5_000)]
