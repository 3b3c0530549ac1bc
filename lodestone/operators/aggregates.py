"""Aggregations: profiles, first-come collections, zero-filled counts, calibration, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zero_filled(df: DataFrame, column: str, values: Sequence[str], name: str = "n") -> DataFrame:
    """Counts of the given values, in their order (ord), those of no row too."""
    spark: SparkSession = df.sparkSession
    fixed = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"ord long, {column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return fixed.join(counts, column, "left").select("ord", column, F.coalesce(name, F.lit(0)).alias(name))


def first_distinct(value: Column, ordinal: Column, most: int) -> Column:
    """An aggregate: the first ``most`` different values by ordinal."""
    return F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(ordinal.alias("o"), value.alias("v"))))), lambda x: x["v"])), 1, most)


def mode_first(df: DataFrame, by: Sequence[str], value: str, ordinal: str) -> DataFrame:
    """The most frequent value of each group, of equal ones the one that came first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(ordinal).alias("_o"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_o"))).alias(value))


def top_per_group(df: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """by, value, n, rank: the most frequent values of each group, ties in order of value."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value)).cast("bigint")).filter(F.col("rank") <= most)


def calibration(df: DataFrame, confidence: Column, agrees: Column, edges: Sequence[float] = (0.25, 0.4, 0.6, 0.8, 1.01)) -> DataFrame:
    """band, n, agreed, ratio (3 digits; null without answers) by bands [low, high) of confidence."""
    band = F.lit(None).cast("string")
    for low, high in zip(edges, edges[1:], strict=False):
        band = F.when((confidence >= low) & (confidence < high), f"{low:g}-{high:g}").otherwise(band)
    rows = df.select(band.alias("band"), agrees.alias("agrees")).filter("band IS NOT NULL")
    answered = F.count("agrees")
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("agrees")).alias("agreed"), F.round(F.count_if(F.col("agrees")) / F.nullif(answered, F.lit(0)), 3).alias("ratio"))


def spend(charges: DataFrame, today: str) -> DataFrame:
    """What counts on a day: amounts started or finished then, or not finished at all; in total and by provider."""
    counted = F.when((F.col("started") == today) | (F.col("finished") == today) | F.col("finished").isNull(), F.col("amount")).otherwise(0)
    return charges.rollup("provider").agg(F.coalesce(F.sum(counted), F.lit(0)).alias("spent")).select(F.coalesce("provider", F.lit("all")).alias("provider"), "spent")


def settled(events: DataFrame) -> DataFrame:
    """id, reserved, amount, over from reserve and settle events (id, kind, amount, ord): the first settlement counts, the reservation until then."""
    reserve = F.min_by(F.when(F.col("kind") == "reserve", F.col("amount")), F.when(F.col("kind") == "reserve", F.col("ord")))
    settle = F.min_by(F.when(F.col("kind") == "settle", F.col("amount")), F.when(F.col("kind") == "settle", F.col("ord")))
    return events.groupBy("id").agg(reserve.alias("reserved"), settle.alias("paid")).select("id", "reserved", F.coalesce("paid", "reserved").alias("amount"), F.coalesce(F.col("paid") > F.col("reserved"), F.lit(False)).alias("over"))


def click_rate(events: DataFrame, item: str, shown: Column, clicked: Column) -> DataFrame:
    out = events.groupBy(item).agg(F.count_if(shown).alias("shown"), F.count_if(clicked).alias("clicked"))
    return out.withColumn("rate", F.round(F.col("clicked") / F.nullif(F.col("shown"), F.lit(0)), 4))


def roll_up_sections(divisions: DataFrame, section: str, division: str, hit: Column) -> DataFrame:
    """section and value: the section alone where all its divisions are hit, else each division that is."""
    grouped = divisions.groupBy(section).agg(F.bool_and(hit).alias("_all"), F.array_sort(F.collect_set(F.when(hit, F.col(division)))).alias("_hits"))
    return grouped.select(section, F.explode(F.when(F.col("_all"), F.array(F.col(section))).otherwise(F.col("_hits"))).alias("value"))


def keyword_hits(found: DataFrame, key: str, word: str, ordinal: str, kept: Sequence[str]) -> DataFrame:
    """One row per key: columns of its first hit, and all words that found it in order."""
    words = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, word))), lambda x: x[word])), ";")
    return found.groupBy(key).agg(*[F.min_by(c, ordinal).alias(c) for c in kept], words.alias("words"))
