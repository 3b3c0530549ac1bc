"""Filters, facets and pages. An empty parameter means no filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_VALUES, LONGEST_VALUE = 50, 100


def equals(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Equality in each field; "" is no filter."""
    for name, value in wanted.items():
        if value != "":
            df = df.filter(F.col(name) == value)
    return df


def any_of(df: DataFrame, wanted: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Any of the values in a field, all fields at once; "" and [] are no filter, [""] finds empty cells."""
    for name, values in bounded(wanted).items():
        if values:
            df = df.filter(F.col(name).isin([values] if isinstance(values, str) else list(values)))
    return df


def bounded(wanted: Mapping[str, str | Sequence[str]]) -> Mapping[str, str | Sequence[str]]:
    for name, values in wanted.items():
        each = [values] if isinstance(values, str) else list(values)
        if len(each) > MOST_VALUES or any(len(v) > LONGEST_VALUE for v in each):
            raise ValueError(f"too many or too long values of {name}")
    return wanted


def skipping(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column doesn't hold the pattern anywhere; null holds nothing."""
    return df.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of rows in a total order."""
    if not (1 <= number <= 100_000 and 1 <= size <= 100):
        raise ValueError("page 1 to 100000, size 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ranked(df: DataFrame, order: Sequence[Column], most: int | None = None, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rows with their rank in a total order (in each group), the first ``most`` if that is given.

    Over all rows a rank needs one order, so a limit is taken first, by Spark's distributed top-k.
    """
    if not by and most is not None:
        df = df.orderBy(*order).limit(most)
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window).cast("bigint"))
    return out.filter(F.col(name) <= most) if most is not None else out


def quality_status(mismatch: Column) -> Column:
    return F.when(mismatch == "true", "mismatch").when(mismatch == "false", "matched").otherwise("unverified")


def squeezed_contains(columns: Sequence[Column], query: str) -> Column:
    """A query in a text, both without white space and in lower case."""
    text = F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), r"\s+", "")
    return F.contains(text, F.lit("".join(query.lower().split())))


def year_is(c: Column, year: str) -> Column:
    if year and not (len(year) == 4 and year.isdigit()):
        raise ValueError("a year has four digits")
    return c.cast("string") == year if year else F.lit(True)


def threshold_rows(df: DataFrame, industry: str) -> DataFrame:
    """Rows of a threshold table for an industry: all if it isn't known, else equal or section or construction or other ones."""
    if not industry or industry == "unknown":
        return df
    kind = "construction" if industry.startswith("F") else "other"
    return df.filter((F.col("industry") == industry) | F.startswith(F.col("industry"), F.lit(industry[0])) & F.lit(len(industry) == 1) | (F.col("industry") == kind))


def visible(children: DataFrame, parents: DataFrame, on: str | Sequence[str], shown: Column) -> DataFrame:
    """Children of visible parents."""
    return children.join(parents.filter(shown), on, "left_semi")


def facet_counts(df: DataFrame, facets: Mapping[str, Sequence[str]]) -> DataFrame:
    """facet, value, n: rows of each value of a facet among those that all *other* facets' picks let through."""
    ok = {name: F.col(name).isin(list(picks)) if picks else F.lit(True) for name, picks in facets.items()}
    each = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(name).alias("value"), reduce(Column.__and__, [ok[o] for o in facets if o != name], F.lit(True)).alias("counts")) for name in facets])
    return df.select(F.explode(each).alias("f")).groupBy("f.facet", "f.value").agg(F.count_if("f.counts").alias("n"))


def overlap(a: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(a, F.array(*map(F.lit, wanted)))


def holds_secret(content: Column, secrets: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(content, F.lit(s)) for s in secrets], F.lit(False))
