"""Reshaping: HTML tables, long and wide, nested and flat."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import cut

#: Fixed value: headers of periods (a year, perhaps with its quarter, a month, or the total).
PERIOD = r"^(\d{4}년( \d/4분기)?|\d{1,2}월|계)$"
#: Columns that a cell can span, as HTML has it.
WIDEST = 1000


class TableReader(HTMLParser):
    """Rows of (text, rows spanned, columns spanned) of each table of a page, in the order in which tables begin."""

    def __init__(self, page: str):
        super().__init__()
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.open: list[dict] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "cell": None})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
            self.open[-1]["cell"] = None
        elif self.open and tag in ("td", "th") and self.open[-1]["rows"]:
            given = dict(attrs)
            down, across = (int(v) if (v := (given.get(k) or "").strip()).isascii() and v.isdigit() else 1 for k in ("rowspan", "colspan"))
            self.open[-1]["cell"] = []
            self.open[-1]["rows"][-1].append((self.open[-1]["cell"], max(1, down), min(WIDEST, max(1, across))))

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1]["cell"] = None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[list[str]]:
    """Lines of equal width: spanned cells repeated as far as the table has rows, a later cell before an earlier one, empty text in gaps."""
    lines: list[dict[int, str]] = []
    hanging: dict[int, list[tuple[str, int]]] = {}  # column: text and last row of the cells that reach down, the latest last
    for r, cells in enumerate(rows):
        hanging = {c: left for c, over in hanging.items() if (left := [x for x in over if x[1] >= r])}
        line = {c: over[-1][0] for c, over in hanging.items()}
        place = 0
        for parts, down, across in cells:
            while place in line:
                place += 1
            text = " ".join(" ".join(parts).split())
            for c in range(place, place + across):
                line[c] = text
                if down > 1:
                    hanging.setdefault(c, []).append((text, r + down - 1))
            place += across
        lines.append(line)
    width = max((c + 1 for line in lines for c in line), default=0)
    return [[line.get(c, "") for c in range(width)] for line in lines] if width else []


def table_cells(pages: DataFrame, key: str, source: str) -> DataFrame:
    """key, table_no, row_no, col_no and cell of all tables (that have cells) of all pages; null pages have none.

    Places of cells depend on the spans of those before, which no expression can follow. Pages are dealt to a fixed number of tasks first: a
    table whose file is small would else be read by one or two, for what Spark sees is its bytes and not the work on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                found: list[tuple[int, int, int, int, str]] = []
                for i, page in enumerate(some.column(1).to_pylist()):
                    filled = [g for rows in TableReader(page or "").tables if (g := grid(rows))]
                    found += [(i, t, r, c, text) for t, g in enumerate(filled) for r, line in enumerate(g) for c, text in enumerate(line)]
                numbers = [pa.array([x[j] for x in found], pa.int32()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(numbers[0]), *numbers[1:], pa.array([x[4] for x in found], pa.string())], [key, "table_no", "row_no", "col_no", "cell"])

    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.repartition(tasks, key).select(F.col(key), F.col(source).alias("source"))
    return rows.mapInArrow(run, StructType([rows.schema[0]]).add("table_no", "integer").add("row_no", "integer").add("col_no", "integer").add("cell", "string"))


def long_facts(cells: DataFrame, key: str, skipped: str = "담당자명") -> DataFrame:
    """key, table_no, label, period, value: body cells below period headers, labelled by the different cells before the first period.

    Cells are used four times, so they are written first: pages are parsed once.
    """
    by, cells = [key, "table_no"], cut(cells)
    heads = cells.filter("row_no = 0")
    periods = heads.filter(F.col("cell").rlike(PERIOD)).select(*by, F.col("col_no"), F.col("cell").alias("period"))
    first = periods.groupBy(*by).agg(F.min("col_no").alias("first"))
    bad = heads.filter(F.contains("cell", F.lit(skipped))).select(*by).distinct()
    body = cells.filter("row_no > 0").join(bad, by, "left_anti").join(first, by)
    labels = body.groupBy(*by, "row_no").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when((F.col("col_no") < F.col("first")) & (F.col("cell") != ""), F.struct("col_no", "cell")))), lambda x: x["cell"])), " > ").alias("label"))
    return body.join(periods, [*by, "col_no"]).join(labels, [*by, "row_no"]).select(*by, "row_no", "label", "period", F.col("cell").alias("value"))


def wide(facts: DataFrame, key: str, column: str, value: str, ordinal: str, names: Sequence[str]) -> DataFrame:
    """One row per key and a column for each name: the last value by ordinal."""
    return facts.groupBy(key).pivot(column, list(names)).agg(F.max_by(value, ordinal))


def names_in(facts: DataFrame, column: str) -> list[str]:
    """The columns that :func:`wide` can have: the different names, at most as many as a table can have columns."""
    names = [r[0] for r in facts.select(column).distinct().orderBy(column).limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError(f"{column} has more than 10,000 different names; none is left out")
    return names


def melted(df: DataFrame, key: str, columns: Sequence[str], separator: str = ";") -> DataFrame:
    """key, name, value: one row for each part of each column's list, blanks dropped."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("cell")) for c in columns])
    rows = df.select(key, F.explode(each).alias("e")).select(key, "e.name", F.explode(F.split("e.cell", separator)).alias("value"))
    return rows.withColumn("value", F.trim("value")).filter("value <> ''")


def listed(c: Column, separator: str = ";") -> Column:
    return F.filter(F.transform(F.split(c, separator), F.trim), lambda x: x != "")


def sub_records(c: Column, record: str, field: str) -> Column:
    """Delimited records as an array of (first, second), as in "1@a|2@b"."""
    return F.transform(F.filter(F.split(c, record), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(field), F.lit(1)).alias("first"), F.split_part(x, F.lit(field), F.lit(2)).alias("second")))


def links(page: Column) -> Column:
    """(href, text) of the links of a page, in order."""
    pattern = r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    return F.arrays_zip(F.regexp_extract_all(page, F.lit(pattern), 1).alias("href"), F.regexp_extract_all(page, F.lit(pattern), 2).alias("label"))


def flat_events(batches: DataFrame) -> DataFrame:
    """One row per event of nested batches, with its batch's columns and its place."""
    return batches.select("session", "seq", "received", F.posexplode("events").alias("place", "event")).select("session", "seq", "received", "place", "event.*")


def fixed_json(*columns: str) -> Column:
    """An object with its keys in the given order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
