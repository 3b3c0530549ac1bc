"""Joins beyond equality: nested, containment, prefix, nearest; and checks that a join loses nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import area, distance, in_box, polyline_length, symmetric_distance
from ..sources.files import cut
from .scan import running


def with_children(parents: DataFrame, children: DataFrame, on: str, columns: Sequence[str], name: str = "children") -> DataFrame:
    """Parents with a sorted array of their children (empty if none)."""
    grouped = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    empty = F.array().cast(grouped.schema[name].dataType)
    return parents.join(grouped, on, "left").withColumn(name, F.coalesce(name, empty))


def key_difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """side and key of keys that only one of two tables has."""
    left = a.join(b, on, "left_anti").select(F.lit("left").alias("side"), F.col(on).cast("string").alias("key"))
    return left.unionAll(b.join(a, on, "left_anti").select(F.lit("right"), F.col(on).cast("string")))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with their multiplicity) that two tables don't share, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def must_match(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """An inner join that fails, naming the key, where a row of ``a`` has no partner. Keys of ``b`` are unique; rows of a key that isn't come once for each."""
    mark = "_held"
    while mark in {*a.columns, *b.columns}:
        mark += "_"
    held = a.join(b.withColumn(mark, F.lit(True)), on, "left")
    lost = F.raise_error(F.concat(F.lit(f"no partner for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return held.filter(F.coalesce(F.col(mark), lost.cast("boolean"))).drop(mark)


def plain(c: Column) -> Column:
    """For containment: lower case, white space as single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


#: Characters of the phrases that one automaton holds: what a task has in memory, and what is broadcast at once.
SHARE = 2_000_000
_automata: dict[int, object] = {}


def _holding(share: int, phrases: Broadcast) -> Callable[[Column], Column]:
    """Numbers of a share's phrases that a text holds, by one pass of an automaton over the text."""

    def run(texts: pd.Series) -> pd.Series:
        if share not in _automata:  # a worker keeps the one it has
            import ahocorasick

            _automata.clear()
            automaton = ahocorasick.Automaton()
            for i, phrase in enumerate(phrases.value):
                automaton.add_word(phrase, i)
            automaton.make_automaton()
            _automata[share] = automaton
        return texts.map(lambda t: sorted({i for _, i in _automata[share].iter(t)}) if t else [])

    return F.pandas_udf(run, "array<int>")


def containing(texts: DataFrame, phrases: DataFrame, text: str, phrase: str) -> DataFrame:
    """Pairs of a text and a phrase that it contains, at any place; empty phrases are in none, null texts hold none.

    Phrases of SHARE characters make an Aho-Corasick automaton, which finds all of them in one pass over a text, where the text is: texts aren't shuffled,
    only pairs are. With more phrases there are more shares, by hash, and a pass over the texts for each.
    """
    spark = texts.sparkSession
    keyed = phrases.withColumn("_phrase", plain(F.col(phrase))).filter("_phrase <> ''")
    distinct = cut(keyed.select("_phrase").distinct())
    shares = max(1, -(-(distinct.agg(F.sum(F.length("_phrase"))).first()[0] or 0) // SHARE))
    out = None
    for k in range(shares):
        some = sorted(r[0] for r in distinct.filter(F.pmod(F.xxhash64("_phrase"), F.lit(shares)) == k).collect())  # about SHARE characters
        held = _holding(uuid.uuid4().int, spark.sparkContext.broadcast(some)) if some else lambda _: F.array().cast("array<int>")
        numbers = spark.createDataFrame(list(enumerate(some)), "_number int, _phrase string")
        found = texts.withColumn("_number", F.explode(held(plain(F.col(text))))).join(numbers.join(keyed, "_phrase"), "_number").drop("_number", "_phrase")
        out = found if out is None else out.unionByName(found)
    return out


def grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def loosely_equal(a: DataFrame, b: DataFrame, a_key: str, b_key: str, least: int = 4) -> DataFrame:
    """Pairs of names of which one contains the other, both of ``least`` characters or more; they meet on the first characters of the shorter one."""
    first = lambda c: F.substring(c, 1, least)
    long_a, long_b = a.filter(F.length(a_key) >= least), b.filter(F.length(b_key) >= least)
    b_in_a = long_a.withColumn("_g", F.explode(grams(F.col(a_key), least))).join(long_b.withColumn("_g", first(F.col(b_key))), "_g").filter(F.contains(F.col(a_key), F.col(b_key)))
    a_in_b = long_a.withColumn("_g", first(F.col(a_key))).join(long_b.withColumn("_g", F.explode(grams(F.col(b_key), least))), "_g").filter(F.contains(F.col(b_key), F.col(a_key)) & (F.col(a_key) != F.col(b_key)))
    return b_in_a.drop("_g").unionByName(a_in_b.drop("_g"))


def prefix_overlap(a: DataFrame, b: DataFrame, a_key: str, b_key: str, shortest: int = 1) -> DataFrame:
    """Pairs of codes of which one begins with the other; they meet on all prefixes of the longer one that are codes of the other side."""
    prefixes = lambda c: F.transform(F.sequence(F.lit(shortest), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    b_first = a.filter(F.length(a_key) >= shortest).withColumn("_p", F.explode(prefixes(F.col(a_key)))).join(b.withColumn("_p", F.col(b_key)), "_p")
    a_first = a.withColumn("_p", F.col(a_key)).join(b.filter(F.length(b_key) >= shortest).withColumn("_p", F.explode(prefixes(F.col(b_key)))), "_p").filter(F.col(a_key) != F.col(b_key))
    return b_first.drop("_p").unionByName(a_first.drop("_p"))


def nearest_value(a: DataFrame, b: DataFrame, by: str, a_id: str, a_value: str, b_id: str, b_value: str) -> DataFrame:
    """For each row of ``a`` the row of ``b`` in the same group whose value is nearest (ties: least id; null if the group has none): by, a_id, b_id, distance.

    One sorted pass over both tables: only the last value before and the first one after can be nearest, so no pairs are made, and
    a group may be of any size.
    """
    points = b.groupBy(by, b_value).agg(F.min(b_id).alias("_b"))
    both = a.select(by, F.col(a_id).alias("_a"), F.col(a_value).alias("_v"), F.lit(None).cast(points.schema["_b"].dataType).alias("_b"), F.lit(1).alias("_k")).unionAll(
        points.select(by, F.lit(None).cast(a.schema[a_id].dataType), F.col(b_value), "_b", F.lit(0))
    )
    point = F.when(F.col("_k") == 0, F.struct("_v", "_b"))
    found = running(both, [by], ["_v", "_k", "_a"], lasts={"_low": point}, nexts={"_high": point}).filter("_k = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["_v"] - F.col("_v")).alias("d"), F.col(c)["_b"].alias("b")))
    best = found.select(by, "_a", F.array_min(F.array_compact(F.array(near("_low"), near("_high")))).alias("_n"))
    return best.select(by, F.col("_a").alias(a_id), F.col("_n.b").alias(b_id), F.col("_n.d").alias("distance"))


def best_per(pairs: DataFrame, key: Sequence[str], value: str, distance: str, order: str) -> DataFrame:
    """For each key the value of least distance, ties by ``order``."""
    return pairs.groupBy(*key).agg(F.min_by(value, F.struct(distance, order)).alias(value), F.min(distance).alias(distance))


def not_done(df: DataFrame, done: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(done, on, "left_anti")


def with_default(facts: DataFrame, dimension: DataFrame, on: str, default: str = "") -> DataFrame:
    """Facts with a dimension's text columns, ``default`` where it has no row."""
    joined = facts.join(dimension, on, "left")
    return joined.na.fill(default, [c for c in dimension.columns if c != on])


#: Cells are no smaller than 2**LEAST_LEVEL.
LEAST_LEVEL = -20


def meeting(points: DataFrame, point: Column, boxes: DataFrame, box: Column, on: str) -> DataFrame:
    """Pairs of a point and a box of the same group that holds it, borders included, each pair once; null points and boxes are in none.

    They meet on cells of grids: a box is entered in the grid whose cells are just as large as it, where it lies in four cells at most, and a point looks
    into its cell of each grid that its group has. So work is linear in points and boxes, and a large group is many keys. Rows are dealt out
    before they are entered and joins are by sorting: tables that are small as files are not so as entries, and none is broadcast.
    """
    size = F.greatest(box[2] - box[0], box[3] - box[1])
    level = F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.greatest(size, F.lit(2.0**LEAST_LEVEL))))).cast("int")
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("_level")))
    cells = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    whole = size.isNotNull() & (box[2] >= box[0]) & (box[3] >= box[1])
    entered = boxes.filter(whole).repartition(F.col(on), box[0], box[1]).withColumn("_level", level).withColumn("_x", cells(box[0], box[2])).withColumn("_y", cells(box[1], box[3]))
    levels = boxes.filter(whole).groupBy(on).agg(F.collect_set(level).alias("_levels"))
    looking = points.filter(point[0].isNotNull() & point[1].isNotNull()).repartition(F.col(on), point[0], point[1]).join(levels.hint("merge"), on).withColumn("_level", F.explode("_levels")).drop("_levels")
    placed = looking.withColumns({"_x": cell(point[0]), "_y": cell(point[1])})
    return placed.join(entered.hint("merge"), [on, "_level", "_x", "_y"]).filter(in_box(point, box)).drop("_level", "_x", "_y")


def around(centre: Column, half: Column) -> Column:
    """A square."""
    return F.array(centre[0] - half, centre[1] - half, centre[0] + half, centre[1] + half)


def smallest_box(points: DataFrame, boxes: DataFrame, on: str) -> DataFrame:
    """``points`` (on, point_id, point) with the smallest box (on, box_id, box) that holds the point, ties by box_id; null if none does."""
    held = meeting(points, F.col("point"), boxes, F.col("box"), on)
    best = held.groupBy(on, "point_id").agg(F.min_by("box_id", F.struct(area(F.col("box")), F.col("box_id"))).alias("box_id"))
    return points.select(on, "point_id").join(best.hint("merge"), [on, "point_id"], "left")


def attachment_box(points: DataFrame, boxes: DataFrame, on: str, enlarged: float = 0.2, reach: float = 1.5) -> DataFrame:
    """on, point_id, box_id: the box with the nearest centre of those that hold the point when enlarged, or whose centre is within ``reach`` diagonals."""
    box, point = F.col("box"), F.col("point")
    centre = F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
    away = distance(point, centre)
    diagonal = F.hypot(box[2] - box[0], box[3] - box[1])
    reached = boxes.withColumn("_reach", around(centre, max(reach, 0.5 + enlarged) * diagonal * (1 + 1e-9)))
    near = meeting(points, point, reached, F.col("_reach"), on).filter(in_box(point, box, enlarged) | (away <= reach * diagonal))
    return near.groupBy(on, "point_id").agg(F.min_by("box_id", F.struct(away.alias("d"), F.col("box_id"))).alias("box_id"))


def nearest_end(lines: DataFrame, others: DataFrame, on: str, reach: float = 0.4) -> DataFrame:
    """on, line_id, other_id: the other line whose end is nearest to a line's end, within ``reach`` of the line's length; ties by other_id."""
    end = lambda c: F.element_at(F.col(c), -1)
    away = distance(end("line"), end("other"))
    lines = lines.repartition(on, "line_id")  # before their lengths are made
    reached = lines.withColumn("_reach", around(end("line"), reach * polyline_length(F.col("line")) * (1 + 1e-9)))
    near = meeting(others.withColumn("_end", end("other")), F.col("_end"), reached, F.col("_reach"), on).filter(away <= reach * polyline_length(F.col("line")))
    return near.groupBy(on, "line_id").agg(F.min_by("other_id", F.struct(away.alias("d"), F.col("other_id"))).alias("other_id"))


def best_match(lines: DataFrame, others: DataFrame, on: str, most: float = 0.5) -> DataFrame:
    """on, line_id, other_id, distance: the other line of least symmetric distance, if that is at most ``most`` of the line's length.

    The means of two lines' points are no further apart than their points are on average, whichever way the lines run, so only lines whose means are near are compared.
    """
    away = symmetric_distance(F.col("line"), F.col("other"))
    lines, others = lines.repartition(on, "line_id"), others.repartition(on, "other_id")  # before their lengths and means are made
    limit = most * polyline_length(F.col("line"))
    total = lambda c, i: F.aggregate(F.col(c), F.lit(0.0), lambda s, p: s + p[i])
    mean = lambda c: F.array(total(c, 0) / F.size(c), total(c, 1) / F.size(c))
    reached = lines.withColumn("_reach", around(mean("line"), limit + (limit + 1) * 1e-9))
    near = meeting(others.withColumn("_mean", mean("other")), F.col("_mean"), reached, F.col("_reach"), on)
    scored = near.select(on, "line_id", "other_id", away.alias("distance"), limit.alias("_most"))
    return scored.groupBy(on, "line_id", "_most").agg(F.min_by("other_id", F.struct("distance", "other_id")).alias("other_id"), F.min("distance").alias("distance")).filter("distance <= _most").drop("_most")
