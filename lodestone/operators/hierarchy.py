"""Code hierarchies, each within one edition: ancestors with faults, descendants, children.

Walks go over tables, all codes at once: upward by doubling, downward level by level. Each round is written out, so neither the
number of rows nor that of levels is bounded by a plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import cut


def ancestors(codes: DataFrame) -> DataFrame:
    """edition, code, ancestor, depth (from 1) and issue: "" , "cycle" or "dangling" for the step. ``codes`` has edition, code and parent ('' at the top).

    By doubling: when each code has its nearest 2**k ancestors and its 2**k-th one is a code, that one's ancestors are its next ones. So a chain of n codes
    takes log2(n) rounds. A walk that meets a code again ends there; that shows as soon as its rows reach around.
    """
    known = codes.select("edition", F.col("code").alias("ancestor"), F.lit(False).alias("gone"))
    first = codes.filter("parent <> ''").select("edition", "code", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("depth")).join(known, ["edition", "ancestor"], "left")
    rows = cut(first.select("edition", "code", "ancestor", "depth", F.coalesce("gone", F.lit(True)).alias("gone")))
    jumps = changed = rows.filter("NOT gone").select("edition", "code", F.col("ancestor").alias("over"))
    ends, length = [], 1
    while True:
        end = cut(_met_again(rows, changed))
        if not end.isEmpty():  # what lies beyond goes
            ends.append(end)
            rows = cut(rows.join(end, ["edition", "code"], "left").filter("end IS NULL OR depth <= end").drop("end"))
            jumps = cut(jumps.join(end, ["edition", "code"], "left_anti"))
        reached = rows.select("edition", F.col("code").alias("over"), "ancestor", "depth", "gone")
        more = cut(jumps.join(reached, ["edition", "over"]).select("edition", "code", "ancestor", (F.col("depth") + length).alias("depth"), "gone"))
        if more.isEmpty():
            break
        further = jumps.select("edition", F.col("code").alias("over"), F.col("over").alias("beyond"))
        rows, changed = rows.unionByName(more), jumps
        jumps, length = cut(jumps.join(further, ["edition", "over"]).select("edition", "code", F.col("beyond").alias("over"))), 2 * length
    cycle = F.lit(False)
    if ends:
        rows = rows.join(reduce(DataFrame.unionByName, ends), ["edition", "code"], "left")
        cycle = F.coalesce(F.col("depth") == F.col("end"), F.lit(False))
    return rows.select("edition", "code", "ancestor", "depth", F.when(cycle, "cycle").when(F.col("gone"), "dangling").otherwise("").alias("issue"))


def _met_again(rows: DataFrame, walks: DataFrame) -> DataFrame:
    """edition, code, end: the depth at which a walk first comes to a code that it has passed, itself included."""
    own = walks.select("edition", "code", F.col("code").alias("ancestor"), F.lit(0).cast("bigint").alias("depth"))
    passed = rows.join(walks.select("edition", "code"), ["edition", "code"], "left_semi").select(*own.columns).unionByName(own)
    again = passed.groupBy("edition", "code", "ancestor").agg(F.sort_array(F.collect_list("depth")).alias("at")).filter(F.size("at") > 1)
    return again.groupBy("edition", "code").agg(F.min(F.col("at")[1]).alias("end"))


def descendants(codes: DataFrame, roots: DataFrame) -> DataFrame:
    """edition, root, code, depth (0 for the root) below each root (edition, root), each code once."""
    below = cut(codes.select("edition", F.col("parent").alias("code"), F.col("code").alias("child")))
    known = codes.select("edition", F.col("code").alias("root"))
    level = cut(roots.select("edition", "root").distinct().join(known, ["edition", "root"], "left_semi").select("edition", "root", F.col("root").alias("code"), F.lit(0).cast("bigint").alias("depth")))
    levels = [level]
    while True:
        found = level.join(below, ["edition", "code"]).select("edition", "root", F.col("child").alias("code"), (F.col("depth") + 1).alias("depth")).distinct()
        level = cut(found.join(reduce(DataFrame.unionByName, levels), ["edition", "root", "code"], "left_anti"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)


def children(codes: DataFrame) -> DataFrame:
    """edition, code and its number of direct children."""
    below = codes.filter("parent <> ''").groupBy("edition", F.col("parent").alias("code")).agg(F.count(F.lit(1)).alias("n_children"))
    return codes.select("edition", "code").join(below, ["edition", "code"], "left").na.fill(0, ["n_children"])
