"""Chat formatting of logged conversations, cumulative snapshots collapsed.

A log often holds the same conversation again and again, one turn longer each time. Each turn gets a rolling hash of the turns
up to it: the exclusive or of the hashes of (place, role, text), which long conversations can share out among tasks. A
conversation whose last hash is what some turn of a longer one comes after is a prefix of that one and goes by an anti-join;
of equal conversations the least conv_id stays. What is left is written out.

Defined results: turns come in order of turn (null first), role and text; null role and text count as empty; a turn number that
occurs twice gives two turns; rows without conv_id form one conversation, which stays rather than an equal one; an empty table
gives no rows; other columns are ignored. Prefixes are told apart by two 64-bit hashes and their number of turns. A
conversation of more than MOST_TURNS turns is written out in several rows (piece 0, 1, ...), which follow each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turn numbers that form one part of a conversation: no task has to order a whole long one.
PART = 256
MOST_TURNS = 4096
START, END = "<|im_start|>", "<|im_end|>"


def _with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    other = parts.withColumnsRenamed({"conv_id": "_id", "part": "_part"})
    return rows.join(other, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))).drop("_id", "_part")


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place (from 1), a and b (hashes of the turns so far), a_before and b_before (without this one)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("part", F.expr(f"coalesce(turn div {PART}, -9223372036854775808)"))
    parts_before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = cut(sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(parts_before), F.lit(0)).alias("start")))
    in_part = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = _with_parts(rows.withColumn("row", F.row_number().over(in_part)), starts).withColumn("place", F.col("row") + F.col("start"))
    hashed = cut(placed.select("conv_id", "part", "turn", "role", "text", "place", F.xxhash64("place", "role", "text").alias("x"), F.xxhash64("text", "role", "place", F.lit("second")).alias("y")))
    sums = hashed.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    offsets = cut(sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(parts_before), F.lit(0)).alias(f"{c}_offset") for c in "xy"]))
    so_far = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = _with_parts(hashed.withColumn("rx", F.bit_xor("x").over(so_far)).withColumn("ry", F.bit_xor("y").over(so_far)), offsets)
    a, b = F.col("rx").bitwiseXOR(F.col("x_offset")), F.col("ry").bitwiseXOR(F.col("y_offset"))
    return summed.select("conv_id", "turn", "role", "text", "place", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("a_before"), b.bitwiseXOR(F.col("y")).alias("b_before"))


def maximal_conversations(rolled: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another; one of each group of equal ones."""
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct("place", "a", "b")).alias("end")).select("conv_id", "end.*")
    one = ends.groupBy("place", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id"))["conv_id"].alias("conv_id"))
    inner = rolled.filter("place > 1").select((F.col("place") - 1).alias("place"), F.col("a_before").alias("a"), F.col("b_before").alias("b")).distinct()
    return one.join(inner, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"))


def chat_format(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation (or per piece of a very long one): conv_id, piece, n_turns (of all), text."""
    rolled = cut(rolling_hashes(turns))
    kept = cut(maximal_conversations(rolled))
    line = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(f"{END}\n"))
    held = rolled.join(kept.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")))
    rows = held.select("conv_id", F.expr(f"(place - 1) div {MOST_TURNS}").alias("piece"), "n_turns", "place", line.alias("line"))
    grouped = rows.groupBy("conv_id", "piece", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return grouped.select("conv_id", "piece", "n_turns", F.array_join("lines.line", "").alias("text"))


SQL = r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
                      count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations),
    p AS (SELECT conv_id, place, n_turns, string_agg(chr(2) || role || chr(3) || text, chr(4)) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM t),
    o AS (SELECT min(conv_id) AS conv_id, prefix FROM p WHERE place = n_turns GROUP BY prefix),
    k AS (SELECT conv_id FROM o WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns))
    SELECT conv_id, CAST(0 AS BIGINT) AS piece, n_turns,
           string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
    FROM t WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id, n_turns"""
