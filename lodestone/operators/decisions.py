"""Detections and a reviewer's answers joined to one decision for each line: what is measured stands, only an unknown takes an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bounding_box
from ..sources.files import cut
from .joins import nearest_end, smallest_box

UNKNOWN = "unknown"
#: How answers on hooks and on workers are read; any other is no answer.
HOOKS = {"structure": "structure", "body": "not_structure", "other": "not_structure"}
WORKERS = {"clipped": "structure", "unclipped": "not_structure"}


def answer(c: Column, readings: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, reading in readings.items():
        out = F.when(c == name, F.lit(reading)).otherwise(out)
    return out


def decided(shape: Column, given: Column) -> Column:
    """label and source: the shape's verdict if it has one, else the answer, else unknown."""
    label = F.when(shape != UNKNOWN, shape).when(given.isNotNull(), given).otherwise(UNKNOWN)
    source = F.when(shape != UNKNOWN, "shape").when(given.isNotNull(), "answer").otherwise("none")
    return F.struct(label.alias("label"), source.alias("source"))


def combine(detections: DataFrame, workers: DataFrame, lines: DataFrame) -> DataFrame:
    """image, origin, worker, line, hook, label, source, box: each detected line, and each answered line of workers without a detection.

    ``detections`` have image, line_id, line, shape; ``workers`` image, worker, box, label; ``lines`` (of the answers) image, worker, number, points,
    hook, shape. A detection belongs to the worker with the smallest box around its start. Its hook is that of the worker's line that ends nearest to
    its own end, within 0.4 of its length; without one the worker's own state answers. All tables grow with the images, so none is broadcast.
    """
    starts = detections.select("image", F.col("line_id").alias("point_id"), F.element_at("line", 1).alias("point"))
    owner = smallest_box(starts, workers.select("image", F.col("worker").alias("box_id"), "box"), "image").select("image", F.col("point_id").alias("line_id"), F.col("box_id").alias("worker"))
    owned = cut(detections.join(owner.hint("merge"), ["image", "line_id"]))
    key = F.struct("image", "worker").alias("of")
    near = nearest_end(owned.filter("worker IS NOT NULL").select(key, "line_id", "line"), lines.select(key, F.col("number").alias("other_id"), F.col("points").alias("other")), "of")
    hooks = near.join(lines.select(key, F.col("number").alias("other_id"), "hook").hint("merge"), ["of", "other_id"]).select("of.image", "line_id", "hook")
    state = workers.select("image", "worker", F.col("label").alias("state")).hint("merge")
    asked = owned.join(hooks.withColumn("near", F.lit(True)).hint("merge"), ["image", "line_id"], "left").join(state, ["image", "worker"], "left")
    given = F.when(F.col("near"), answer(F.col("hook"), HOOKS)).otherwise(answer(F.col("state"), WORKERS))
    found = asked.select("image", F.lit("detected").alias("origin"), "worker", F.col("line_id").alias("line"), "hook", decided(F.col("shape"), given).alias("d"), bounding_box(F.col("line")).alias("box"))
    missed = lines.join(owned.select("image", "worker").distinct().hint("merge"), ["image", "worker"], "left_anti").join(state.select("image", "worker").hint("merge"), ["image", "worker"], "left_semi")
    added = missed.select("image", F.lit("answered").alias("origin"), "worker", F.col("number").alias("line"), "hook", decided(F.col("shape"), answer(F.col("hook"), HOOKS)).alias("d"), bounding_box(F.col("points")).alias("box"))
    return found.unionByName(added).select("image", "origin", "worker", "line", "hook", "d.label", "d.source", "box")


def first_object(text: Column) -> Column:
    """What stands from the first to the last brace of a free text; null if there are none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
