"""Orders, ranks and window-like operators with full tie rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import cut
from .filters import ranked
from .scan import running


def fuse(rankings: dict[str, DataFrame], row: str, most: int | None = 200, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (row, rank): row, score, channels and rank; ties by row."""
    return ranked(fused_scores(rankings, row, k), [F.desc(F.round("score", 12)), F.col(row)], most)


def fused_scores(rankings: dict[str, DataFrame], row: str, k: int = 60) -> DataFrame:
    """row, score and channels, without an order."""
    every = None
    for order, (name, ranking) in enumerate(rankings.items()):
        part = ranking.select(row, (1.0 / (k + F.col("rank"))).alias("share"), F.struct(F.lit(order).alias("o"), F.lit(name).alias("name")).alias("channel"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(row).agg(F.sum("share").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list("channel")), lambda c: c["name"]), "+").alias("channels"))


def numbered_by_size(members: DataFrame, group: str, pattern: str, name: str) -> DataFrame:
    """group, size and a number for each group: the largest first, ties by group."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return numbered(sizes, [F.desc("size"), F.col(group)], pattern, name)


def numbered(df: DataFrame, order: Sequence[Column], template: str, name: str) -> DataFrame:
    """Ids from 0 in a total order, without bringing all rows to one task: ranks in range partitions plus the sizes of those before.

    The partitions are written out, since their bounds come from samples and both uses need the same ones.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(one), F.lit(0)).alias("_before"))
    joined = own.join(F.broadcast(before), "_part")  # one row per partition
    return joined.withColumn(name, F.format_string(template, F.col("_before") + F.col("_rank") - 1)).drop("_part", "_rank", "_before")


def by_title(title: Column, language: str = "ko") -> Column:
    """The order of a catalogue: a language's collation instead of that of bytes."""
    return F.collate(title, language)


def siblings(df: DataFrame, by: str, order: Sequence[str], key: str) -> DataFrame:
    """Position (from 1) and count in a group, and the keys before and after."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumns({"position": F.row_number().over(w).cast("bigint"), "siblings": F.count(F.lit(1)).over(Window.partitionBy(by)), "previous": F.lag(key).over(w), "following": F.lead(key).over(w)})


def within_budget(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """The rows of each group, in order, up to the first one that makes the total too large. Sizes aren't negative; a group may be of any size."""
    return running(df, by, order, sums={"total": F.col(size)}).filter(F.col("total") <= budget)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in order. An aggregate, so that a key of very many rows is no task of its own."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest])).alias("_one"))
    return one.select(*[F.col(c) if c in key else F.col(f"_one._{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, key: Sequence[str], value: str, ordinal: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, ordinal).alias(value))


def suppress_overlaps(detections: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Greedy suppression per image: the most confident box stays and boxes that overlap it by ``least_iou`` or more go. Ties by idx.

    Which boxes stay depends on those before, so an image (some dozens of boxes) is one group.
    """

    def one(boxes: pd.DataFrame) -> pd.DataFrame:
        boxes = boxes.sort_values(["conf", "idx"], ascending=[False, True], kind="stable")
        xy = np.array(boxes["box"].tolist(), float).reshape(-1, 4)
        area = np.maximum(0, xy[:, 2] - xy[:, 0]) * np.maximum(0, xy[:, 3] - xy[:, 1])
        kept: list[int] = []
        for i in range(len(xy)):
            if kept:
                k = xy[kept]
                both = np.maximum(0, np.minimum(xy[i, 2], k[:, 2]) - np.maximum(xy[i, 0], k[:, 0])) * np.maximum(0, np.minimum(xy[i, 3], k[:, 3]) - np.maximum(xy[i, 1], k[:, 1]))
                union = area[i] + area[kept] - both
                if (np.where(union > 0, both / np.maximum(union, 1e-12), 0) >= least_iou).any():
                    continue
            kept.append(i)
        return boxes.iloc[kept][["image", "idx", "conf"]]

    return detections.select("image", "idx", "conf", "box").groupBy("image").applyInPandas(one, "image string, idx int, conf double")


def natural_order(c: Column, classes: str) -> list[Column]:
    """By class letter in the given order, then by number: C2 before C10 before R1."""
    return [F.position(F.substring(c, 1, 1), F.lit(classes)), F.substring(c, F.lit(2), F.length(c)).cast("int")]
