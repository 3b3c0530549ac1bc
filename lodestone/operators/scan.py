"""Running sums and nearest known values in groups of any size.

A window over a group is one task for all of its rows. Here rows are dealt into ranges of (group, order), so that a group of very many rows
is many tasks; each range has its own running values, and what the ranges before (or behind) hold of the same group is carried
over. Only a group that goes over an end of a range is carried: at most two rows for each range, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import cut


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None, nexts: Mapping[str, Column] | None = None, before: bool = False) -> DataFrame:
    """``df`` with running values in each group, by ascending ``order`` (which should leave no ties).

    ``sums`` are totals up to the row, ``lasts`` the last values that aren't null up to the row, ``nexts`` the first ones behind it. With
    ``before`` the row itself doesn't count in sums (0 in the first row) and lasts. Nulls are a group of their own; null terms count as 0.
    """
    sums, lasts, nexts = dict(sums or {}), dict(lasts or {}), dict(nexts or {})
    named = {f"_in_{k}": c for k, c in (sums | lasts | nexts).items()}
    ranges = df.withColumns(named).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    spread = cut(ranges)  # the bounds are samples: both uses need the same ones
    place = F.struct(*order)
    held = spread.groupBy("_part", *by).agg(
        *[F.sum(f"_in_{k}").alias(f"_out_{k}") for k in sums],
        *[F.max_by(f"_in_{k}", F.when(F.col(f"_in_{k}").isNotNull(), place)).alias(f"_out_{k}") for k in lasts],
        *[F.min_by(f"_in_{k}", F.when(F.col(f"_in_{k}").isNotNull(), place)).alias(f"_out_{k}") for k in nexts],
        F.lit(1).alias("_one"),
    )
    several = held.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.collect_list(F.struct("_part", *[f"_out_{k}" for k in named_keys(sums, lasts, nexts)])).alias("_held")).filter(F.size("_held") > 1)
    each = several.select(*[f"_by_{c}" for c in by], F.explode("_held").alias("_h")).select(*[f"_by_{c}" for c in by], "_h.*").withColumnRenamed("_part", "_at")
    earlier = Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(
        "_at",
        *[f"_by_{c}" for c in by],
        *[F.sum(f"_out_{k}").over(earlier).alias(f"_carry_{k}") for k in sums],
        *[F.last(f"_out_{k}", ignorenulls=True).over(earlier).alias(f"_carry_{k}") for k in lasts],
        *[F.last(f"_out_{k}", ignorenulls=True).over(later).alias(f"_carry_{k}") for k in nexts],
    )
    own = Window.partitionBy("_part", *by).orderBy(*order)
    up_to = own.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    # what follows a row is what comes before it the other way round: Spark goes over a frame with an open end anew for each row
    behind = Window.partitionBy("_part", *by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumns(
        {f"_own_{k}": F.sum(f"_in_{k}").over(up_to) for k in sums} | {f"_own_{k}": F.last(f"_in_{k}", ignorenulls=True).over(up_to) for k in lasts} | {f"_own_{k}": F.last(f"_in_{k}", ignorenulls=True).over(behind) for k in nexts}
    )
    same = F.col("_part") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = local.join(F.broadcast(carried), same, "left")  # at most two rows for each range
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(f"_own_{k}", zero) + F.coalesce(f"_carry_{k}", zero)).alias(k) for k in sums],
        *[F.coalesce(f"_own_{k}", f"_carry_{k}").alias(k) for k in (*lasts, *nexts)],
    )


def named_keys(*values: Mapping[str, Column]) -> list[str]:
    return [k for v in values for k in v]
