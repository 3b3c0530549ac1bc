"""Vectors and geometry over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def valid_unit_vector(a: Column, size: int, tolerance: float = 1e-4) -> Column:
    return (F.size(a) == size) & ~F.exists(a, lambda v: F.isnan(v) | v.isNull()) & (F.abs(norm(a) - 1) <= tolerance)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def polyline_length(points: Column) -> Column:
    return F.when(F.size(points) > 1, F.aggregate(F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), distance), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def symmetric_distance(a: Column, b: Column) -> Column:
    """Mean distance of the points of two polylines, whichever way the second one runs."""
    mean = lambda other: F.aggregate(F.zip_with(a, other, distance), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.least(mean(b), mean(F.reverse(b)))


def bounding_box(points: Column) -> Column:
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def iou(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def in_box(point: Column, box: Column, enlarged: float = 0.0) -> Column:
    dx, dy = (box[2] - box[0]) * enlarged, (box[3] - box[1]) * enlarged
    return point[0].between(box[0] - dx, box[2] + dx) & point[1].between(box[1] - dy, box[3] + dy)


def scaled(points: Column, width: Column, height: Column, full: float = 1000.0) -> Column:
    """Points of a 0 to ``full`` grid in pixels."""
    return F.transform(points, lambda p: F.array(p[0] * width / full, p[1] * height / full))


def half_up(c: Column, digits: int = 1) -> Column:
    """Rounding as floor(x * 10**digits + 0.5), halves towards positive infinity."""
    return F.floor(c * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)
