"""Vectors and boxes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def overlap_of_own_area(box: Column, other: Column) -> Column:
    """Share of a box's area that another covers."""
    w = F.least(box["x1"], other["x1"]) - F.greatest(box["x0"], other["x0"])
    h = F.least(box["y1"], other["y1"]) - F.greatest(box["y0"], other["y0"])
    area = F.greatest((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]), F.lit(1e-6))
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / area)


def union_box(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))
