"""Plane geometry as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def turn(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area of the triangle: above 0 for a left turn, below for a right one, 0 for a line."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def in_circle(p: Point, centre: Point, radius: Column) -> Column:
    dx, dy = p[0] - centre[0], p[1] - centre[1]
    return dx * dx + dy * dy <= radius * radius


def in_polygon(p: Point, corners: list[tuple[float, float]]) -> Column:
    """By the parity of edges that a ray to the right crosses; corners in order, the last joined to the first."""
    crossings = []
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 != y1:
            at = F.lit(x0) + (p[1] - y0) * ((x1 - x0) / (y1 - y0))
            crossings.append((((p[1] < y0) != (p[1] < y1)) & (p[0] < at)).cast("int"))
    return reduce(Column.__add__, crossings) % 2 == 1


def line_crossing(a: Point, b: Point, c: Point, d: Point) -> Column:
    """struct(x, y) where the lines a-b and c-d cross; null for parallel ones."""
    ab, cd = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    across = ab[0] * cd[1] - ab[1] * cd[0]
    t = ((c[0] - a[0]) * cd[1] - (c[1] - a[1]) * cd[0]) / F.nullif(across, F.lit(0.0))
    return F.when(across != 0, F.struct((a[0] + t * ab[0]).alias("x"), (a[1] + t * ab[1]).alias("y")))
