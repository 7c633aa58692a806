"""Convex hulls: of each tile's points first, then of what the tiles have left."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The corners of the convex hull, counter-clockwise from the leftmost (of those the lowest); none on a straight side."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def side(row: list) -> list:
        out: list = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return side(points) + side(points[::-1])


def hulls(points: DataFrame, groups: list[str], tile: int, levels: int = 3, fan: int = 8) -> DataFrame:
    """groups, corner (from 0), x, y: the hull of each group's points.

    Points meet in tiles of ``tile``, whose corners meet in tiles ``fan`` times as wide, and so on ``levels`` times, before
    they meet by group: a hull of n points of a grid has few corners, some n^(1/3), so no task holds many points. Spark keeps
    the ends of each row and column of a tile; a tile is then one row with lists, as a call for each costs more than its hull.
    """

    kinds = {f.name: f.dataType.simpleString() for f in points.select(*groups, "x", "y").schema}

    def ends(df: DataFrame, by: list[str], along: str, across: str) -> DataFrame:
        """The first and the last point of each line, as no corner lies between two others."""
        two = df.groupBy(*by, across).agg(F.array_distinct(F.array(F.min(along), F.max(along))).alias("_e"))
        return two.select(*by, F.explode("_e").alias(along), across)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            each = [hull(list(zip(x.tolist(), y.tolist()))) for x, y in zip(rows["xs"], rows["ys"])]
            out = rows[groups].iloc[[k for k, c in enumerate(each) for _ in c]].reset_index(drop=True)
            flat = [p for c in each for p in c]
            yield out.assign(x=[p[0] for p in flat], y=[p[1] for p in flat], corner=[k for c in each for k in range(len(c))])

    def corners(df: DataFrame, by: list[str]) -> DataFrame:
        rows = ends(ends(df, by, "x", "y").repartition(*by), by, "y", "x")  # what follows the repartition stays in its tasks
        lists = rows.groupBy(*by).agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))  # of the same rows, so in the same order
        return lists.mapInPandas(found, ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", corner int")

    rows = points.select(*groups, "x", "y").where("x is not null and y is not null")
    for _ in range(levels):
        rows = corners(rows.withColumn("_i", F.floor(F.col("x") / tile)).withColumn("_j", F.floor(F.col("y") / tile)), [*groups, "_i", "_j"]).drop("corner")
        tile *= fan
    return corners(rows, groups).select(*groups, "corner", "x", "y")
