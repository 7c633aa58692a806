"""Local contrast: histogram equalisation by tiles, clipped, and blended between the tables of the four nearest tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _round(c: Column) -> Column:
    return F.floor(F.round(c, 9) + 0.5)


def _byte(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")


def tile_tables(pixels: DataFrame, value: str, tile: int, clip: float) -> DataFrame:
    """(tx, ty, table): what each value of 0..255 becomes in the tile, an array of 256.

    Counts above a limit, ``clip`` times the mean of a full tile and 1 at least, are cut; what is cut goes to all values
    evenly, and the rest that does not divide to the first ones, one each.
    """
    limit = max(1, int(clip * tile * tile / 256 + 0.5))
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    counts = pixels.groupBy(at("x").alias("tx"), at("y").alias("ty"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    tiles = counts.groupBy("tx", "ty").agg(F.sum("n").alias("n"), F.sum(F.greatest(F.col("n") - limit, F.lit(0))).alias("cut"), F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))  # 256 entries at most
    share, rest = F.floor(F.col("cut") / 256), F.col("cut") % 256
    hist = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.least(F.coalesce(F.try_element_at("m", i), F.lit(0)), F.lit(limit)) + share + (i < rest).cast("int"))
    sums = F.aggregate(hist, F.array().cast("array<bigint>"), lambda done, n: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("bigint")) + n)))
    return tiles.select("tx", "ty", F.transform(sums, lambda c: _byte(_round(c * 255.0 / F.col("n")))).alias("table"))


def local_contrast(pixels: DataFrame, tile: int = 8, clip: float = 2.0, shadows: float = 1.0, highlights: float = 0.6) -> DataFrame:
    """x, y, r, g, b after equalisation; ``shadows`` and ``highlights`` (0..1) say how much of it dark and bright places get.

    x and y begin at 0. The luma decides; the colours keep their ratios, or where it is 4 or less their differences.
    """
    luma = F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000).cast("int")
    rows = pixels.select("x", "y", "r", "g", "b", luma.alias("l"))
    ends = rows.agg(F.floor(F.max("x") / tile).alias("last_x"), F.floor(F.max("y") / tile).alias("last_y"))  # one row
    rows = rows.crossJoin(F.broadcast(ends))

    def near(c: str) -> tuple[Column, Column]:
        """The tiles on both sides of a place, whose middles it lies between, and their weights."""
        last = F.col(f"last_{c}")
        t = F.least(F.greatest((F.col(c) - tile / 2.0) / tile, F.lit(0.0)), last.cast("double"))
        low = F.floor(t).cast("int")
        return F.array(F.struct(low.alias("t"), (1 - (t - low)).alias("w")), F.struct(F.least(low + 1, last).cast("int").alias("t"), (t - low).alias("w")))

    met = rows.withColumn("i", F.explode(near("x"))).withColumn("j", F.explode(near("y"))).where("i.w > 0 and j.w > 0")
    met = met.join(tile_tables(rows, "l", tile, clip), (F.col("i.t") == F.col("tx")) & (F.col("j.t") == F.col("ty")))
    even = met.groupBy("x", "y", "r", "g", "b", "l").agg(F.sum(F.element_at("table", F.col("l") + 1) * F.col("i.w") * F.col("j.w")).alias("e"))
    bright = 1 / (1 + F.exp(-4 * (F.col("l") / 255.0 - 0.5)))
    w = bright * highlights + (1 - bright) * shadows
    new = even.withColumn("new", F.col("l") * (1 - w) + F.col("e") * w)
    out = lambda c: _byte(F.when(F.col("l") > 4, _round(F.col(c) * F.col("new") / F.col("l"))).otherwise(F.col(c) + _round(F.col("new") - F.col("l")))).alias(c)
    return new.select("x", "y", out("r"), out("g"), out("b"))
