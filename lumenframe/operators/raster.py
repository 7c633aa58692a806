"""Raster families on pixels in long form (x, y, value columns): arithmetic, tables, neighbourhoods, tiles, layers, blends.

Neighbourhoods are made by sending each pixel to the places that see it, so one shuffle by place does for any radius and
no row of the picture has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Workspace
from .lookup import _small


def around(pixels: DataFrame, radius_x: int, radius_y: int, cross: bool = False) -> DataFrame:
    """Each pixel once for each place that sees it: its own x, y replaced by that place's; ``dx``, ``dy`` say from where."""
    steps = [(i, j) for i in range(-radius_x, radius_x + 1) for j in range(-radius_y, radius_y + 1) if not cross or i == 0 or j == 0]
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in steps])
    seen = pixels.withColumn("_o", F.explode(offsets)).select(*[c for c in pixels.columns if c not in ("x", "y")], (F.col("x") - F.col("_o.dx")).alias("x"), (F.col("y") - F.col("_o.dy")).alias("y"), F.col("_o.dx").alias("dx"), F.col("_o.dy").alias("dy"))
    return seen.join(pixels.select("x", "y"), ["x", "y"], "left_semi")


def box(pixels: DataFrame, value: str, radius: int) -> DataFrame:
    """Mean over the square around each place, shrinking at the edges."""
    return around(pixels, radius, radius).groupBy("x", "y").agg(F.avg(value).alias("mean"))


def median(pixels: DataFrame, value: str, radius_x: int, radius_y: int) -> DataFrame:
    """Upper median, ``v[n / 2]``, of the window clipped at the edges; its size is fixed by the radius."""
    v = F.sort_array(F.collect_list(value))
    return around(pixels, radius_x, radius_y).groupBy("x", "y").agg(v.alias("v")).select("x", "y", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("median"))


def mode(pixels: DataFrame, value: str, tile: int) -> DataFrame:
    """The most frequent value of each tile; of equally frequent ones the smallest."""
    counts = tiles(pixels, tile, tile).groupBy("tx", "ty", value).agg(F.count("*").alias("n"))
    return counts.groupBy("tx", "ty").agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))


def erode(mask: DataFrame, rounds: int) -> DataFrame:
    """Members (x, y) whose four neighbours are members, ``rounds`` times."""
    for _ in range(rounds):
        mask = around(mask, 1, 1, cross=True).groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 5").select("x", "y")
    return mask


def guided(pixels: DataFrame, guide: str, value: str, radius: int, eps: float) -> DataFrame:
    """Guided filter: local linear fit of value on guide, its coefficients averaged again, clamped to 0..1."""
    g, p = F.col(guide), F.col(value)
    stats = around(pixels, radius, radius).groupBy("x", "y").agg(F.avg(g).alias("mg"), F.avg(p).alias("mp"), F.avg(g * g).alias("gg"), F.avg(g * p).alias("gp"))
    a = (F.col("gp") - F.col("mg") * F.col("mp")) / (F.col("gg") - F.col("mg") * F.col("mg") + eps)
    fitted = stats.select("x", "y", a.alias("a"), "mg", "mp").withColumn("b", F.col("mp") - F.col("a") * F.col("mg")).select("x", "y", "a", "b")
    means = around(fitted, radius, radius).groupBy("x", "y").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return means.join(pixels.select("x", "y", guide), ["x", "y"]).select("x", "y", F.least(F.greatest(F.col("a") * F.col(guide) + F.col("b"), F.lit(0.0)), F.lit(1.0)).alias("out"))


def tiles(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.withColumn("tx", F.floor(F.col("x") / width)).withColumn("ty", F.floor(F.col("y") / height))


def lut(pixels: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``value`` replaced through a table (i, o)."""
    return pixels.join(_small(table), F.col(value) == F.col("i")).withColumn(value, F.col("o")).drop("i", "o")


def equalise(pixels: DataFrame, value: str) -> DataFrame:
    """Global histogram equalisation to 0..255."""
    from .stats import cdf, histogram

    table = cdf(histogram(pixels.select(F.lit(0).alias("c"), F.col(value).alias("bin")), ["c"]), ["c"])
    return lut(pixels, table.select(F.col("bin").alias("i"), F.floor(F.col("cdf") * 255 + 0.5).cast("int").alias("o")), value)


def equalise_tiles(pixels: DataFrame, value: str, tile: int, clip: float) -> DataFrame:
    """Per tile, counts above ``clip`` times the mean are cut and spread evenly, then each value is replaced by its CDF."""
    from .stats import cdf, histogram

    cut = tiles(pixels, tile, tile).withColumn("bin", F.col(value))
    hist = histogram(cut, ["tx", "ty"])
    from pyspark.sql import Window

    w = Window.partitionBy("tx", "ty")
    limit = F.sum("n").over(w) / 256.0 * clip
    hist = hist.withColumn("_l", limit).withColumn("_e", F.sum(F.greatest(F.col("n") - F.col("_l"), F.lit(0.0))).over(w) / 256.0).withColumn("n", F.least(F.col("n").cast("double"), F.col("_l")) + F.col("_e"))
    table = cdf(hist, ["tx", "ty"]).select("tx", "ty", "bin", F.floor(F.col("cdf") * 255 + 0.5).cast("int").alias("out"))
    return cut.join(table, ["tx", "ty", "bin"]).select("x", "y", "out")


def _labelled(cells: pd.DataFrame) -> pd.DataFrame:
    """Each cell of one tile with the first node, in reading order, of its set within the tile."""
    cells = cells.sort_values("node", kind="stable")
    x, y, node = cells["x"].tolist(), cells["y"].tolist(), cells["node"].tolist()
    at = dict(zip(zip(x, y), node))
    up = {n: n for n in node}

    def root(n: int) -> int:
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for i, j, n in zip(x, y, node):
        for near in ((i - 1, j), (i, j - 1)):
            if near in at:
                a, b = root(n), root(at[near])
                up[max(a, b)] = min(a, b)
    return cells[["node", "x", "y"]].assign(label=[root(n) for n in node])


def largest_component(mask: DataFrame, width: int, rounds: int = 60, tile: int = 128) -> DataFrame:
    """Label, size and bounding box of the largest 4-connected set of (x, y); of equally large ones the first in reading order.

    Sets are labelled in each tile first. Labels that touch across the sides of tiles are the nodes of a graph, whose
    components join them; so a long way through the picture costs rounds by its tiles, not by its cells.
    """
    from .components import min_labels

    cells = mask.select((F.col("y") * width + F.col("x")).cast("long").alias("node"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    kinds = dict(mask.select("x", "y", (F.col("y") * width + F.col("x")).alias("label")).dtypes)
    with Workspace(mask.sparkSession) as space:
        parts = space.written(tiles(cells, tile, tile).groupBy("tx", "ty").applyInPandas(_labelled, "node long, x long, y long, label long"))
        right = parts.where((F.col("x") % tile == tile - 1) & (F.col("x") != width - 1)).select((F.col("node") + 1).alias("to"), "label")
        down = parts.where(F.col("y") % tile == tile - 1).select((F.col("node") + width).alias("to"), "label")
        firsts = parts.where((F.col("x") % tile == 0) | (F.col("y") % tile == 0)).select(F.col("node").alias("to"), F.col("label").alias("other"))
        links = space.written(right.unionByName(down).join(firsts, "to").select(F.col("label").alias("node"), "other").distinct())
        met = min_labels(links.select("node").unionByName(links.select(F.col("other").alias("node"))).distinct(), links, rounds)
        box = [f(c).alias(a) for a, f, c in (("x0", F.min, "x0"), ("x1", F.max, "x1"), ("y0", F.min, "y0"), ("y1", F.max, "y1"))]
        pieces = parts.groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        joined = pieces.withColumnRenamed("label", "node").join(met, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = joined.groupBy("label").agg(F.sum("n").alias("n"), *box)
        best = sizes.orderBy(F.desc("n"), "label").limit(1)
        return space.kept(best.select(F.col("label").cast(kinds["label"]), "n", *[F.col(c).cast(kinds[c[0]]).alias(c) for c in ("x0", "x1", "y0", "y1")]))


#: Separable blend modes of a source s over a destination d, both in 0..1, by their published formulas.
BLENDS: dict[str, Callable[[Column, Column], Column]] = {
    "clear": lambda s, d: F.lit(0.0),
    "src": lambda s, d: s,
    "dst": lambda s, d: d,
    "plus": lambda s, d: F.least(s + d, F.lit(1.0)),
    "multiply": lambda s, d: s * d,
    "screen": lambda s, d: s + d - s * d,
    "overlay": lambda s, d: F.when(d <= 0.5, 2 * s * d).otherwise(1 - 2 * (1 - s) * (1 - d)),
    "darken": lambda s, d: F.least(s, d),
    "lighten": lambda s, d: F.greatest(s, d),
    "color_dodge": lambda s, d: F.when(d == 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), d / F.nullif(1 - s, F.lit(0.0)))),
    "color_burn": lambda s, d: F.when(d >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - d) / F.nullif(s, F.lit(0.0)))),
    "hard_light": lambda s, d: F.when(s <= 0.5, 2 * s * d).otherwise(1 - 2 * (1 - s) * (1 - d)),
    "soft_light": lambda s, d: F.when(s <= 0.5, d - (1 - 2 * s) * d * (1 - d)).otherwise(d + (2 * s - 1) * (F.when(d <= 0.25, ((16 * d - 12) * d + 4) * d).otherwise(F.sqrt(d)) - d)),
    "difference": lambda s, d: F.abs(s - d),
    "exclusion": lambda s, d: s + d - 2 * s * d,
}


def uppermost(layers: DataFrame, layer: str, value: str) -> DataFrame:
    """Of the layers that cover a place, one row each: ``top``, the value of the highest, and ``shown``, how many there are."""
    return layers.groupBy("x", "y").agg(F.max_by(value, layer).alias("top"), F.count("*").cast("int").alias("shown"))
