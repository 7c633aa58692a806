"""Statistics over levels and pixels: histograms, percentiles by each rule the editor uses, matching, differences.

Histograms are aggregated before anything is ordered, so windows only ever run over 256 bins per channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as s

BINS = 256


def histogram(levels: DataFrame, channel: list[str], bin_: str = "bin", bins: int = BINS) -> DataFrame:
    """Dense: every channel has every bin."""
    spark = levels.sparkSession
    counts = levels.groupBy(*channel, bin_).agg(F.count("*").alias("n"))
    spine = counts.select(*channel).distinct().crossJoin(F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias(bin_))))
    return spine.join(counts, [*channel, bin_], "left").fillna(0, ["n"])


def cdf(hist: DataFrame, channel: list[str], bin_: str = "bin") -> DataFrame:
    """Cumulated and total counts; ``cdf`` is uniform where a channel is empty."""
    w = Window.partitionBy(*channel)
    up = w.orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumn("cum", F.sum("n").over(up)).withColumn("total", F.sum("n").over(w))
    return out.withColumn("cdf", F.when(F.col("total") > 0, F.col("cum") / F.col("total")).otherwise((F.col(bin_) + 1) / F.lit(float(BINS))))


def percentiles(hist: DataFrame, channel: list[str], shares: dict[str, float]) -> DataFrame:
    """Per share the first bin whose cumulated count reaches trunc(total * share), and the share of bins from 253."""
    c = cdf(hist, channel)
    first = lambda q: F.min(F.when(F.col("cum") >= F.floor(F.col("total") * q), F.col("bin")))
    return c.groupBy(*channel).agg(*[first(q).alias(n) for n, q in shares.items()], (F.sum(F.when(F.col("bin") >= 253, F.col("n")).otherwise(0)) / F.max("total")).alias("clip"))


def drives(stats: DataFrame) -> DataFrame:
    """From p1, p90, p99, clip: dynamic range, headroom and the three drives."""
    low = F.greatest("p1", F.lit(1))
    span = s.clamp(F.log2(F.greatest(F.col("p99"), low + 1) / low), 4.0, 14.0)
    room = s.clamp(F.log2(255.0 / F.greatest("p90", F.lit(1))), 0.0, 3.0)
    out = stats.withColumn("range", span).withColumn("headroom", room)
    return out.select(
        "*", F.when(F.col("range") > 10, s.clamp((F.col("range") - 10) / 4, 0.0, 1.0)).otherwise(0.0).alias("rolloff"),
        F.when(F.col("clip") > 0.02, s.clamp(F.col("clip"), 0.0, 1.0)).otherwise(0.0).alias("compress"), F.when(F.col("headroom") < 0.5, s.clamp(1 - F.col("headroom") * 2, 0.0, 1.0)).otherwise(0.0).alias("recovery"),
    )


def smooth_monotone(curve: DataFrame, channel: list[str], at: str, value: str, radius: int = 2) -> DataFrame:
    """Centred moving average, shrinking at the ends, rounded half up; then the running maximum."""
    w = Window.partitionBy(*channel).orderBy(at)
    out = curve.withColumn("_s", F.floor(F.avg(value).over(w.rowsBetween(-radius, radius)) + 0.5))
    return out.withColumn("smooth", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def match(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Histogram specification on dense CDFs (bin, cdf): for each source bin the first reference bin whose CDF is not below; 255 if none. 256 by 256 rows."""
    ref = reference.select(F.col("bin").alias("out"), F.col("cdf").alias("_ref"))
    return source.join(F.broadcast(ref), F.col("_ref") >= F.col("cdf"), "left").groupBy(*[c for c in source.columns if c not in ("n", "cum", "total")]).agg(F.coalesce(F.min("out"), F.lit(BINS - 1)).alias("out"))


def compose(f: DataFrame, g: DataFrame) -> DataFrame:
    """Table of f after g, both (i, o)."""
    return g.select("i", F.col("o").alias("_m")).join(f.select(F.col("i").alias("_m"), F.col("o")), "_m").select("i", "o")


def ranked(rows: DataFrame, key: list[str], value: str | Column, ranks: dict[str, Column]) -> DataFrame:
    """Values at 0-based ranks of the ascending order; a rank is an expression of the count ``n``."""
    v = F.col(value) if isinstance(value, str) else value
    counts = rows.select(*key, v.alias("_v")).groupBy(*key, "_v").agg(F.count("*").alias("_c"))  # windows run over different values only
    w = Window.partitionBy(*key)
    cum = counts.withColumn("_cum", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(w))
    at = lambda r: F.min_by("_v", F.when(F.col("_cum") > F.least(r, F.col("n") - 1), F.col("_cum")))
    return cum.groupBy(*key).agg(*[at(r).alias(name) for name, r in ranks.items()])


def image_metrics(pixels: DataFrame, key: list[str]) -> DataFrame:
    y = s.luma(F.col("r"), F.col("g"), F.col("b"))
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    means = pixels.groupBy(*key).agg(F.avg(y).alias("luma"), F.avg(spread).alias("chroma"), F.sum("r").alias("_r"), F.sum("b").alias("_b"))
    n = F.col("n")
    spans = ranked(pixels, key, y, {"p10": F.floor(n * 0.1), "p90": F.floor(n * 0.9)})
    return means.join(spans, key).select(*key, "luma", "chroma", s.kelvin_estimate(F.col("_r").cast("double"), F.col("_b").cast("double")).alias("kelvin"), (F.col("p90") - F.col("p10")).alias("span"))


def differences(a: DataFrame, b: DataFrame, key: list[str], value: str, peak: float, psnr_of_equal: float) -> DataFrame:
    """Mean absolute, mean squared, largest difference and PSNR of two pictures joined by place."""
    both = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key)
    d = F.col("_a") - F.col("_b")
    out = both.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("worst"))
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("psnr", F.when(F.col("mse") == 0, psnr_of_equal).otherwise(10 * F.log10(peak * peak / F.nullif(F.col("mse"), F.lit(0.0)))))


def best_slope(points: DataFrame, slopes: int, step: float, bound: float) -> DataFrame:
    """Of ``slopes`` candidates, the first with the most points (x, y) whose residual is within the bound."""
    groups = points.groupBy("x", "y").agg(F.count("*").alias("_n"))  # equal points are swept once
    swept = groups.join(F.broadcast(points.sparkSession.range(slopes).select(F.col("id").alias("k"))), F.abs(F.col("y") - F.col("x") * F.col("k") * step) < bound)
    return swept.groupBy("k").agg(F.sum("_n").alias("inliers")).orderBy(F.desc("inliers"), "k").limit(1)


def shift_vectors(blocks: DataFrame, key: list[str], most: int) -> DataFrame:
    """Blocks equal to the next one in their order, grouped by shift; shifts that occur more than ``most`` times."""
    w = Window.partitionBy(*key).orderBy("y", "x")
    pairs = blocks.select("x", "y", (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy")).where("dx is not null")
    frequent = pairs.groupBy("dx", "dy").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return pairs.join(frequent, ["dx", "dy"])


def with_next(rows: DataFrame, at: str, value: str, shard: int = 4096) -> DataFrame:
    """``next``: the value of the row behind, by the whole number ``at``. Windows run over ``shard`` places each and over one row for each shard."""
    cut = rows.withColumn("_s", F.floor(F.col(at) / shard))
    heads = cut.groupBy("_s").agg(F.min_by(F.struct(value), at).alias("_h"))
    behind = heads.select("_s", F.lead("_h").over(Window.orderBy("_s")).alias("_h"))
    own = F.lead(F.struct(value)).over(Window.partitionBy("_s").orderBy(at))
    return cut.withColumn("_o", own).join(behind, "_s").select(*rows.columns, F.coalesce("_o", "_h")[value].alias("next"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(key, "n", (F.col("n") / F.col("_all")).alias("share"))


def standardised(rows: DataFrame, column: str, tiny: float = 1e-9) -> DataFrame:
    """(x - mean) / deviation, and min-max scaled; a tiny scale counts as 1."""
    m = rows.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_d"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    safe = lambda x: F.when(F.abs(x) < tiny, 1.0).otherwise(x)
    return rows.crossJoin(F.broadcast(m)).withColumn("z", (F.col(column) - F.col("_m")) / safe(F.col("_d"))).withColumn("unit", (F.col(column) - F.col("_lo")) / safe(F.col("_hi") - F.col("_lo"))).drop("_m", "_d", "_lo", "_hi")
