"""The 65 exposure features of a picture, in the order in which a model takes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import ranked

# Percentiles of luma, bounds of the shares, and the level from which a channel is clipped.
PERCENTILES = (0.5, 5, 10, 25, 50, 75, 90, 95, 99, 99.5)
ABOVE, BELOW, BUCKETS, CLIPPED = (0.9, 0.8), (0.1, 0.2), 32, 254
CHANNELS = ("r", "g", "b")


def _p(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def names() -> list[str]:
    own = [f"{c}_{k}" for c in CHANNELS for k in ("mean", "p99_5", "clip")]
    shares = [f"above_{int(x * 10)}" for x in ABOVE] + [f"below_{int(x * 10)}" for x in BELOW]
    return [f"luma_{_p(p)}" for p in PERCENTILES] + own + ["r_minus_g", "b_minus_g", "r_by_g", "b_by_g"] + shares + ["span", "middle"] + [f"bucket_{i}" for i in range(BUCKETS)] + ["log_mean", "skew", "any_clip", "ev"]


def picture_features(pixels: DataFrame, ev: float | None = None) -> DataFrame:
    """One row with the columns of ``names``, from pixels (r, g, b) of 0..255. Equal pixels are counted before anything is ordered."""
    counts = pixels.groupBy(*CHANNELS).agg(F.count("*").alias("k"))
    luma = F.round((0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) / 255, 9)
    share = lambda c: (F.sum(F.when(c, F.col("k")).otherwise(0)) / F.sum("k"))
    mean = lambda c: F.sum(c * F.col("k")) / F.sum("k")
    clipped = {c: F.col(c) >= CLIPPED for c in CHANNELS}
    parts = [mean(luma).alias("l"), *(mean(F.col(c) / 255).alias(f"{c}_mean") for c in CHANNELS), *(share(clipped[c]).alias(f"{c}_clip") for c in CHANNELS)]
    parts += [share(luma > x).alias(f"above_{int(x * 10)}") for x in ABOVE] + [share(luma < x).alias(f"below_{int(x * 10)}") for x in BELOW]
    bucket = F.floor(luma * 31.99)
    parts += [share(bucket == i).alias(f"bucket_{i}") for i in range(BUCKETS)] + [share(clipped["r"] | clipped["g"] | clipped["b"]).alias("any")]
    one = counts.agg(*parts)
    values = pixels.select(F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), v.alias("v")) for n, v in (("luma", luma), *((c, F.col(c) / 255) for c in CHANNELS))])).alias("x")).select("x.*")
    at = ranked(values, ["channel"], "v", {_p(p): F.floor(p / 100 * (F.col("n") - 1)) for p in PERCENTILES})
    of = lambda c, p: F.max(F.when(F.col("channel") == c, F.col(_p(p)))).alias(f"{c}_{_p(p)}")
    ranks = at.agg(*[of("luma", p) for p in PERCENTILES], *[of(c, 99.5) for c in CHANNELS])
    all_ = one.crossJoin(F.broadcast(ranks))  # one row on either side
    g = F.col("g_mean") + 1e-6
    made: dict[str, Column] = {
        "r_minus_g": F.col("r_mean") - g, "b_minus_g": F.col("b_mean") - g, "r_by_g": F.col("r_mean") / g, "b_by_g": F.col("b_mean") / g,
        "span": F.col("luma_p99_5") - F.col("luma_p0_5"), "middle": F.col("luma_p75") - F.col("luma_p25"),
        "log_mean": F.log(F.col("l") + 1e-4), "skew": F.col("l") - F.col("luma_p50"), "any_clip": F.when(F.col("any") > 0.005, 1.0).otherwise(0.0), "ev": F.lit(float(ev or 0)),
    }
    return all_.select(*[F.round(made.get(n, F.col(n)).cast("double"), 6).alias(n) for n in names()])
