"""Queries of statistics, raster families, XPath and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import raster, stats
from ..sources.shared import spread
from ..streaming import reactive
from .registry import query

HIST = ", h AS (SELECT c.channel, b.bin::INTEGER AS bin, count(l.bin) AS n FROM (SELECT DISTINCT channel FROM levels) c CROSS JOIN range(256) b(bin) LEFT JOIN levels l ON l.channel = c.channel AND l.bin = b.bin GROUP BY ALL), c AS (SELECT *, (sum(n) OVER (PARTITION BY channel ORDER BY bin))::BIGINT AS cum, (sum(n) OVER (PARTITION BY channel))::BIGINT AS total FROM h)"
PCT = HIST + ", p AS (SELECT channel, min(CASE WHEN cum >= floor(total * 0.01) THEN bin END) AS p1, min(CASE WHEN cum >= floor(total * 0.90) THEN bin END) AS p90, min(CASE WHEN cum >= floor(total * 0.99) THEN bin END) AS p99, sum(CASE WHEN bin >= 253 THEN n ELSE 0 END) / max(total) AS clip FROM c GROUP BY channel)"


def _hist(v):
    return stats.histogram(v.levels, ["channel"])


@query("histogram", "AG11", HIST + " SELECT channel, bin, n FROM h")
def _(v):
    return _hist(v)


@query("cdf", "W1", HIST + " SELECT channel, bin, cum, round(cum / total, 9) AS cdf FROM c")
def _(v):
    return stats.cdf(_hist(v), ["channel"]).select("channel", "bin", "cum", F.round("cdf", 9).alias("cdf"))


@query("percentiles", "AG12", PCT + " SELECT channel, p1, p90, p99, round(clip, 9) AS clip FROM p")
def _(v):
    return stats.percentiles(_hist(v), ["channel"], {"p1": 0.01, "p90": 0.9, "p99": 0.99}).withColumn("clip", F.round("clip", 9))


@query("drives", "AG13 AG14", PCT + ", d AS (SELECT channel, clip, least(greatest(log2(greatest(p99, greatest(p1, 1) + 1) / greatest(p1, 1)), 4), 14) AS span, least(greatest(log2(255.0 / greatest(p90, 1)), 0), 3) AS headroom FROM p) SELECT channel, round(span, 6) AS span, round(headroom, 6) AS headroom, round(CASE WHEN span > 10 THEN least((span - 10) / 4, 1) ELSE 0 END, 6)::DOUBLE AS rolloff, round(CASE WHEN clip > 0.02 THEN clip ELSE 0 END, 6)::DOUBLE AS compress, round(CASE WHEN headroom < 0.5 THEN 1 - headroom * 2 ELSE 0 END, 6)::DOUBLE AS recovery FROM d")
def _(v):
    d = stats.drives(stats.percentiles(_hist(v), ["channel"], {"p1": 0.01, "p90": 0.9, "p99": 0.99}))
    return d.select("channel", *[F.round(c, 6).alias(n) for n, c in (("span", "range"), ("headroom", "headroom"), ("rolloff", "rolloff"), ("compress", "compress"), ("recovery", "recovery"))])


@query("smooth_curve", "W2 W3", HIST + ", s AS (SELECT channel, bin, floor(avg(n) OVER (PARTITION BY channel ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + 0.5)::BIGINT AS v FROM h) SELECT channel, bin, max(v) OVER (PARTITION BY channel ORDER BY bin) AS smooth FROM s")
def _(v):
    return stats.smooth_monotone(_hist(v), ["channel"], "bin", "n").select("channel", "bin", "smooth")


@query("histogram_match", "W4", HIST + ", a AS (SELECT bin, cum / total AS cdf FROM c WHERE channel = 'A'), r AS (SELECT bin, cum / total AS cdf FROM c WHERE channel = 'R') SELECT a.bin, coalesce(min(r.bin), 255)::INTEGER AS out FROM a LEFT JOIN r ON r.cdf >= a.cdf GROUP BY a.bin")
def _(v):
    c = stats.cdf(_hist(v), ["channel"])
    pick = lambda x: c.where(F.col("channel") == x).select("bin", "cdf")
    return stats.match(pick("A"), pick("R")).select("bin", F.col("out").cast("int").alias("out"))


@query("lut_compose", "W5", """
, h AS (SELECT c.channel, b.bin::INTEGER AS bin, count(l.bin) AS n FROM (VALUES ('A'), ('R')) c(channel) CROSS JOIN range(256) b(bin) LEFT JOIN levels l ON l.channel = c.channel AND l.bin = b.bin GROUP BY ALL),
t AS (SELECT channel, bin, floor(round(sum(n) OVER (PARTITION BY channel ORDER BY bin)::DOUBLE / sum(n) OVER (PARTITION BY channel) * 255, 9) + 0.5)::INTEGER AS o FROM h)
SELECT g.bin AS i, f.o FROM t g JOIN t f ON f.bin = g.o WHERE g.channel = 'R' AND f.channel = 'A'""")
def _(v):
    """The equalising table of one channel, and then that of another, as one table."""
    tables = stats.cdf(stats.histogram(v.levels, ["channel"]), ["channel"])
    of = lambda c: tables.where(F.col("channel") == c).select(F.col("bin").cast("int").alias("i"), F.floor(F.round(F.col("cdf") * 255, 9) + 0.5).cast("int").alias("o"))
    return stats.compose(of("A"), of("R"))


@query("threshold_shares", "AG16", "SELECT channel, round(avg(CASE WHEN bin / 255.0 > 0.80 THEN 1.0 ELSE 0 END), 9) AS bright, round(avg(CASE WHEN bin * 1.25 / 255.0 > 0.96 THEN 1.0 ELSE 0 END), 9) AS gained FROM levels GROUP BY channel")
def _(v):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return v.levels.groupBy("channel").agg(share(F.col("bin") / 255.0 > 0.8).alias("bright"), share(F.col("bin") * 1.25 / 255.0 > 0.96).alias("gained"))


@query("rank_rules", "AG17 AG18 KN9", """
, k AS (SELECT plane, channel, bin, row_number() OVER (PARTITION BY plane, channel ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY plane, channel) AS n FROM levels)
SELECT plane, channel, max(CASE WHEN k = (n - 1) // 2 THEN bin END) AS lower_median, max(CASE WHEN k = n // 2 THEN bin END) AS upper_median, max(CASE WHEN k = least(n * 98 // 100, n - 1) THEN bin END) AS p98, max(CASE WHEN k = least(n * 999 // 1000, n - 1) THEN bin END) AS p999 FROM k GROUP BY ALL""")
def _(v):
    n = F.col("n")
    return stats.ranked(v.levels, ["plane", "channel"], "bin", {"lower_median": F.floor((n - 1) / 2), "upper_median": F.floor(n / 2), "p98": F.floor(n * 98 / 100), "p999": F.floor(n * 999 / 1000)})


@query("robust_slope", "AG19", """
, pts AS (SELECT bin::DOUBLE AS x, v * 5 AS y, count(*) AS n FROM levels GROUP BY ALL),
k AS (SELECT k, sum(n)::BIGINT AS inliers FROM pts, range(3000) t(k) WHERE abs(y - x * k * 0.001) < 20 GROUP BY k) SELECT k, inliers FROM k ORDER BY inliers DESC, k LIMIT 1""")
def _(v):
    pts = v.levels.select(F.col("bin").cast("double").alias("x"), (F.col("v") * 5).alias("y"))
    return stats.best_slope(pts, 3000, 0.001, 20.0)


@query("lag_difference", "AG20", ", l AS (SELECT y, abs(log2(r + 1.0) - log2(lag(r, 2) OVER (PARTITION BY y ORDER BY x) + 1.0)) AS d FROM pix) SELECT y, round(avg(d), 6) AS mean, avg(d) > 0.5 AS differs FROM l WHERE d IS NOT NULL GROUP BY y")
def _(v):
    d = F.abs(F.log2(F.col("r") + 1.0) - F.log2(F.lag("r", 2).over(Window.partitionBy("y").orderBy("x")) + 1.0))
    m = v.pix.select("y", d.alias("d")).where("d is not null").groupBy("y").agg(F.avg("d").alias("m"))
    return m.select("y", F.round("m", 6).alias("mean"), (F.col("m") > 0.5).alias("differs"))


@query("plane_cdf_distance", "AG21", ", h AS (SELECT p.plane, b.bin, count(l.bin) AS n FROM range(4) p(plane) CROSS JOIN range(256) b(bin) LEFT JOIN levels l ON l.plane = p.plane AND l.bin = b.bin GROUP BY ALL), c AS (SELECT plane, bin, sum(n) OVER (PARTITION BY plane ORDER BY bin) / sum(n) OVER (PARTITION BY plane) AS cdf FROM h) SELECT b.plane::INTEGER AS plane, round(sum(abs(a.cdf - b.cdf)), 6) AS distance FROM c a JOIN c b ON a.bin = b.bin AND a.plane = 0 AND b.plane > 0 GROUP BY 1")
def _(v):
    c = stats.cdf(stats.histogram(v.levels, ["plane"]), ["plane"]).select("plane", "bin", "cdf")
    base = c.where("plane = 0").select("bin", F.col("cdf").alias("_c"))
    return c.where("plane > 0").join(F.broadcast(base), "bin").groupBy("plane").agg(F.round(F.sum(F.abs(F.col("cdf") - F.col("_c"))), 6).alias("distance"))


@query("picture_difference", "AG23 AG24", ", d AS (SELECT abs(a.r - a.g)::DOUBLE AS d FROM pix a), m AS (SELECT avg(d) AS mae, avg(d * d) AS mse, max(d) AS worst FROM d) SELECT round(mae, 6) AS mae, round(mse, 6) AS mse, worst, round(sqrt(mse), 6) AS rmse, round(CASE WHEN mse = 0 THEN 100 ELSE 10 * log10(65025.0 / mse) END, 6)::DOUBLE AS psnr FROM m")
def _(v):
    a, b = v.pix.select("x", "y", F.col("r").cast("double").alias("v")), v.pix.select("x", "y", F.col("g").cast("double").alias("v"))
    return stats.differences(a, b, ["x", "y"], "v", 255.0, 100.0).select(F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"), "worst", F.round("rmse", 6).alias("rmse"), F.round("psnr", 6).alias("psnr"))


@query("copied_blocks", "AG25 J12 SO13", ", p AS (SELECT x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pix WINDOW w AS (PARTITION BY r // 64, g // 64 ORDER BY y, x)), f AS (SELECT dx, dy, count(*) AS n FROM p WHERE dx IS NOT NULL GROUP BY ALL HAVING count(*) > 3) SELECT p.x, p.y, dx, dy, n FROM p JOIN f USING (dx, dy)")
def _(v):
    blocks = v.pix.select("x", "y", F.floor(F.col("r") / 64).alias("kr"), F.floor(F.col("g") / 64).alias("kg"))
    return stats.shift_vectors(blocks, ["kr", "kg"], 3).select("x", "y", "dx", "dy", "n")


@query("palette", "AG26", "SELECT bin // 32 AS color, count(*) AS n, round(count(*) / (SELECT count(*) FROM levels), 9) AS share FROM levels GROUP BY 1 ORDER BY n DESC, color")
def _(v):
    return stats.shares(v.levels.select(F.floor(F.col("bin") / 32).cast("int").alias("color")), "color").select("color", "n", F.round("share", 9).alias("share")).orderBy(F.desc("n"), "color")


@query("best_segment", "AG27 W6", ", l AS (SELECT y, avg(r) AS m FROM pix GROUP BY y), s AS (SELECT y, (m + lead(m) OVER (ORDER BY y)) / 2 * (y % 5 + 1) AS score FROM l) SELECT y, round(score, 6) AS score FROM s WHERE score IS NOT NULL ORDER BY s.score DESC, y LIMIT 1")
def _(v):
    rows = stats.with_next(v.pix.groupBy("y").agg(F.avg("r").alias("m")), "y", "m")
    score = (F.col("m") + F.col("next")) / 2 * (F.col("y") % 5 + 1)
    return rows.select("y", score.alias("_s")).where("_s is not null").orderBy(F.desc("_s"), "y").limit(1).select("y", F.round("_s", 6).alias("score"))


@query("normalised", "AG30 AG31", ", m AS (SELECT avg(bin) AS m, stddev_pop(bin) AS d, min(bin) AS lo, max(bin) AS hi FROM levels) SELECT seq, round((bin - m) / d, 6) AS z, round((bin - lo) / (hi - lo), 6) AS unit FROM levels, m")
def _(v):
    return stats.standardised(v.levels.select("seq", "bin"), "bin").select("seq", F.round("z", 6).alias("z"), F.round("unit", 6).alias("unit"))


@query("features", "KN1", """
, k AS (SELECT channel, bin, row_number() OVER (PARTITION BY channel ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM levels)
SELECT channel, """ + ", ".join(f"max(CASE WHEN k = floor({q} * (n - 1)) THEN bin END) AS p{int(q * 1000)}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.995)) + """, round(avg(bin), 6) AS mean, round(avg(ln(bin + 1.0)), 6) AS log_mean, round(avg(CASE WHEN bin >= 253 THEN 1.0 ELSE 0 END), 9) AS clip, count(*) FILTER (WHERE bin < 8) AS bucket0 FROM k GROUP BY channel""")
def _(v):
    n = F.col("n")
    ranks = stats.ranked(v.levels, ["channel"], "bin", {f"p{int(q * 1000)}": F.floor(q * (n - 1)) for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.995)})
    rest = v.levels.groupBy("channel").agg(F.round(F.avg("bin"), 6).alias("mean"), F.round(F.avg(F.log(F.col("bin") + 1.0)), 6).alias("log_mean"), F.round(F.avg(F.when(F.col("bin") >= 253, 1.0).otherwise(0.0)), 9).alias("clip"), F.count_if(F.col("bin") < 8).alias("bucket0"))
    return ranks.join(rest, "channel")


@query("smoothed_mode", "KN2", HIST + ", s AS (SELECT channel, bin, n + coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0) AS score FROM h WINDOW w AS (PARTITION BY channel ORDER BY bin)) SELECT channel, bin, score FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, abs(bin - 128), bin) AS k FROM s) WHERE k = 1")
def _(v):
    w = Window.partitionBy("channel").orderBy("bin")
    scored = _hist(v).select("channel", "bin", (F.col("n") + F.coalesce(F.lag("n").over(w), F.lit(0)) + F.coalesce(F.lead("n").over(w), F.lit(0))).alias("score"))
    best = F.max_by(F.struct("bin", "score"), F.struct("score", -F.abs(F.col("bin") - 128), -F.col("bin")))
    return scored.groupBy("channel").agg(best.alias("t")).select("channel", "t.*")


@query("tile_noise", "KN6", ", t AS (SELECT x // 8 AS tx, y // 8 AS ty, avg(r) AS m, var_pop(r) / nullif(avg(r), 0) AS noise FROM pix GROUP BY ALL) SELECT tx::BIGINT AS tx, ty::BIGINT AS ty, round(m, 6) AS mean, round(noise, 6) AS noise FROM t WHERE m BETWEEN 60 AND 200 ORDER BY t.noise, ty, tx LIMIT 1")
def _(v):
    t = raster.tiles(v.pix, 8, 8).groupBy("tx", "ty").agg(F.avg("r").alias("m"), F.try_divide(F.var_pop("r"), F.avg("r")).alias("v"))
    return t.where("m between 60 and 200").orderBy("v", "ty", "tx").limit(1).select("tx", "ty", F.round("m", 6).alias("mean"), F.round("v", 6).alias("noise"))


@query("threshold_search", "KN7 SF35", """
, bins AS (SELECT bin, count(*) AS n FROM levels GROUP BY bin),
s AS (SELECT c, sum(n / (1 + exp(-(bin / 255.0 - c / 100.0) * 10))) AS v FROM bins, range(1, 100) t(c) GROUP BY c)
SELECT coalesce(min(CASE WHEN v <= (SELECT count(*) FROM levels) * 0.4 THEN c + 1 END), 101) / 100.0 AS cut FROM s""")
def _(v):
    rows = v.levels.groupBy("bin").agg(F.count("*").alias("n"))  # 256 rows at most
    steps = v.spark.range(1, 100).select(F.col("id").alias("c"))
    sums = rows.crossJoin(F.broadcast(steps)).groupBy("c").agg(F.sum(F.col("n") * s.sigmoid((F.col("bin") / 255.0 - F.col("c") / 100.0) * 10)).alias("v"), F.sum("n").alias("all"))
    return sums.agg((F.coalesce(F.min(F.when(F.col("v") <= F.col("all") * 0.4, F.col("c") + 1)), F.lit(101)) / 100.0).alias("cut"))


@query("mix_curve", "KN11", """
, m AS (SELECT x, y, r, b, (-cos(least(greatest(log2(greatest((r * 4) / 64.0 - 2.0, 1.0)) + 0.5 - (log2(14.0) - 3.0), 0), 3.0) * pi() / 3.0) + 1) / 2 AS mix FROM pix)
SELECT x, y, round(mix, 9) AS mix, round(b + (r - b) * mix, 6) AS v FROM m""")
def _(v):
    """Two channels faded into each other by a cosine of the level of the first, in steps of four."""
    i = F.col("r") * 4
    t = s.clamp(F.log2(F.greatest(i / 64.0 - 2.0, F.lit(1.0))) + 0.5 - (F.log2(F.lit(14.0)) - 3.0), 0.0, 3.0)
    mix = (1 - F.cos(t * F.pi() / 3.0)) / 2
    return v.pix.select("x", "y", F.round(mix, 9).alias("mix"), F.round(F.col("b") + (F.col("r") - F.col("b")) * mix, 6).alias("v"))


# Raster


@query("box_blur", "KN5 raster", "SELECT p.x, p.y, round(avg(q.r), 6) AS mean FROM pix p JOIN pix q ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY p.x, p.y")
def _(v):
    return raster.box(v.pix.select("x", "y", "r"), "r", 1).withColumn("mean", F.round("mean", 6))


@query("median_rows", "KN8 raster", "SELECT x, y, m[len(m) // 2 + 1] AS median FROM (SELECT p.x, p.y, list_sort(list(q.r)) AS m FROM pix p JOIN pix q ON q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y = p.y GROUP BY p.x, p.y)")
def _(v):
    return raster.median(v.pix.select("x", "y", "r"), "r", 2, 0)


@query("guided_filter", "KN5", """
, p AS (SELECT x, y, r / 255.0 AS g, b / 255.0 AS v FROM pix),
s AS (SELECT a.x, a.y, avg(q.g) AS mg, avg(q.v) AS mv, avg(q.g * q.g) AS gg, avg(q.g * q.v) AS gv FROM p a JOIN p q ON abs(q.x - a.x) <= 1 AND abs(q.y - a.y) <= 1 GROUP BY a.x, a.y),
f AS (SELECT x, y, (gv - mg * mv) / (gg - mg * mg + 0.01) AS a, mv - (gv - mg * mv) / (gg - mg * mg + 0.01) * mg AS b FROM s)
SELECT p.x, p.y, round(least(greatest(avg(f.a) * p.g + avg(f.b), 0), 1), 6) AS out FROM p JOIN f ON abs(f.x - p.x) <= 1 AND abs(f.y - p.y) <= 1 GROUP BY p.x, p.y, p.g""")
def _(v):
    p = v.pix.select("x", "y", (F.col("r") / 255.0).alias("g"), (F.col("b") / 255.0).alias("v"))
    return raster.guided(p, "g", "v", 1, 0.01).withColumn("out", F.round("out", 6))


@query("erosion", "KN4", ", m AS (SELECT x, y FROM pix WHERE r > 40) SELECT m.x, m.y FROM m WHERE EXISTS (SELECT 1 FROM m n WHERE n.x = m.x - 1 AND n.y = m.y) AND EXISTS (SELECT 1 FROM m n WHERE n.x = m.x + 1 AND n.y = m.y) AND EXISTS (SELECT 1 FROM m n WHERE n.x = m.x AND n.y = m.y - 1) AND EXISTS (SELECT 1 FROM m n WHERE n.x = m.x AND n.y = m.y + 1)")
def _(v):
    return raster.erode(v.pix.where("r > 40").select("x", "y"), 1)


@query("largest_blob", "KN3", """
, m AS (SELECT y * 32 + x AS node, x, y FROM pix WHERE r > 90), e AS (SELECT a.node AS s, b.node AS t FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
r AS (WITH RECURSIVE w AS (SELECT node, node AS root FROM m UNION SELECT e.t, w.root FROM w JOIN e ON e.s = w.node WHERE w.root < e.t) SELECT node, min(root) AS label FROM w GROUP BY node)
SELECT label, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m JOIN r USING (node) GROUP BY label ORDER BY n DESC, label LIMIT 1""")
def _(v):
    return raster.largest_component(v.pix.where("r > 90").select("x", "y"), 32)


@query("tile_mode", "KN10 raster", ", t AS (SELECT x // 4 AS tx, y // 4 AS ty, r, count(*) AS n FROM pix GROUP BY ALL) SELECT tx, ty, r FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty ORDER BY n DESC, r) AS k FROM t) WHERE k = 1")
def _(v):
    return raster.mode(v.pix, "r", 4)


@query("equalised", "raster W10", ", h AS (SELECT r, count(*) AS n FROM pix GROUP BY r), c AS (SELECT r, sum(n) OVER (ORDER BY r) / (SELECT count(*) FROM pix) AS cdf FROM h) SELECT x, y, floor(c.cdf * 255 + 0.5)::INTEGER AS r FROM pix JOIN c USING (r)")
def _(v):
    return raster.equalise(v.pix.select("x", "y", "r"), "r")


@query("equalised_tiles", "W10", """
, t AS (SELECT x, y, x // 16 AS tx, y // 16 AS ty, r AS bin FROM pix), h AS (SELECT s.tx, s.ty, b.bin, count(t.bin) AS n FROM (SELECT DISTINCT tx, ty FROM t) s CROSS JOIN range(256) b(bin) LEFT JOIN t ON t.tx = s.tx AND t.ty = s.ty AND t.bin = b.bin GROUP BY ALL),
l AS (SELECT *, sum(n) OVER (PARTITION BY tx, ty) / 256.0 * 3.0 AS lim FROM h), e AS (SELECT *, least(n, lim) + sum(greatest(n - lim, 0)) OVER (PARTITION BY tx, ty) / 256.0 AS m FROM l),
c AS (SELECT tx, ty, bin, sum(m) OVER (PARTITION BY tx, ty ORDER BY bin) / sum(m) OVER (PARTITION BY tx, ty) AS cdf FROM e)
SELECT x, y, floor(cdf * 255 + 0.5)::INTEGER AS out FROM t JOIN c USING (tx, ty, bin)""")
def _(v):
    return raster.equalise_tiles(v.pix.select("x", "y", "r"), "r", 16, 3.0)


@query("pixel_arithmetic", "raster SF32", "SELECT x, y, 255 - r AS negative, CASE WHEN 0.299 * r + 0.587 * g + 0.114 * b > 128 THEN 255 ELSE 0 END AS threshold, least(greatest(g + 20, 0), 255) AS brighter, round(-0.16874 * r - 0.33126 * g + 0.5 * b, 6)::DOUBLE AS cb, round(0.5 * r - 0.41869 * g - 0.08131 * b, 6)::DOUBLE AS cr FROM pix")
def _(v):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return v.pix.select("x", "y", (255 - r).alias("negative"), F.when(s.luma(r, g, b) > 128, 255).otherwise(0).alias("threshold"), s.clamp(g + 20, 0, 255).alias("brighter"), F.round(s.chroma_blue(r, g, b), 6).alias("cb"), F.round(s.chroma_red(r, g, b), 6).alias("cr"))


@query("blends", "raster", "SELECT x, y, round(least(s + d, 1), 6) AS plus, round(s * d, 6) AS multiply, round(s + d - s * d, 6) AS screen, round(CASE WHEN d <= 0.5 THEN 2 * s * d ELSE 1 - 2 * (1 - s) * (1 - d) END, 6) AS overlay, least(s, d) AS darken, round(abs(s - d), 6) AS difference, round(s + d - 2 * s * d, 6) AS exclusion, round(CASE WHEN s <= 0.5 THEN d - (1 - 2 * s) * d * (1 - d) ELSE d + (2 * s - 1) * (CASE WHEN d <= 0.25 THEN ((16 * d - 12) * d + 4) * d ELSE sqrt(d) END - d) END, 6) AS soft_light FROM (SELECT x, y, (r / 255)::DOUBLE AS s, (g / 255)::DOUBLE AS d FROM pix)")
def _(v):
    a, d = F.col("r") / 255.0, F.col("g") / 255.0
    names = ["plus", "multiply", "screen", "overlay", "difference", "exclusion", "soft_light"]
    return v.pix.select("x", "y", *[F.round(raster.BLENDS[n](a, d), 6).alias(n) for n in names], raster.BLENDS["darken"](a, d).alias("darken"))


@query("layers", "raster", "SELECT x, y, CASE WHEN b > 100 THEN b WHEN g > 50 THEN g ELSE r END AS top FROM pix")
def _(v):
    layers = F.array(F.struct((F.col("g") > 50).alias("on"), F.col("g").alias("v")), F.struct((F.col("b") > 100).alias("on"), F.col("b").alias("v")))
    return v.pix.select("x", "y", F.aggregate(layers, F.col("r"), lambda a, l: F.when(l["on"], l["v"]).otherwise(a)).alias("top"))


# XPath over well-formed XML


@query("xpath", "XP1 XP2 XP3 XP4 XP5 XP6", "SELECT p_partkey, p_name AS name, (p_size + 1.0)::DOUBLE AS total, p_size > 10 AS big, 2 AS n, upper(p_brand) AS brand, floor(p_size / 2.0)::DOUBLE AS half FROM part WHERE regexp_matches(p_name || p_brand, '^[A-Za-z0-9 #]*$')")
def _(v):
    rows = spread(v.table("part"), "p_partkey").where(F.concat("p_name", "p_brand").rlike("^[A-Za-z0-9 #]*$"))
    doc = F.concat(F.lit("<p brand='"), F.col("p_brand"), F.lit("'><n>"), F.col("p_name"), F.lit("</n><s>"), F.col("p_size").cast("string"), F.lit("</s><s>1</s></p>"))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    x = s.xpath_values(doc, {"name": "p/n", "total": "sum(p/s)", "big": "boolean(p/s[position() = 1] > 10)", "n": "count(p/s)", "brand": f"translate(p/@brand, '{low}', '{up}')", "half": "floor(p/s[1] div 2)"})
    kinds = {"total": "double", "big": "boolean", "n": "int", "half": "double"}
    return rows.select("p_partkey", *[c.cast(kinds.get(name, "string")).alias(name) for name, c in x.items()])


@query("xpath_axes", "XP7", "SELECT id, 'c' AS following, 'a' AS preceding, 'r' AS ancestor, 'b' AS self FROM photos")
def _(v):
    x = F.concat(F.lit("<r><a/><b id='"), F.col("id").cast("string"), F.lit("'/><c/></r>"))
    axes = {"following": "following-sibling::*[1]", "preceding": "preceding-sibling::*[1]", "ancestor": "ancestor::*[1]", "self": "self::*"}
    names = s.xpath_values(x, {k: f"name(//b/{axis})" for k, axis in axes.items()})
    return spread(v.photos.select("id"), "id").select("id", *[c.alias(k) for k, c in names.items()])


@query("keyed_properties", "KN12", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS k FROM events")
def _(v):
    pairs = F.regexp_extract_all("props", F.lit(r'"(\w+)"\s*:\s*(-?[\d.]+)'), F.lit(0))
    hit = F.try_element_at(F.filter(pairs, lambda p: F.regexp_extract(p, r'"(\w+)"', 1) == "k"), F.lit(1))
    return v.table("events").select("event_id", (F.regexp_extract(hit, r":\s*(-?[\d.]+)", 1).cast("double") / 100).alias("k"))


# Streams


@query("live_counts", "RX1 RX2 RX3", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def _(v):
    return reactive.requery(v.spark, v.dir, "events", lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("throttled", "RX4 RX9", "SELECT user_id, slot, event_id, value FROM (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, event_id, value, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(v):
    return reactive.throttle_latest(v.table("events"), "user_id", "ts", 3600, ["event_id", "value"])
