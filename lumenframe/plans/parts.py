"""Queries of smaller rules: styles, sizes, settings, filters of lists, descriptors, layers as rows, medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import raster, stats
from ..operators.descriptors import MediaQuery
from ..sources.shared import spread
from .registry import query

CODES = "CASE id % 10 WHEN 0 THEN 129 WHEN 1 THEN 130 WHEN 2 THEN 131 WHEN 3 THEN 132 WHEN 4 THEN 133 WHEN 5 THEN 134 WHEN 6 THEN 33 WHEN 7 THEN 0 WHEN 8 THEN 77 END"


@query("picture_styles", "SF29", f"""
, c AS (SELECT id, camera_make, {CODES} AS code FROM photos),
t AS (SELECT id, CASE WHEN lower(camera_make) NOT LIKE '%canon%' OR code IS NULL THEN 'STANDARD'
        ELSE coalesce({{129: 'STANDARD', 130: 'PORTRAIT', 131: 'LANDSCAPE', 132: 'NEUTRAL', 133: 'FAITHFUL', 134: 'MONOCHROME', 33: 'USER_DEF', 0: 'AUTO'}}[code], 'AUTO') END AS style FROM c)
SELECT id, style, CASE WHEN style IN ('NEUTRAL', 'FAITHFUL') THEN 0.5 ELSE 1.0 END::DOUBLE AS scale FROM t""".replace("{129:", "MAP {129:"))
def _(v):
    style = s.picture_style(F.col("camera_make"), F.expr(CODES))
    return v.photos.select("id", style.alias("style"), s.style_scale(style).alias("scale"))


@query("aspect_sizes", "SF38", """
, t AS (SELECT id, CASE WHEN id % 3 = 0 THEN height ELSE width END AS w, CASE WHEN id % 3 = 0 THEN width ELSE height END AS h, CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 0.8 ELSE 1.77 END::DOUBLE AS ratio, id % 2 = 0 AS fit FROM photos),
k AS (SELECT *, CASE WHEN fit THEN ratio > w::DOUBLE / h ELSE ratio < w::DOUBLE / h END AS keep FROM t)
SELECT id, CASE WHEN keep THEN floor(h * ratio + 0.5) ELSE w END::INTEGER AS width, CASE WHEN keep THEN h ELSE floor(w / ratio + 0.5) END::INTEGER AS height FROM k""")
def _(v):
    """Pictures cut or filled to a ratio; those turned by a quarter have their sides swapped."""
    turned, i = F.col("id") % 3 == 0, F.col("id")
    w, h = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    ratio = F.when(i % 4 == 0, 1.0).when(i % 4 == 1, 1.5).when(i % 4 == 2, 0.8).otherwise(1.77)
    return v.photos.select("id", s.aspect_size(w, h, ratio, i % 2 == 0).alias("z")).select("id", "z.width", "z.height")


@query("develop_settings", "KN12", """
SELECT p_partkey, (p_size / 5.0)::DOUBLE AS exposure, CASE WHEN p_size % 2 = 0 THEN p_size / 100.0 END::DOUBLE AS contrast, ((p_size - 20) / 100.0)::DOUBLE AS hue_red, NULL::DOUBLE AS shadows, (2 + (p_size % 2 = 0)::INTEGER)::INTEGER AS n FROM part""")
def _(v):
    """Attributes with and without prefixes, repeated, broken and unknown ones between them."""
    size, text = F.col("p_size").cast("string"), F.lit
    xml = F.concat(
        text('<d crs:Exposure2012="3" xmp:Rating="5" Shadows2012="bright" crs:HueAdjustmentRed = "'), (F.col("p_size") - 20).cast("string"), text('" crs:Exposure2012="'), size, text('.0"'),
        F.when(F.col("p_size") % 2 == 0, F.concat(text(' Contrast2012="'), size, text('"'))).otherwise(""), text(' Unknown="1"/>'),
    )
    m = F.col("m")
    return spread(v.table("part"), "p_partkey").select("p_partkey", s.develop_settings(xml).alias("m")).select("p_partkey", m["Exposure2012"].alias("exposure"), m["Contrast2012"].alias("contrast"), m["HueAdjustmentRed"].alias("hue_red"), m["Shadows2012"].alias("shadows"), F.size("m").alias("n"))


SHELF = ["Brand#7", "Brand#3", "Brand#12", "Brand#1"]


@query("shelf_search", "KN15", """
SELECT p_partkey, list_position(['Brand#7', 'Brand#3', 'Brand#12', 'Brand#1'], p_brand)::INTEGER AS place FROM part
WHERE p_brand IN ('Brand#7', 'Brand#3', 'Brand#12', 'Brand#1') AND (contains(lower(p_name || ' ' || p_type), 'e r') OR contains(lower(upper(p_name) || ' x'), 'bolt x'))""")
def _(v):
    """Members of a fixed list, by its order, of which one of two titles has the words."""
    shown, other = F.concat_ws(" ", "p_name", "p_type"), F.concat(F.upper("p_name"), F.lit(" X"))
    hit = s.matches_either("E r", shown) | s.matches_either("bolt x", other)
    return v.table("part").where(F.col("p_brand").isin(SHELF) & hit).select("p_partkey", F.array_position(F.array(*map(F.lit, SHELF)), F.col("p_brand")).cast("int").alias("place"))


@query("extension_filter", "PF17", "SELECT id, ext FROM media, (VALUES ('.png'), ('*'), (NULL), ('.mp4')) e(ext) WHERE id % 4 = CASE WHEN ext = '.png' THEN 0 WHEN ext = '*' THEN 1 WHEN ext IS NULL THEN 2 ELSE 3 END AND (ext IS NULL OR ext = '*' OR ends_with(path, ext))")
def _(v):
    ext = F.when(F.col("id") % 4 == 0, ".png").when(F.col("id") % 4 == 1, "*").when(F.col("id") % 4 == 3, ".mp4")
    return v.media.withColumn("ext", ext).where(s.has_extension(F.col("path"), F.col("ext"))).select("id", "ext")


@query("list_filters", "PF21", """
, t AS (SELECT id, [{'kind': 'blur', 'n': id % 5}, {'kind': 'tone', 'n': id % 3}, {'kind': 'tone', 'n': 9}][1 : 1 + (id % 3)::INTEGER] AS l FROM photos)
SELECT id, to_json(list_filter(l, lambda x: x.kind <> 'blur'))::VARCHAR AS others, to_json(CASE WHEN len(list_filter(l, lambda x: x.kind = 'tone')) > 0 THEN list_filter(l, lambda x: x.kind <> 'tone') ELSE list_append(l, {'kind': 'tone', 'n': 7::BIGINT}) END)::VARCHAR AS toggled,
  to_json(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN {'kind': x.kind, 'n': x.n + 100} ELSE x END))::VARCHAR AS changed FROM t""")
def _(v):
    """Lists of settings of several kinds: without one kind, with a kind toggled, with the first one changed."""
    one = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    i = F.col("id")
    items = F.slice(F.array(one("blur", i % 5), one("tone", i % 3), one("tone", F.lit(9))), F.lit(1), (1 + i % 3).cast("int"))
    changed = s.replace_at(items, F.lit(0), lambda x: x.withField("n", x["n"] + 100))
    return v.photos.select("id", F.to_json(F.filter(items, lambda x: x["kind"] != "blur")).alias("others"), F.to_json(s.toggle_kind(items, one("tone", F.lit(7)), "kind")).alias("toggled"), F.to_json(changed).alias("changed"))


@query("described_scans", "SRC6", """
SELECT 'photos' AS scan, id, mime FROM media WHERE mime LIKE 'image%' UNION ALL SELECT 'videos', id, mime FROM media WHERE mime LIKE 'video%' AND bucket = 3
UNION ALL SELECT 'albums', id, mime FROM media UNION ALL SELECT 'files', id, mime FROM media WHERE path LIKE '%.png' OR path LIKE '%.mp4'""")
def _(v):
    scans = {"photos": MediaQuery.photos(), "videos": MediaQuery.videos().in_album(3), "albums": MediaQuery.albums(), "files": MediaQuery.files("%.png", "%.mp4")}
    parts = [q.rows(v.media).select(F.lit(name).alias("scan"), "id", "mime") for name, q in scans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("layer_rows", "R6", "SELECT x, y, CASE WHEN b > 100 THEN b WHEN g > 50 THEN g ELSE r END AS top, 1 + (g > 50)::INTEGER + (b > 100)::INTEGER AS shown FROM pix")
def _(v):
    """Layers that come as rows: of those that cover a place, the uppermost one shows."""
    layer = lambda c, n, on: v.pix.where(on).select("x", "y", F.lit(n).alias("layer"), F.col(c).alias("v"))
    rows = layer("r", 0, F.lit(True)).unionByName(layer("g", 1, F.col("g") > 50)).unionByName(layer("b", 2, F.col("b") > 100))
    return raster.uppermost(rows, "layer", "v")


@query("median_marks", "KN9", """
, n AS (SELECT a.x, a.y, list_sort(list(b.r)) AS nine, list_sort(list(b.r) FILTER (a.x = b.x OR a.y = b.y)) AS five FROM pix a JOIN pix b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y)
SELECT x, y, five[3] AS median5, nine[5] AS median9 FROM n WHERE len(nine) = 9""")
def _(v):
    """The median of a place with its four, and with its eight neighbours, where all are there."""
    at = lambda df, n: df.groupBy("x", "y").agg(F.sort_array(F.collect_list("r")).alias("v")).where(F.size("v") == n).select("x", "y", F.element_at("v", n // 2 + 1).alias(f"median{n}"))  # noqa: E731  5 or 9 values
    px = v.pix.select("x", "y", "r")
    return at(raster.around(px, 1, 1, cross=True), 5).join(at(raster.around(px, 1, 1), 9), ["x", "y"])


@query("plane_ranks", "AG18", """
, ends AS (SELECT max(y) + 1 AS h FROM pix), t AS (SELECT r, b FROM pix, ends WHERE y < h - 2 AND x % 3 = 0 AND y % 3 = 0 AND r < 250),
k AS (SELECT 'bright' AS plane, r AS v FROM t UNION ALL SELECT 'dark', b FROM t), o AS (SELECT plane, v, row_number() OVER (PARTITION BY plane ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY plane) AS n FROM k)
SELECT plane, max(v) FILTER (i = (n - 1) // 2) AS median, max(v) FILTER (i = n * 98 // 100) AS p98, max(v) FILTER (i = n * 999 // 1000) AS p999 FROM o GROUP BY plane""")
def _(v):
    """Ranks in two planes taken at every third place of every third row, where the bright one is not clipped."""
    h = v.pix.agg((F.max("y") + 1).alias("h"))  # one row
    px = v.pix.crossJoin(F.broadcast(h)).where("y < h - 2 and x % 3 = 0 and y % 3 = 0 and r < 250")
    planes = px.select(F.explode(F.array(F.struct(F.lit("bright").alias("plane"), F.col("r").alias("v")), F.struct(F.lit("dark").alias("plane"), F.col("b").alias("v")))).alias("p")).select("p.*")
    n = F.col("n")
    return stats.ranked(planes, ["plane"], "v", {"median": F.floor((n - 1) / 2), "p98": F.floor(n * 98 / 100), "p999": F.floor(n * 999 / 1000)})


@query("xpath_ways", "XP7", """
SELECT p_partkey, p_size % 3 AS below, 1 + p_size % 3 + (p_size % 2) AS behind, 2 AS ahead, CASE WHEN p_size % 3 > 0 THEN 'b' ELSE 'c' END AS first_behind FROM part""")
def _(v):
    """Descendants, and what follows and precedes in the document, of a node whose surroundings differ from row to row."""
    x = F.concat(F.lit("<r><p><q/></p><a/>"), F.when(F.col("p_size") % 3 == 0, "<m/>").when(F.col("p_size") % 3 == 1, "<m><b/></m>").otherwise("<m><b/><b/></m>"), F.when(F.col("p_size") % 2 == 1, "<c/>").otherwise(""), F.lit("<c/></r>"))
    of = {"below": "count(/r/m/descendant::*)", "behind": "count(/r/a/following::*) - 1", "ahead": "count(/r/a/preceding::*)", "first_behind": "name(/r/a/following::*[2])"}
    return spread(v.table("part"), "p_partkey").select("p_partkey", *[c.cast("string" if name == "first_behind" else "int").alias(name) for name, c in s.xpath_values(x, of).items()])
