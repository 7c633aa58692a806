"""Further queries: orders and pages of the grid, file sources, layers, transformations, geometry, streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import scalar as s
from ..operators import blend, features, raster
from ..operators.grid import SORTS, GridFilter, order
from ..operators.transforms import chain, registry
from ..sources import files
from ..sources.shared import Workspace, spread
from ..streaming import reactive
from .registry import query

PAGE = 100
KEYS = {"captured": "coalesce(captured_at, added_at)", "added": "added_at", "name": "lower(display_name)", "size": "size_bytes", "rating": "rating"}


def _ordered_sql(key: str, down: bool) -> str:
    way = "DESC" if down else "ASC"
    nulls = "LAST" if down else "FIRST"
    by = f"ORDER BY {KEYS[key]} {way} NULLS {nulls}, id {way}"
    return f"(SELECT '{key}' AS sort, {str(down).lower()} AS down, row_number() OVER ({by})::INTEGER AS pos, id FROM photos WHERE deleted_at IS NULL {by} LIMIT {PAGE})"


@query("grid_orders", "SO1 SO3 SRC2", " UNION ALL ".join(_ordered_sql(k, d) for k in KEYS for d in (False, True)))
def _(v):
    """The first page in each of the five orders and both directions, with its places."""
    out = None
    for key in SORTS:
        for down in (False, True):
            by = order(key, down)
            page = v.photos.where(GridFilter().condition()).orderBy(*by).limit(PAGE)  # a page is numbered, not the table
            page = page.withColumn("pos", F.row_number().over(Window.orderBy(*by))).select(F.lit(key).alias("sort"), F.lit(down).alias("down"), "pos", "id")
            out = page if out is None else out.unionByName(page)
    return out


@query("grid_wide", "PF1 J1", """
SELECT p.*, t.path AS thumb_path, t.bytes AS thumb_bytes, t.last_accessed_at AS thumb_used, e.revisions, e.updated_at AS edited_at,
       CASE WHEN e.photo_id IS NULL OR e.is_neutral = 1 THEN 0 ELSE 1 END AS edited
FROM photos p LEFT JOIN thumbnails t ON t.photo_id = p.id LEFT JOIN edits e ON e.photo_id = p.id
WHERE p.deleted_at IS NULL AND p.color_label = 1""")
def _(v):
    thumbs = v.thumbnails.select(F.col("photo_id").alias("id"), F.col("path").alias("thumb_path"), F.col("bytes").alias("thumb_bytes"), F.col("last_accessed_at").alias("thumb_used"))
    edits = v.edits.select(F.col("photo_id").alias("id"), "revisions", F.col("updated_at").alias("edited_at"), F.when(F.col("is_neutral") == 1, 0).otherwise(1).alias("e"))
    rows = v.photos.where(GridFilter(color=1).condition()).join(thumbs, "id", "left").join(edits, "id", "left")
    return rows.withColumn("edited", F.coalesce("e", F.lit(0))).drop("e")


@query("scoped_keywords", "PF5 AG10", "SELECT keywords FROM photos WHERE project = 'src2' AND keywords <> '' AND deleted_at IS NULL")
def _(v):
    from ..operators.catalogue import keywords_in_scope

    return keywords_in_scope(v.photos, "src2")


FILE_KEYS = {"name": "label", "size": "size", "mime": "mime", "extension": "lower(regexp_extract(label, '[^.]*$'))", "modified": "ts", "added": "expiry"}


@query("file_orders", "SO10", " UNION ALL ".join(
    f"(SELECT '{k}' AS sort, {str(d).lower()} AS down, row_number() OVER (ORDER BY {e} {'DESC NULLS LAST' if d else 'ASC NULLS FIRST'}, id)::INTEGER AS pos, id FROM media ORDER BY pos LIMIT {PAGE})"
    for k, e in FILE_KEYS.items() for d in (False, True)))
def _(v):
    """The first page in each of the twelve file orders; null is the smallest, and files of equal keys keep their order."""
    keys = {"name": F.col("label"), "size": F.col("size"), "mime": F.col("mime"), "extension": s.extension("label"), "modified": F.col("ts"), "added": F.col("expiry")}
    out = None
    for name, key in keys.items():
        for down in (False, True):
            by = [key.desc_nulls_last() if down else key.asc_nulls_first(), F.col("id").asc()]
            page = v.media.orderBy(*by).limit(PAGE).withColumn("pos", F.row_number().over(Window.orderBy(*by)))
            page = page.select(F.lit(name).alias("sort"), F.lit(down).alias("down"), "pos", "id")
            out = page if out is None else out.unionByName(page)
    return out


@query("last_by_key", "J9", "SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(v):
    """Customers with the last of their orders."""
    last = v.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return v.table("customer").select("c_custkey").join(last, "c_custkey", "left")


@query("recent_formats", "KN14", """
, raw AS (SELECT unnest(string_split(format || ':' || CAST(rating AS VARCHAR) || ';' || 'bad;' || format || ':x', ';')) AS cell FROM photos)
SELECT split_part(cell, ':', 1) AS format, CAST(split_part(cell, ':', 2) AS INTEGER) AS score, count(*) AS n FROM raw
WHERE regexp_full_match(cell, '[^:]+:[0-9]+') GROUP BY ALL""")
def _(v):
    """A delimited list parsed; entries that are no pair of name and number are left out."""
    text = F.concat("format", F.lit(":"), F.col("rating").cast("string"), F.lit(";bad;"), "format", F.lit(":x"))
    cells = v.photos.select(F.explode(F.split(text, ";")).alias("cell")).where(F.col("cell").rlike("^[^:]+:[0-9]+$"))
    parts = F.split("cell", ":")
    return cells.select(parts[0].alias("format"), parts[1].cast("int").alias("score")).groupBy("format", "score").agg(F.count("*").alias("n"))


@query("file_names_all", "SF19", """
SELECT id, 'IMG_' || display_name || '(' || width || 'x' || height || ')' || strftime(make_timestamp(added_at * 1000), '%Y-%m-%d_%H-%M-%S') || '_' || substr(md5(CAST(id AS VARCHAR)), 1, 4)
  || '[' || id % 10 || ']_' || iso || '_EXPLICIT_' || upper(format) || '.jpg' AS name FROM photos""")
def _(v):
    """All eleven marks, the random one from a hash of the id so that a rerun names the same files."""
    stamp, rand = F.date_format(F.timestamp_millis("added_at"), "yyyy-MM-dd_HH-mm-ss"), F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 4)
    marks = {"p": F.lit("IMG"), "o": F.col("display_name"), "w": F.col("width"), "h": F.col("height"), "d": stamp, "r": rand, "c": F.col("id") % 10, "i": F.col("iso"), "m": F.lit("explicit"), "s": F.col("format"), "e": F.lit("jpg")}
    return v.photos.select("id", s.expand_name(r"\p_\o(\wx\h)\d_\r[\c]_\i_\M_\S.\e", marks).alias("name"))


@query("all_digests", "SF20")
def _(v):
    """All six digests of whole texts, in lower-case hex."""
    t = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return v.table("documents").select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), *[F.sha2(t, n).alias(f"sha{n}") for n in (224, 256, 384, 512)])


# File sources, over files written from the tables


def _read_back(v, rows: DataFrame, read, *by: str) -> DataFrame:
    """What ``read`` makes of the text files that ``rows`` (value, and ``by`` as folders) fill; the files go, its rows stay."""
    with Workspace(v.spark) as space:
        path = space.path()
        (rows.repartition(*by) if by else rows).write.partitionBy(*by).text(path)
        return space.kept(read(f"{path}/{'/'.join(f'{c}=*' for c in by)}"))


@query("pipe_rows", "SRC11", """
SELECT CAST(p_partkey AS INTEGER) AS lens_id, CAST(p_size AS DOUBLE) AS contrast, CAST(p_size + 1 AS DOUBLE) AS saturation, 0.5::DOUBLE AS tone,
  CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END::DOUBLE AS bias, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1000 END::DOUBLE AS wb_r, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1024 END::DOUBLE AS wb_b,
  CASE WHEN p_size % 3 = 2 THEN 7 ELSE 0 END::DOUBLE AS ca, CASE WHEN p_size % 3 = 2 THEN 8 ELSE 0 END::DOUBLE AS fringe
FROM part WHERE p_size % 7 <> 0""")
def _(v):
    """Rows of four, seven and nine cells beside comments and broken rows."""
    part = v.table("part")
    four = F.concat_ws("|", F.col("p_partkey"), F.col("p_size"), F.col("p_size") + 1, F.lit("0.5"))
    kind = F.col("p_size") % 3
    line = F.when(kind == 0, four).when(kind == 1, F.concat(four, F.lit("|1|1000|1024"))).otherwise(F.concat(four, F.lit("|1|1000|1024|7|8")))
    line = F.when(F.col("p_size") % 7 != 0, line).otherwise(F.concat(F.when(kind == 0, "# ").when(kind == 1, "x|").otherwise("1|2|"), F.lit("broken")))
    return _read_back(v, part.select(line.alias("value")), lambda path: files.pipe_table(v.spark, path))


@query("json_bodies", "SRC12", "SELECT lower(p_brand) || '-' || p_partkey AS model, least(greatest(p_size / 20.0, 0.5), 2.0)::DOUBLE AS trim_r, 1.0::DOUBLE AS trim_b FROM part")
def _(v):
    """Arrays of objects, a file for every 500 of them."""
    one = F.struct(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("model"), (F.col("p_size") / 20.0).alias("trim_r"))
    arrays = v.table("part").groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.to_json(F.collect_list(one)).alias("value"))
    return _read_back(v, arrays, lambda path: files.json_array(v.spark, path, 0.5, 2.0), "file")


@query("name_lists", "SRC13 ST2", """
, rows AS (SELECT 0 AS list, n_nationkey AS place, n_name AS line FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region)
SELECT line, row_number() OVER (ORDER BY list, place)::INTEGER AS pos FROM (SELECT line, min(list) AS list, arg_min(place, list) AS place FROM rows GROUP BY line)""")
def _(v):
    """A list of names and a second one behind it, with comments between them."""
    listed = lambda t, key, name: v.table(t).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, name))), lambda x: F.concat(F.lit("# next\n"), x[name])), "\n").alias("value"))  # noqa: E731  some ten rows
    with Workspace(v.spark) as space:
        paths = [space.path(), space.path()]
        for rows, path in zip((listed("nation", "n_nationkey", "n_name"), listed("region", "r_regionkey", "r_name")), paths):
            rows.write.text(path)
        return space.kept(files.line_lists(v.spark, *paths))


@query("decoded_rows", "SRC7", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0")
def _(v):
    """Rows decoded from JSON; the fifth that is broken is skipped."""
    good = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    rows = v.table("events").select(F.when(F.col("event_id") % 5 == 0, F.lit('{"id": ')).otherwise(good).alias("value"))
    return files.safe_decode(rows, "id bigint, k bigint")


@query("calibration_xml", "SRC14", "SELECT CAST(p_partkey AS BIGINT) AS lens, p_brand AS maker, CAST(p_size AS DOUBLE) AS focal FROM part")
def _(v):
    """A folder of XML files of up to 500 lenses, read by Spark's reader."""
    cell = F.format_string('<lens id="%d"><maker>%s</maker><focal>%d</focal></lens>', F.col("p_partkey").cast("bigint"), "p_brand", F.col("p_size").cast("bigint"))
    lenses = v.table("part").groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.array_join(F.collect_list(cell), "").alias("all"))
    folder = lenses.select("file", F.concat(F.lit("<lenses>"), "all", F.lit("</lenses>")).alias("value"))
    schema = "_id bigint, maker string, focal double"
    rows = _read_back(v, folder, lambda path: v.spark.read.format("xml").option("rowTag", "lens").schema(schema).load(path), "file")
    return rows.select(F.col("_id").alias("lens"), "maker", "focal")


# Layers and colours


def _unit(c: str) -> str:
    return f"(({c}) / 255)::DOUBLE"


MODES = ["src_over", "dst_over", "src_in", "dst_in", "src_out", "dst_out", "src_atop", "dst_atop", "xor", "modulate", "hard_light", "lighten", "color_dodge", "color_burn"]
PLACED = f", p AS (SELECT x, y, {_unit('r')} AS s, {_unit('g')} AS d, (x % 5) / 4.0 AS a, (y % 3) / 2.0 AS b FROM pix)"
SHARES = {"src_over": ("1", "1 - a"), "dst_over": ("1 - b", "1"), "src_in": ("b", "0"), "dst_in": ("0", "a"), "src_out": ("1 - b", "0"), "dst_out": ("0", "1 - a"), "src_atop": ("b", "1 - a"), "dst_atop": ("1 - b", "a"), "xor": ("1 - b", "1 - a")}
SEPARATE = {
    "hard_light": "CASE WHEN s <= 0.5 THEN 2 * s * d ELSE 1 - 2 * (1 - s) * (1 - d) END",
    "lighten": "greatest(s, d)",
    "color_dodge": "CASE WHEN d = 0 THEN 0 WHEN s >= 1 THEN 1 ELSE least(1, d / (1 - s)) END",
    "color_burn": "CASE WHEN d >= 1 THEN 1 WHEN s <= 0 THEN 0 ELSE 1 - least(1, (1 - d) / s) END",
}


def _covered_sql(mode: str) -> str:
    if mode == "modulate":
        value, alpha = "s * a * d * b", "a * b"
    elif mode in SHARES:
        f, g = SHARES[mode]
        value, alpha = f"s * a * ({f}) + d * b * ({g})", f"a * ({f}) + b * ({g})"
    else:
        value, alpha = f"s * a * (1 - b) + d * b * (1 - a) + a * b * ({SEPARATE[mode]})", "a + b - a * b"
    return f"round(({value})::DOUBLE, 6) AS {mode}, round(({alpha})::DOUBLE, 6) AS {mode}_alpha"


@query("covered_blends", "R7", PLACED + " SELECT x, y, " + ", ".join(map(_covered_sql, MODES)) + " FROM p")
def _(v):
    p = v.pix.select("x", "y", (F.col("r") / 255.0).alias("s"), (F.col("g") / 255.0).alias("d"), (F.col("x") % 5 / 4.0).alias("a"), (F.col("y") % 3 / 2.0).alias("b"))
    out = []
    for m in MODES:
        value, alpha = blend.covered(m, *map(F.col, "sadb"))
        out += [F.round(value, 6).alias(m), F.round(alpha, 6).alias(f"{m}_alpha")]
    return p.select("x", "y", *out)


def _light_sql(c: list[str]) -> str:
    return f"(0.3 * {c[0]} + 0.59 * {c[1]} + 0.11 * {c[2]})"


def _mix_sql(name: str, base: str, span: str | None, light: str) -> str:
    """Common table expressions that move the colour ``base`` to a saturation and a lightness."""
    c = [f"{base}{i}" for i in range(3)]
    low, high = f"least({', '.join(c)})", f"greatest({', '.join(c)})"
    sat = [f"CASE WHEN {high} > {low} THEN ({x} - {low}) * {span} / ({high} - {low}) ELSE 0 END" if span else x for x in c]
    one = f"SELECT x, y, {light} AS l, " + ", ".join(f"{e} AS m{i}" for i, e in enumerate(sat)) + " FROM q"
    two = f"SELECT x, y, l, " + ", ".join(f"m{i} + l - {_light_sql(['m0', 'm1', 'm2'])} AS n{i}" for i in range(3)) + f" FROM ({one})"
    low, high = "least(n0, n1, n2)", "greatest(n0, n1, n2)"
    three = f"SELECT x, y, l, {high} AS h, " + ", ".join(f"CASE WHEN {low} < 0 THEN l + (n{i} - l) * l / (l - {low}) ELSE n{i} END AS u{i}" for i in range(3)) + f" FROM ({two})"
    return f", {name} AS (SELECT x, y, " + ", ".join(f"round(CASE WHEN h > 1 THEN l + (u{i} - l) * (1 - l) / (h - l) ELSE u{i} END, 6) AS {name}{i}" for i in range(3)) + f" FROM ({three}))"


S, D = ["s0", "s1", "s2"], ["d0", "d1", "d2"]
MIXED = f", q AS (SELECT x, y, {_unit('r')} AS s0, {_unit('g')} AS s1, {_unit('b')} AS s2, {_unit('b')} AS d0, {_unit('r')} AS d1, {_unit('255 - g')} AS d2 FROM pix)"
MIXED += _mix_sql("hue", "s", "(greatest(d0, d1, d2) - least(d0, d1, d2))", _light_sql(D)) + _mix_sql("saturation", "d", "(greatest(s0, s1, s2) - least(s0, s1, s2))", _light_sql(D))
MIXED += _mix_sql("color", "s", None, _light_sql(D)) + _mix_sql("luminosity", "d", None, _light_sql(S))


@query("mixed_blends", "R7", MIXED + " SELECT * FROM hue JOIN saturation USING (x, y) JOIN color USING (x, y) JOIN luminosity USING (x, y)")
def _(v):
    u = lambda c: c / 255.0
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    source, under = (u(r), u(g), u(b)), (u(b), u(r), u(255 - g))
    return v.pix.select("x", "y", *[F.round(c, 6).alias(f"{m}{i}") for m, mix in blend.MIXES.items() for i, c in enumerate(mix(source, under))])


@query("colormap", "R2", "SELECT x, y, least(r * 2, 255)::INTEGER AS cr, abs(255 - r * 2)::INTEGER AS cg, (255 - r)::INTEGER AS cb FROM pix")
def _(v):
    i = F.col("id").cast("int")
    table = v.spark.range(256).select(i.alias("i"), F.struct(F.least(i * 2, F.lit(255)).alias("cr"), F.abs(255 - i * 2).alias("cg"), (255 - i).alias("cb")).alias("o"))
    return raster.lut(v.pix.select("x", "y", "r"), table, "r").select("x", "y", "r.*")


@query("blob_edges", "KN3", """
, m AS (SELECT y * 32 + x AS node, x, y FROM pix WHERE r > 90), e AS (SELECT a.node AS s, b.node AS t FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
r AS (WITH RECURSIVE w AS (SELECT node, node AS root FROM m UNION SELECT e.t, w.root FROM w JOIN e ON e.s = w.node WHERE w.root < e.t) SELECT node, min(root) AS label FROM w GROUP BY node),
b AS (SELECT label, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m JOIN r USING (node) GROUP BY label ORDER BY n DESC, label LIMIT 1)
SELECT label, n, x0 = 0 AS at_left, x1 = 31 AS at_right, y0 = 0 AS at_top, y1 = (SELECT max(y) FROM pix) AS at_bottom FROM b""")
def _(v):
    """Which edges of the picture the largest set touches."""
    blob = raster.largest_component(v.pix.where("r > 90").select("x", "y"), 32)
    size = v.pix.agg(F.max("y").alias("last"))  # one row
    at = {"at_left": F.col("x0") == 0, "at_right": F.col("x1") == 31, "at_top": F.col("y0") == 0, "at_bottom": F.col("y1") == F.col("last")}
    return blob.crossJoin(F.broadcast(size)).select("label", "n", *[c.alias(k) for k, c in at.items()])


@query("weighted_mode", "KN2", """
, h AS (SELECT c.channel, b.bin::INTEGER AS bin, coalesce(sum(l.v), 0) AS w FROM (SELECT DISTINCT channel FROM levels) c CROSS JOIN range(256) b(bin) LEFT JOIN levels l ON l.channel = c.channel AND l.bin = b.bin GROUP BY ALL),
s AS (SELECT channel, bin, w + coalesce(lag(w) OVER o, 0) + coalesce(lead(w) OVER o, 0) AS score FROM h WINDOW o AS (PARTITION BY channel ORDER BY bin)),
before AS (SELECT channel, max(plane) * 40 AS held FROM levels GROUP BY channel)
SELECT channel, bin, score FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, abs(bin - held), bin) AS k FROM s JOIN before USING (channel)) WHERE k = 1""")
def _(v):
    """The bin whose smoothed weight is largest; of equal ones the nearest to the value held before."""
    from ..operators.stats import histogram

    spine = histogram(v.levels, ["channel"]).select("channel", "bin")
    weights = v.levels.groupBy("channel", "bin").agg(F.sum("v").alias("w"))
    held = v.levels.groupBy("channel").agg((F.max("plane") * 40).alias("held"))
    rows = spine.join(weights, ["channel", "bin"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    near = Window.partitionBy("channel").orderBy("bin")  # 256 bins
    scored = rows.withColumn("score", F.col("w") + F.coalesce(F.lag("w").over(near), F.lit(0.0)) + F.coalesce(F.lead("w").over(near), F.lit(0.0))).join(held, "channel")
    best = F.max_by(F.struct("bin", "score"), F.struct("score", -F.abs(F.col("bin") - F.col("held")), -F.col("bin")))
    return scored.groupBy("channel").agg(best.alias("t")).select("channel", "t.*")


@query("palette_order", "AG26", """
, c AS (SELECT (r // 64) * 64 AS r, (g // 64) * 64 AS g, count(*) AS n FROM pix GROUP BY ALL)
, m AS (SELECT 'c' || r AS name, max(n) AS n, arg_max(g, (n, -g)) AS g, any_value(r) AS r FROM c GROUP BY 1)
SELECT name, n, round(n / (SELECT count(*) FROM pix), 9) AS share, row_number() OVER (ORDER BY 0.299 * r + 0.587 * g, r)::INTEGER AS pos FROM m""")
def _(v):
    """The most frequent colour of each name, in order of luminance."""
    total = v.pix.agg(F.count("*").alias("all"))
    counts = v.pix.groupBy((F.floor(F.col("r") / 64) * 64).alias("r"), (F.floor(F.col("g") / 64) * 64).alias("g")).agg(F.count("*").alias("n"))
    named = counts.groupBy(F.concat(F.lit("c"), F.col("r").cast("string")).alias("name"), "r").agg(F.max_by(F.struct("n", "g"), F.struct("n", -F.col("g"))).alias("t"))
    light = Window.orderBy(0.299 * F.col("r") + 0.587 * F.col("t.g"), "r")  # four names
    return named.crossJoin(F.broadcast(total)).select("name", "t.n", F.round(F.col("t.n") / F.col("all"), 9).alias("share"), F.row_number().over(light).alias("pos"))


# Transformations


@query("transform_chain", "UX1 UX2 UX3 UX4", "SELECT x, y, CASE WHEN least((255 - r) * 2, 255) > 100 THEN 255 ELSE 0 END AS r, 'negative(r)+gain(r,2)+threshold(r,100)' AS chain FROM pix")
def _(v):
    made = chain([registry.filters["negative"]("r"), registry.filters["gain"]("r", 2), registry.filters["threshold"]("r", 100)])
    return made(v.pix.select("x", "y", "r")).withColumn("chain", F.lit(made.key))


@query("effects", "UX5", """
, e AS (SELECT x, y, r, CASE WHEN x % 2 = 0 THEN 1.0 ELSE 0.0 END AS exposure, CASE WHEN y % 3 = 0 THEN 0.5 ELSE 1.0 END AS contrast FROM pix)
SELECT x, y, round(((r * pow(2.0, exposure)) - 128) * contrast + 128, 6)::DOUBLE AS value, concat_ws(',', CASE WHEN exposure <> 0 THEN 'exposure' END, CASE WHEN contrast <> 1 THEN 'contrast' END) AS active FROM e""")
def _(v):
    """Settings by name; one that stands at its default does nothing."""
    settings = F.create_map(F.lit("exposure"), F.when(F.col("x") % 2 == 0, 1.0).otherwise(0.0), F.lit("contrast"), F.when(F.col("y") % 3 == 0, 0.5).otherwise(1.0))
    rows = v.pix.select("x", "y", F.col("r").cast("double").alias("r"), settings.alias("settings"))
    return rows.select("x", "y", F.round(registry.rendered("r"), 6).alias("value"), F.array_join(registry.active_names(), ",").alias("active"))


CORNERS = [(2.0, 1.0), (28.0, 4.0), (20.0, 20.0), (12.0, 9.0), (3.0, 26.0)]


@query("geometry", "SF36", "SELECT x, y, (x - 10) * (x - 10) + (y - 8) * (y - 8) <= r / 8.0 * r / 8.0 AS in_circle, ((10 - 2) * (y - 1) - (8 - 1) * (x - 2))::DOUBLE AS turn, (" + " + ".join(
    f"(((y < {y0}) <> (y < {y1})) AND x < {x0} + (y - {y0}) * ({(x1 - x0) / (y1 - y0)!r}::DOUBLE))::INTEGER" for (x0, y0), (x1, y1) in zip(CORNERS, CORNERS[1:] + CORNERS[:1])
) + ") % 2 = 1 AS in_polygon FROM pix")
def _(v):
    p, k = (F.col("x"), F.col("y")), lambda *xy: tuple(F.lit(float(c)) for c in xy)
    radius = F.col("r") / 8.0
    return v.pix.select("x", "y", geometry.in_circle(p, k(10, 8), radius).alias("in_circle"), geometry.turn(k(2, 1), k(10, 8), p).alias("turn"), geometry.in_polygon(p, CORNERS).alias("in_polygon"))


@query("xpath_documents", "XP2 XP3 XP4 XP7", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'c' END AS next, 'd' AS last, p_size % 2 + 2 AS before, 'r' AS top, p_size % 2 = 0 AS plain,
  length(p_brand)::INTEGER AS chars, substr(p_brand, 1, 5) AS head, starts_with(p_brand, 'Brand#1') AS first_brands FROM part""")
def _(v):
    """Documents whose shape differs from row to row: axes, node sets, strings and truth values."""
    brand = F.col("p_brand")
    x = F.concat(F.lit("<r><a t='"), brand, F.lit("'/>"), F.when(F.col("p_size") % 2 == 0, "<b/>").otherwise("<c/><b/>"), F.lit("<d/></r>"))
    of = {
        "next": "local-name(/r/a/following-sibling::*[1])", "last": "name(/r/*[last()])", "before": "count(/r/d/preceding-sibling::*)", "top": "name(//b/ancestor::*[1])", "plain": "not(boolean(/r/c))",
        "chars": "string-length(/r/a/@t)", "head": "substring(/r/a/@t, 1, 5)", "first_brands": "starts-with(normalize-space(concat(' ', /r/a/@t)), 'Brand#1')",
    }
    kinds = {"before": "int", "plain": "boolean", "chars": "int", "first_brands": "boolean"}
    return spread(v.table("part"), "p_partkey").select("p_partkey", *[c.cast(kinds.get(name, "string")).alias(name) for name, c in s.xpath_values(x, of).items()])


# Streams


@query("debounced", "RX9", """
, g AS (SELECT user_id, event_id, value, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, burst ORDER BY ts DESC, event_id DESC) AS k FROM b) WHERE k = 1""")
def _(v):
    return reactive.debounce(v.table("events"), "user_id", "ts", "6 hours", ["event_id", "value"]).drop("burst")


@query("live_join", "RX1 RX2", "SELECT r_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def _(v):
    """A query that runs again when any of its three tables changes."""

    def run(tables: dict[str, DataFrame]) -> DataFrame:
        c, n, r = (tables[t] for t in ("customer", "nation", "region"))
        return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.count("*").alias("customers"))

    return reactive.requery_all(v.spark, v.dir, ["customer", "nation", "region"], run)


@query("string_difference", "ST5")
def _(v):
    """What to take from a part's name and from its type so that both read alike."""
    from ..functions.difference import difference

    return v.table("part").select("p_partkey", "p_name", "p_type", difference("p_name", "p_type").alias("d")).select("p_partkey", "p_name", "p_type", "d.*")


def _features_sql() -> str:
    p = lambda c, x: f"max(CASE WHEN channel = '{c}' AND k = floor({x} / 100 * (n - 1)) THEN v END)"
    ranks = [f"{p('luma', x)} AS luma_{features._p(x)}" for x in features.PERCENTILES] + [f"{p(c, 99.5)} AS {c}_p99_5" for c in "rgb"]
    shares = [f"avg(({c} >= 254)::INTEGER) AS {c}_clip, avg({c} / 255) AS {c}_mean" for c in "rgb"]
    shares += [f"avg((l > {x})::INTEGER) AS above_{int(x * 10)}" for x in features.ABOVE] + [f"avg((l < {x})::INTEGER) AS below_{int(x * 10)}" for x in features.BELOW]
    shares += [f"avg((floor(l * 31.99) = {i})::INTEGER) AS bucket_{i}" for i in range(features.BUCKETS)]
    shares += ["avg(l) AS l", "avg((r >= 254 OR g >= 254 OR b >= 254)::INTEGER) AS any_share"]
    made = {
        "r_minus_g": "r_mean - (g_mean + 1e-6)", "b_minus_g": "b_mean - (g_mean + 1e-6)", "r_by_g": "r_mean / (g_mean + 1e-6)", "b_by_g": "b_mean / (g_mean + 1e-6)", "span": "luma_p99_5 - luma_p0_5",
        "middle": "luma_p75 - luma_p25", "log_mean": "ln(l + 1e-4)", "skew": "l - luma_p50", "any_clip": "CASE WHEN any_share > 0.005 THEN 1 ELSE 0 END", "ev": "0.5",
    }
    return f"""
, px AS (SELECT r, g, b, round((0.299 * r + 0.587 * g + 0.114 * b) / 255, 9)::DOUBLE AS l FROM pix),
v AS (SELECT 'luma' AS channel, l AS v FROM px UNION ALL SELECT 'r', r / 255 FROM px UNION ALL SELECT 'g', g / 255 FROM px UNION ALL SELECT 'b', b / 255 FROM px),
k AS (SELECT channel, v, row_number() OVER (PARTITION BY channel ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM v),
a AS (SELECT {', '.join(ranks)} FROM k), s AS (SELECT {', '.join(shares)} FROM px)
SELECT {', '.join(f"round(({made.get(n, n)})::DOUBLE, 6) AS {n}" for n in features.names())} FROM a, s"""


@query("picture_features", "KN1", _features_sql())
def _(v):
    return features.picture_features(v.pix, 0.5)
