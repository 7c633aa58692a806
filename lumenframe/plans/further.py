"""Queries of ranked names, copied blocks, rising histograms, local contrast, aged caches, walks, hulls, picture files and keyed streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import aged_cache, copied, fields, hull, lens_match, listing, local_contrast, ordered
from ..sources import bigtiff, files
from ..sources.shared import Workspace
from ..streaming import latest, stateful
from .registry import query

# Names against a table of lenses

MODEL = "concat(p_name, ' ', cast(p_size as string), 'mm f', cast(1 + p_partkey % 4 as string), ' k', cast(cast(floor(p_partkey / 4) as bigint) as string), case p_partkey % 3 when 0 then ' os' when 1 then '' else ' usm' end)"
LENSES = {
    "lens_id": "p_partkey", "maker": "p_brand", "model": "model", "crop": "1.0 + (p_partkey % 3) * 0.3", "mount": "p_partkey % 5", "focal_low": "cast(p_size as double)",
    "focal_high": "case when p_partkey % 6 = 0 then null else cast(p_size + p_partkey % 40 as double) end", "aperture": "case when p_partkey % 7 = 0 then null else cast(1 + p_partkey % 4 as double) end",
}
ASKED = {
    "ask_id": "p_partkey",
    "text": "case p_partkey % 5 when 0 then model when 1 then substr(model, instr(model, ' ') + 1) when 2 then concat(upper(model), ' lens') when 3 then replace(model, 'i', 'y') else concat('k', cast(cast(floor(p_partkey / 4) as bigint) as string), ' ', cast(p_size as string), 'mm') end",
    "maker": "case when p_partkey % 4 = 0 then null else p_brand end", "body_maker": "concat('Brand#', cast(p_partkey % 20 as string))", "crop": "1.0 + (p_partkey % 2) * 0.6", "mount": "p_partkey % 5",
    "focal": "cast(p_size as double)", "aperture": "cast(1 + p_partkey % 4 as double)",
}


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def _marked(words: list[str]) -> str:
    known = ", ".join(f"'{w}'" for w in words)
    want, has = (f"list_filter({side}, lambda t: t IN ({known}))" for side in ("a.s", "l.s"))
    return f"CASE WHEN list_has_all({want}, {has}) AND list_has_all({has}, {want}) THEN 2 WHEN list_has_all({want}, {has}) THEN 1 ELSE 0 END"


@query("lens_ranking", "J10", f"""
, named AS (SELECT *, {MODEL} AS model FROM part),
l0 AS (SELECT {_listed(LENSES)} FROM named), a0 AS (SELECT {_listed(ASKED)} FROM named WHERE p_partkey % 3 <> 1),
l1 AS (SELECT *, regexp_extract_all(lower(model), '[a-z]+|[0-9]+(?:\\.[0-9]+)?') AS words FROM l0), a1 AS (SELECT *, regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:\\.[0-9]+)?') AS words FROM a0),
l AS (SELECT *, list_distinct(words) AS s, list_filter(list_distinct(words), lambda t: regexp_matches(t, '^[0-9]')) AS num FROM l1),
a AS (SELECT *, list_distinct(words) AS s, list_filter(list_distinct(words), lambda t: regexp_matches(t, '^[0-9]')) AS num FROM a1),
p AS (SELECT a.ask_id, l.lens_id,
        CASE WHEN a.words = l.words THEN 5 WHEN list_has_all(l.s, a.s) THEN 4 WHEN list_has_all(a.s, l.s) THEN 3 WHEN len(a.num) > 0 AND list_has_all(l.num, a.num) THEN 2
             WHEN len(l.num) > 0 AND list_has_all(a.num, l.num) THEN 1 ELSE 0 END AS name,
        CASE WHEN abs(a.crop - l.crop) < 0.05 THEN 2 WHEN l.crop < a.crop THEN 1 ELSE 0 END AS format, (a.mount = l.mount)::INTEGER AS mount,
        CASE WHEN lower(l.maker) = lower(a.maker) THEN 2 WHEN lower(l.maker) = lower(a.body_maker) THEN 1 ELSE 0 END AS brand,
        CASE WHEN a.focal IS NULL OR l.focal_low IS NULL THEN 1 WHEN a.focal BETWEEN l.focal_low AND coalesce(l.focal_high, l.focal_low) THEN 2 ELSE 0 END AS range,
        CASE WHEN a.aperture IS NULL OR l.aperture IS NULL THEN 1 WHEN abs(a.aperture - l.aperture) < 0.05 THEN 2 ELSE 0 END AS aperture,
        {_marked(lens_match.STABILISERS)} AS stabiliser, {_marked(lens_match.MOTORS)} AS motor, floor(least(a.crop, l.crop)::DOUBLE / greatest(a.crop, l.crop)::DOUBLE * 9)::INTEGER AS closeness,
        len(a.num) > 0 AND list_has_all(l.num, a.num) AS numbers
      FROM a, l),
t AS (SELECT *, (((((((name * 3 + format) * 2 + mount) * 3 + brand) * 3 + range) * 3 + aperture) * 3 + stabiliser) * 3 + motor) * 10 + closeness AS total, name >= 3 AND numbers AS sure FROM p WHERE name > 0)
SELECT ask_id, lens_id, name, format, mount, brand, range, aperture, stabiliser, motor, closeness, total::BIGINT AS total, sure, place::INTEGER AS place
FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY total DESC, lens_id) AS place FROM t) WHERE place <= 3""")
def _(v):
    named = v.table("part").withColumn("model", F.expr(MODEL))
    of = lambda df, columns: df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return lens_match.rank_lenses(of(named.where("p_partkey % 3 <> 1"), ASKED), of(named, LENSES), 3)


# Copied blocks

SIZE, KEEP, QUALITY = 4, 2, 300.0


def _spectra_sql() -> str:
    cos = copied.cosines(SIZE, KEEP).tolist()
    weight = lambda u, v: " + ".join(f"sum(CASE WHEN p.y - b.y = {j} AND p.x - b.x = {i} THEN p.grey END) * {cos[u][j]!r}::DOUBLE * {cos[v][i]!r}::DOUBLE" for j in range(SIZE) for i in range(SIZE))
    made = ", ".join(f"least(greatest(round_even(round(({weight(u, v)}) / {QUALITY}, 6), 0), 0), 255)::INTEGER AS s{u}{v}" for u in range(KEEP) for v in range(KEEP))
    return f"""
, grey AS (SELECT x, y, (299 * r + 587 * g + 114 * b + 500) // 1000 AS grey FROM pix),
spectra AS (SELECT b.x, b.y, {made} FROM grey b JOIN grey p ON p.x BETWEEN b.x AND b.x + {SIZE - 1} AND p.y BETWEEN b.y AND b.y + {SIZE - 1} GROUP BY b.x, b.y HAVING count(*) = {SIZE * SIZE})"""


@query("block_order", "SO13", _spectra_sql() + """
, signed AS (SELECT x, y, list_transform([s00, s01, s10, s11], lambda s: CASE WHEN s > 127 THEN s - 256 ELSE s END) AS s FROM spectra)
SELECT x, y, row_number() OVER (ORDER BY s, y, x) AS pos FROM signed""")
def _(v):
    return copied.block_order(copied.block_spectra(v.pix, SIZE, KEEP, QUALITY)).select("x", "y", "pos")


@query("block_copies", "AG25 J12", _spectra_sql() + f"""
, pairs AS (SELECT *, abs(to_x - x) AS shift_x, abs(to_y - y) AS shift_y FROM (SELECT x, y, lead(x) OVER w AS to_x, lead(y) OVER w AS to_y FROM spectra WINDOW w AS (PARTITION BY s00, s01, s10, s11 ORDER BY y, x)) WHERE to_x IS NOT NULL),
far AS (SELECT * FROM pairs WHERE sqrt(shift_x * shift_x + shift_y * shift_y) > {SIZE})
SELECT x, y, to_x, to_y, shift_x, shift_y, n FROM (SELECT *, count(*) OVER (PARTITION BY shift_x, shift_y) AS n FROM far) WHERE n > 10""")
def _(v):
    return copied.copied_blocks(copied.block_spectra(v.pix, SIZE, KEEP, QUALITY), SIZE, 10)


# Rising histograms, local contrast


@query("field_walk", "AG22", """
, h AS (SELECT g.g, b.v, count(l.bin) AS n FROM range(4) g(g) CROSS JOIN range(256) b(v) LEFT JOIN levels l ON l.plane = g.g AND l.bin = b.v GROUP BY ALL),
c AS (SELECT g, v, sum(n) OVER (PARTITION BY g ORDER BY v) AS need FROM h),
top AS (SELECT (sum(n) * 0.998::DOUBLE) AS top, sum(n) * 0.05::DOUBLE AS low FROM h WHERE g = 0),
-- the walk itself: at each level, how far each group has read
walk AS (SELECT ref, g, CASE WHEN ref > 0 THEN least(count(*) FILTER (need < ref) + 1, 256) ELSE 0 END AS raw FROM c, (SELECT unnest(range(trunc(top)::BIGINT)) AS ref FROM top) GROUP BY ref, g),
at AS (SELECT ref, max(raw) AS highest, count(*) FILTER (raw >= 200) AS white FROM walk GROUP BY ref),
stop AS (SELECT coalesce(min(ref) FILTER (white >= 2), max(ref)) AS last FROM at),
read AS (SELECT max(ref) AS read FROM at, stop, top WHERE ref <= last AND ref < trunc(low) AND highest < 8 + (200 - 8) // 4),
r AS (SELECT g::INTEGER AS plane, max(raw) FILTER (ref = last) AS raw, coalesce(max(raw) FILTER (ref = read), 0) AS floor FROM walk, stop, read GROUP BY g),
m AS (SELECT *, raw - floor AS height, (list_sort(list(raw - floor) OVER ())[2] + list_sort(list(raw - floor) OVER ())[3]) / 2.0 AS median FROM r),
b AS (SELECT *, height > median AS bright, list((height > median)::INTEGER) OVER (ORDER BY plane ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM m)
SELECT plane, raw::BIGINT AS raw, floor::BIGINT AS floor, height::BIGINT AS height, median::DOUBLE AS median, bright, CASE WHEN list_sum(w) <> 2 THEN 'count' WHEN w[1] = w[3] OR w[2] = w[4] THEN 'pairs' ELSE 'ok' END AS verdict FROM b""".replace("at AS", "levels_at AS").replace("FROM at", "FROM levels_at"))
def _(v):
    return fields.high_water(v.levels, "plane", "bin", 256, 8, 200)


@query("local_contrast", "W10", """
, l AS (SELECT x, y, r, g, b, (299 * r + 587 * g + 114 * b) // 1000 AS l FROM pix), ends AS (SELECT max(x) // 8 AS ex, max(y) // 8 AS ey FROM l),
h AS (SELECT s.tx, s.ty, v.v, count(l.l) AS n FROM (SELECT DISTINCT x // 8 AS tx, y // 8 AS ty FROM l) s CROSS JOIN range(256) v(v) LEFT JOIN l ON l.x // 8 = s.tx AND l.y // 8 = s.ty AND l.l = v.v GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY tx, ty) AS total, sum(greatest(n - 1, 0)) OVER (PARTITION BY tx, ty) AS cut FROM h),
k AS (SELECT tx, ty, v, total, least(n, 1) + cut // 256 + (v < cut % 256)::INTEGER AS n FROM c),
lut AS (SELECT tx, ty, v, least(greatest(floor(round(sum(n) OVER (PARTITION BY tx, ty ORDER BY v) * 255.0::DOUBLE / total, 9) + 0.5), 0), 255)::INTEGER AS o FROM k),
t AS (SELECT l.*, ex, ey, least(greatest((x - 4.0::DOUBLE) / 8, 0), ex) AS tx, least(greatest((y - 4.0::DOUBLE) / 8, 0), ey) AS ty FROM l, ends),
q AS (SELECT *, floor(tx)::INTEGER AS x0, least(floor(tx)::INTEGER + 1, ex) AS x1, floor(ty)::INTEGER AS y0, least(floor(ty)::INTEGER + 1, ey) AS y1, tx - floor(tx) AS fx, ty - floor(ty) AS fy FROM t),
e AS (SELECT q.*, (coalesce(a.o, 0) * (1 - fx) + coalesce(b2.o, 0) * fx) * (1 - fy) + (coalesce(c2.o, 0) * (1 - fx) + coalesce(d.o, 0) * fx) * fy AS e, 1 / (1 + exp(-4 * (l / 255.0::DOUBLE - 0.5))) AS sig
      FROM q LEFT JOIN lut a ON a.tx = x0 AND a.ty = y0 AND a.v = l LEFT JOIN lut b2 ON b2.tx = x1 AND b2.ty = y0 AND b2.v = l LEFT JOIN lut c2 ON c2.tx = x0 AND c2.ty = y1 AND c2.v = l LEFT JOIN lut d ON d.tx = x1 AND d.ty = y1 AND d.v = l),
n AS (SELECT *, l * (1 - (sig * 0.6 + 1 - sig)) + e * (sig * 0.6 + 1 - sig) AS new FROM e)
SELECT x, y, """ + ", ".join(f"least(greatest(CASE WHEN l > 4 THEN floor(round({c} * new / l, 9) + 0.5) ELSE {c} + floor(round(new - l, 9) + 0.5) END, 0), 255)::INTEGER AS {c}" for c in "rgb") + " FROM n")
def _(v):
    return local_contrast.local_contrast(v.pix)


# A cache of aged entries

AGE = 6 * 3600 * 1_000_000
_CALLS = f"""
, calls AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS "at" FROM events),
follow AS (SELECT a.user_id, a.event_type, a."at", min(b."at") AS next FROM (SELECT DISTINCT user_id, event_type, "at" FROM calls) a JOIN calls b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b."at" >= a."at" + {AGE} GROUP BY ALL),
fetches AS (WITH RECURSIVE f AS (SELECT user_id, event_type, min("at") AS "at" FROM calls GROUP BY ALL UNION ALL SELECT f.user_id, f.event_type, n.next FROM f JOIN follow n USING (user_id, event_type, "at")) SELECT * FROM f),
served AS (SELECT c.*, f."at" AS created_at, row_number() OVER (PARTITION BY c.user_id, c.event_type, c."at" ORDER BY event_id) AS k FROM calls c ASOF JOIN fetches f ON f.user_id = c.user_id AND f.event_type = c.event_type AND c."at" >= f."at")
SELECT event_id, user_id, event_type, "at", NOT ("at" = created_at AND k = 1) AS hit, created_at FROM served"""


def _calls(v) -> DataFrame:
    return v.table("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("cached_calls", "RX8", _CALLS)
def _(v):
    return aged_cache.cached_calls(_calls(v), ["user_id", "event_type"], "at", AGE, "event_id")


def _sunk(v, space: Workspace, rows: DataFrame, order: str, batches: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of ``rows`` gives that come in so many batches, by ``order`` (0 .. batches - 1); each is handled when it is there, whatever the number of its files."""
    path, out, state = space.path(), space.path(), space.path()
    for k in range(batches):
        rows.where(F.col(order) == k).drop(order).write.mode("append").parquet(path)
        stream = run(v.spark.readStream.schema(rows.drop(order).schema).parquet(path))
        with stateful.keyed_state(v.spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return space.kept(v.spark.read.schema(stream.schema).parquet(out))


def _buckets(rows: DataFrame) -> int:
    """So many that a bucket has some 20,000 rows at most, wherever keys are many."""
    return 64 + rows.count() // 20_000


@query("cached_stream", "RX8", _CALLS.replace("SELECT event_id, user_id, event_type, \"at\", NOT", "SELECT event_id AS id, concat(user_id, '/', event_type) AS key, \"at\", NOT"))
def _(v):
    """The same, as a stream in three batches that keeps one number for each key."""
    calls = _calls(v).select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("event_id").alias("id"), "at")
    buckets = _buckets(calls)
    ends = calls.agg(F.min("at").alias("a"), F.max("at").alias("b"))  # one row
    parted = calls.crossJoin(F.broadcast(ends)).withColumn("part", F.floor((F.col("at") - F.col("a")) * 3 / (F.col("b") - F.col("a") + 1))).drop("a", "b")
    with Workspace(v.spark) as space:
        return _sunk(v, space, parted, "part", 3, lambda stream: stateful.cached_stream(stream, AGE, buckets))


_OBSERVED = """
, changes AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", CASE WHEN event_type IN ('click', 'view') THEN 'mounted' ELSE 'gone' END AS state FROM events),
at_start AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 2 = 0 THEN 'mounted' ELSE 'gone' END AS state FROM customer WHERE c_custkey < 40 OR c_custkey % 100 = 0),
slots AS (SELECT key, "at", state FROM (SELECT *, row_number() OVER (PARTITION BY key, "at" // 3600 ORDER BY "at" DESC, id DESC) AS k FROM changes) WHERE k = 1),
rows_of AS (SELECT key, NULL::BIGINT AS "at", state, true AS first FROM at_start UNION ALL SELECT key, "at", state, false FROM slots)
SELECT key, "at", state, first FROM (SELECT *, lag(state) OVER (PARTITION BY key ORDER BY "at" NULLS FIRST) AS before FROM rows_of) WHERE first OR before IS NULL OR before <> state"""


def _observed(v) -> tuple[DataFrame, DataFrame]:
    state = F.when(F.col("event_type").isin("click", "view"), "mounted").otherwise("gone")
    changes = v.table("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), state.alias("state"))
    some = v.table("customer").where("c_custkey < 40 or c_custkey % 100 = 0")
    return changes, some.select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "mounted").otherwise("gone").alias("state"))


@query("observed_stream", "RX3 RX7", _OBSERVED)
def _(v):
    """Volumes with the state that they have at the start, then their changes, an hour's conflated, in three batches."""
    changes, at_start = _observed(v)
    buckets = _buckets(changes)
    slot = F.floor(F.col("at") / 3600)
    ends = changes.agg(F.min(slot).alias("a"), F.max(slot).alias("b"))  # one row
    parted = changes.crossJoin(F.broadcast(ends)).withColumn("part", F.floor((slot - F.col("a")) * 3 / (F.col("b") - F.col("a") + 1))).drop("a", "b")
    parted = parted.unionByName(stateful.asking(at_start).withColumn("part", F.lit(0).cast("long")))
    with Workspace(v.spark) as space:
        return _sunk(v, space, parted, "part", 3, lambda stream: stateful.observed(stream, at_start, 3600, buckets))


@query("observed_table", "RX3 RX7", _OBSERVED)
def _(v):
    return stateful.observed_table(*_observed(v), 3600)


@query("latest_run", "RX5", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _(v):
    """A run over a half of the table is overtaken by one over the whole: its jobs are cancelled and only the newest is read."""
    run = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    with Workspace(v.spark) as space:
        runs = latest.Latest(v.spark, space.path())
        runs.changed(lambda: run(v.table("events").where("event_id % 2 = 0")))
        runs.changed(lambda: run(v.table("events")))
        return space.kept(runs.wait())


# Walks, hulls, picture files


@query("progressive_listing", "RX6 SRC9", """
, entries AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 THEN (doc_id - 1) // 5 END AS parent, doc_id % 3 <> 1 AS is_dir, n_chars AS modified FROM documents),
walk AS (WITH RECURSIVE w AS (SELECT id, is_dir, modified, 0 AS level FROM entries WHERE parent = 0 UNION ALL SELECT e.id, e.is_dir, e.modified, w.level + 1 FROM w JOIN entries e ON e.parent = w.id WHERE w.is_dir) SELECT * FROM w)
SELECT id, level, modified, row_number() OVER (ORDER BY modified DESC, id) AS pos FROM walk WHERE NOT is_dir""")
def _(v):
    """Files as each level of folders is found, and their place in the whole list, newest first."""
    id_ = F.col("doc_id")
    entries = v.table("documents").select(id_.alias("id"), F.when(id_ > 0, F.floor((id_ - 1) / 5)).alias("parent"), (id_ % 3 != 1).alias("is_dir"), F.col("n_chars").alias("modified"))
    with Workspace(v.spark) as space:
        _, whole = listing.list_all(entries, 0, "modified", space)
        return space.kept(ordered.positions(whole.select("id", "level", "modified"), [], [F.desc("modified"), F.col("id")]))


@query("folder_scan", "SRC8 SRC9", "SELECT lang AS folder, count(*) AS lines FROM documents GROUP BY lang")
def _(v):
    """Text files in a folder for each language, found by their extension, with as many lines as they were given."""
    with Workspace(v.spark) as space:
        path = space.path()
        v.table("documents").select("lang", F.col("doc_id").cast("string").alias("value")).repartition("lang").write.partitionBy("lang").text(path)
        found = files.scan_folder(v.spark, path, ["txt"]).select("path", F.regexp_extract("path", "lang=([^/]*)/", 1).alias("folder"))
        lines = v.spark.read.text(f"{path}/*").select(F.input_file_name().alias("file"))
        name = lambda c: F.regexp_extract(c, "[^/]*/[^/]*$", 0)
        met = found.withColumn("name", name("path")).join(lines.withColumn("name", name("file")), "name")
        return space.kept(met.groupBy("folder").agg(F.count("*").alias("lines")))


@query("hulls", "SF36", """
, p AS (SELECT x, y, (x // 8) * 100000 + y // 8 AS tile FROM pix WHERE r % 3 <> 0),
-- the corners of a whole are among the ends of its rows
c AS (SELECT * FROM p UNION ALL SELECT x, y, -1 FROM (SELECT y, unnest([min(x), max(x)]) AS x FROM p GROUP BY y)),
d AS (SELECT DISTINCT tile, x, y FROM c), n AS (SELECT tile, count(*) AS n FROM d GROUP BY tile),
e AS (SELECT a.tile, a.x, a.y, b.x AS bx, b.y AS b_y, bool_and(CASE WHEN t.z > 0 THEN true WHEN t.z < 0 THEN false ELSE t.dot >= 0 AND t.d <= (b.x - a.x) ** 2 + (b.y - a.y) ** 2 END) AS side
      FROM d a JOIN d b ON a.tile = b.tile AND (a.x <> b.x OR a.y <> b.y) JOIN d o ON o.tile = a.tile,
      LATERAL (SELECT (b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) AS z, (b.x - a.x) * (o.x - a.x) + (b.y - a.y) * (o.y - a.y) AS dot, (o.x - a.x) ** 2 + (o.y - a.y) ** 2 AS d) t GROUP BY ALL)
SELECT tile, x, y FROM e WHERE side UNION ALL SELECT tile, x, y FROM d JOIN n USING (tile) WHERE n = 1""")
def _(v):
    """The corners of the hull of each tile's points, and (tile -1) of all."""
    p = v.pix.where("r % 3 <> 0").select("x", "y", (F.floor(F.col("x") / 8) * 100000 + F.floor(F.col("y") / 8)).cast("long").alias("tile"))
    return hull.hulls(p.unionByName(p.withColumn("tile", F.lit(-1).cast("long"))), ["tile"], 16).select("tile", "x", "y")


@query("line_crossings", "SF36", """
SELECT x, y, CASE WHEN d <> 0 THEN round(2 + t * 26, 6) END AS at_x, CASE WHEN d <> 0 THEN round(1 + t * 3, 6) END AS at_y
FROM (SELECT x, y, 26 * (r - 128) - 3 * (g - 100)::DOUBLE AS d, ((x - 2) * (r - 128) - (y - 1) * (g - 100)) / nullif((26 * (r - 128) - 3 * (g - 100))::DOUBLE, 0) AS t FROM pix)""")
def _(v):
    """Where a fixed line meets the one through each place in the direction that its colours give."""
    f = lambda c: F.col(c).cast("double")
    here = (f("x"), f("y"))
    there = (f("x") + f("g") - 100, f("y") + f("r") - 128)
    at = geometry.line_crossing((F.lit(2.0), F.lit(1.0)), (F.lit(28.0), F.lit(4.0)), here, there)
    return v.pix.select("x", "y", F.round(at["x"], 6).alias("at_x"), F.round(at["y"], 6).alias("at_y"))


def _band(uri: str, width: int, strip: int):
    def run(key: tuple, px: pd.DataFrame) -> pd.DataFrame:
        rows = px.groupby("y").filter(lambda r: len(r) == width).sort_values(["y", "x"])
        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        if len(rows):
            with store.open_output_stream(f"{top}/{key[0]:08d}.tif") as out:
                out.write(bigtiff.encode(rows[["r", "g", "b"]].to_numpy().reshape(-1, width, 3) * 257, strip))
        return pd.DataFrame({"band": [key[0]], "rows": [len(rows) // width]})

    return run


@query("picture_files", "SRC17", "SELECT y // 8 AS band, x, y, r, g, b FROM pix JOIN (SELECT y FROM pix GROUP BY y HAVING count(*) = 32) USING (y)")
def _(v):
    """Files of eight rows each, in strips of three, read back strip by strip; samples of 8 bits stand in 16."""
    v.spark.dataSource.register(bigtiff.BigTiff)
    with Workspace(v.spark) as space:
        path = space.path()
        uri = path if ":" in path.split("/")[0] else f"file://{path}"
        v.pix.select("x", "y", "r", "g", "b", F.floor(F.col("y") / 8).alias("band")).groupBy("band").applyInPandas(_band(uri, 32, 3), "band long, rows long").agg(F.sum("rows")).collect()
        read = v.spark.read.format("bigtiff").load(uri)
        band = F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long")
        byte = lambda c: F.shiftright(c, 8).alias(c)
        return space.kept(read.select(band.alias("band"), "x", (F.col("y") + band * 8).cast("int").alias("y"), byte("r"), byte("g"), byte("b")))
