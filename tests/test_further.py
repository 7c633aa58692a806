"""Operators of the further queries against brute force and on odd input."""

import random
import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import aged_cache, copied, fields, hull, lens_match, listing, ordered
from lumenframe.sources import bigtiff
from lumenframe.sources.shared import Workspace
from lumenframe.streaming import latest, stateful


def test_positions_and_neighbours_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(1000), k) for k in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    want, last = {}, {}
    for g, _, k in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[k] = [len([0]) + (want[last[g]][0] if g in last else 0), last.get(g), None]
        if g in last:
            want[last[g]][2] = k
        last[g] = k
    order = [F.col("v"), F.col("id")]
    assert {r.id: r.pos for r in ordered.positions(df, ["g"], order).collect()} == {k: w[0] for k, w in want.items()}
    assert {r.id: (r.before, r.after) for r in ordered.beside(df, ["g"], order, "id").collect()} == {k: (w[1], w[2]) for k, w in want.items()}
    whole = [r.id for r in ordered.positions(df, [], [F.desc("v"), F.col("id")]).orderBy("pos").collect()]
    assert whole == [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    assert ordered.positions(df.limit(0), ["g"], order).count() == 0


def test_cache_across_ranges(spark):
    rng = random.Random(2)
    calls = [("hot" if rng.random() < 0.7 else rng.choice("xyz"), rng.randrange(50_000), k) for k in range(8000)] + [("x", None, 9000), (None, 5, 9001)]
    df = spark.createDataFrame(calls, "key string, at long, id int")
    created, want = {}, {}
    for key, at, k in sorted((c for c in calls if c[1] is not None), key=lambda c: (c[1], c[2])):
        hit = key in created and created[key] + 37 > at
        created[key] = created[key] if hit else at
        want[k] = (hit, created[key])
    got = {r.id: (r.hit, r.created_at) for r in aged_cache.cached_calls(df, ["key"], "at", 37, "id").collect()}
    assert got == want and 0 < sum(h for h, _ in got.values()) < len(got)
    assert aged_cache.cached_calls(df.limit(0), ["key"], "at", 37, "id").count() == 0


def walked(hist, black, white):
    """The walk step by step."""
    n, total = len(hist[0]), sum(hist[0])
    acc, raw, off = [0] * 4, [0] * 4, [0] * 4
    for ref in range(int(total * 0.998)):
        for i in range(4):
            while acc[i] < ref and raw[i] < n:
                acc[i] += hist[i][raw[i]]
                raw[i] += 1
        if ref < int(total * 0.05) and max(raw) < black + int((white - black) / 4):
            off = list(raw)
        if sum(r >= white for r in raw) >= 2:
            break
    return raw, off


def test_high_water_against_the_walk(spark):
    rng = random.Random(4)
    for black, white, spread in ((2, 40, (9, 30, 9, 30)), (0, 20, (5, 5, 60, 60)), (3, 1, (9, 9, 9, 9)), (10, 63, (2, 3, 60, 63)), (0, 2, (1, 40, 40, 1))):
        samples = [(i, min(63, int(rng.expovariate(1 / s)))) for i, s in enumerate(spread) for _ in range(rng.randrange(100, 400))]
        hist = [[sum(g == i and v == x for g, v in samples) for x in range(64)] for i in range(4)]
        got = fields.high_water(spark.createDataFrame(samples, "g int, v int"), "g", "v", 64, black, white).orderBy("g").collect()
        assert ([r.raw for r in got], [r.floor for r in got]) == walked(hist, black, white), (black, white)
        heights = sorted(r.height for r in got)
        assert [r.bright for r in got] == [r.height > (heights[1] + heights[2]) / 2 for r in got]
    empty = fields.high_water(spark.createDataFrame([], "g int, v int"), "g", "v", 64, 2, 40).collect()
    assert [(r.raw, r.floor, r.verdict) for r in empty] == [(0, 0, "count")] * 4


def test_copied_blocks(spark):
    rng = np.random.default_rng(5)
    px = rng.integers(0, 256, (70, 90, 3))
    px[40:60, 60:85] = px[5:25, 3:28]  # a copy 35 down, 57 right
    df = spark.createDataFrame([(x, y, *map(int, px[y, x])) for y in range(70) for x in range(90)], "x int, y int, r int, g int, b int")
    blocks = copied.block_spectra(df, 16, 4, 1.0)
    assert blocks.count() == 55 * 75
    got = copied.copied_blocks(blocks, 16, 10).collect()
    assert {(r.shift_x, r.shift_y) for r in got} == {(57, 35)}
    assert {(r.x, r.y) for r in got} >= {(x, y) for x in range(3, 12) for y in range(5, 9)} and all(r.n >= 50 for r in got)
    odd = spark.createDataFrame([(1, 0, bytearray(b"\x00\x80")), (2, 0, bytearray(b"\xff\x00")), (3, 0, bytearray(b"\x7f")), (4, 0, bytearray(b"\x00\x01")), (5, 0, bytearray(b""))], "x int, y int, spectrum binary")
    assert [r.x for r in copied.block_order(odd).orderBy("pos").collect()] == [5, 2, 1, 4, 3]


def test_hulls(spark):
    rng = random.Random(6)

    def brute(points):
        points = sorted(set(points))
        z = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if len(points) < 3:
            return points
        out = set()
        for a in points:  # a corner if a line through it has all others strictly on one side, but for those behind it
            for b in points:
                if a != b and all(z(a, b, c) > 0 or z(a, b, c) == 0 and (c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1]) >= 0 for c in points):
                    out.add(a)
        return sorted(out)

    for points in ([], [(1, 1)], [(1, 1), (1, 1), (2, 3)], [(k, 2 * k) for k in range(9)], [(x, y) for x in range(4) for y in range(4)], [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]):
        assert sorted(hull.hull(points)) == brute(points)
    rows = [(g, rng.randrange(-500, 500), rng.randrange(300)) for g in (1, 2) for _ in range(600)] + [(3, 7, 7), (3, None, 1)]
    got = hull.hulls(spark.createDataFrame(rows, "g int, x int, y int"), ["g"], 16).collect()
    for g in (1, 2, 3):
        assert [(r.x, r.y) for r in sorted((r for r in got if r.g == g), key=lambda r: r.corner)] == hull.hull([r[1:] for r in rows if r[0] == g and r[1] is not None])


def test_hulls_without_a_call_for_each_tile(spark):
    """Numbers with fractions and points off the ends of rows; tiles are rows with lists."""
    rng = random.Random(8)
    rows = [("a", rng.random() * 90, rng.random() * 40) for _ in range(500)] + [("b", float(x), float(y)) for x in range(40) for y in range(40)] + [("c", -3.5, 2.0)] * 3
    made = hull.hulls(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], 4)
    got = made.collect()
    for g in "abc":
        assert [(r.x, r.y) for r in sorted((r for r in got if r.g == g), key=lambda r: r.corner)] == hull.hull([r[1:] for r in rows if r[0] == g])
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()


def test_lens_candidates_share_a_token(spark):
    asked = spark.createDataFrame([(1, "Alpha 50mm F1.8 OSS", "Acme", "Acme", 1.0, 1, 50.0, 1.8), (2, "zzz", None, None, None, None, None, None), (3, "", "Acme", "Acme", 1.0, 1, 50.0, 1.8), (4, "50mm 1.8 thing", None, "Acme", 1.5, 2, None, None)], "ask_id int, text string, maker string, body_maker string, crop double, mount int, focal double, aperture double")
    lenses = [(10, "alpha 50mm f1.8 oss", "ACME", 1.0, 1, 50.0, None, 1.8), (11, "Alpha 50mm f1.8", "Acme", 1.0, 1, 50.0, 50.0, 1.8), (12, "Alpha 50mm f1.8 OSS USM II", "Acme", 1.5, 2, 50.0, 50.0, 1.8), (13, "Beta 50mm f1.8", "Other", 1.6, 1, 50.0, 50.0, 1.8), (14, "Alpha 85mm f1.4", "Acme", 1.0, 1, 85.0, 85.0, 1.4), (15, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(lenses, "lens_id int, model string, maker string, crop double, mount int, focal_low double, focal_high double, aperture double")
    got = lens_match.rank_lenses(asked, table, 4).orderBy("ask_id", "place").collect()
    assert [(r.lens_id, r.name, r.sure) for r in got if r.ask_id == 1] == [(10, 5, True), (12, 4, True), (11, 3, True), (13, 2, False)]
    assert {r.ask_id for r in got} == {1, 4} and [r.name for r in got if r.ask_id == 4] == [2, 2, 2, 2]
    words = lambda c: set(c.lower().replace("mm", " mm").replace("f1", "f 1").split())
    named = {r[0]: words(r[1] or "") for r in lenses}
    for a, l in ((r.ask_id, r.lens_id) for r in lens_match.candidates(*lens_match._sides(asked, table)).collect()):
        assert a in (1, 4) and named[l]
    adapted = lens_match.rank_lenses(asked, table, 1, adapted=True).where("ask_id = 1").first()
    assert adapted.mount == 0 and adapted.lens_id == 10


def test_lenses_are_not_broadcast(spark):
    """The driver gathers none of the tables that grow with the lenses, however small they are."""
    asked = spark.range(50).selectExpr("id as ask_id", "concat('alpha ', id, 'mm') as text", "'m' as maker", "'m' as body_maker", "1.0D as crop", "1 as mount", "50.0D as focal", "2.0D as aperture")
    lenses = asked.selectExpr("ask_id as lens_id", "text as model", "maker", "crop", "mount", "focal as focal_low", "focal as focal_high", "aperture")
    got = lens_match.rank_lenses(asked, lenses, 1)
    assert [(r.ask_id, r.lens_id) for r in got.orderBy("ask_id").collect()] == [(k, k) for k in range(50)]
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_walk_level_by_level(spark):
    rows = [(1, 0, True, 5), (2, 0, False, 9), (3, 1, False, 7), (4, 1, True, 1), (5, 4, False, 8), (1, 4, True, 5), (6, 99, False, 3), (7, None, False, 2)]
    entries = spark.createDataFrame(rows, "id int, parent int, is_dir boolean, modified int")
    with Workspace(spark) as space:
        levels, whole = listing.list_all(entries, 0, "modified", space)
        assert [sorted(r.id for r in x.collect()) for x in levels] == [[2], [3], [5]]  # the ring back to 1 is not followed again
        assert [r.id for r in whole.collect()] == [2, 5, 3]
        assert listing.list_all(entries, 42, "modified", space)[1].count() == 0


def test_bigtiff(spark, tmp_path):
    rng = np.random.default_rng(7)
    pictures = {"a.tif": (rng.integers(0, 65536, (10, 7, 3)), 4), "b.tiff": (rng.integers(0, 65536, (3, 5, 3)), 256)}
    for name, (px, rows) in pictures.items():
        (tmp_path / name).write_bytes(bigtiff.encode(px, rows))
    (tmp_path / "notes.txt").write_text("no picture")
    spark.dataSource.register(bigtiff.BigTiff)
    df = spark.read.format("bigtiff").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 + 1  # a strip each
    for name, (px, _) in pictures.items():
        got = {(r.y, r.x): (r.r, r.g, r.b) for r in df.where(F.col("path").endswith("/" + name)).collect()}
        assert got == {(y, x): tuple(map(int, px[y, x])) for y in range(px.shape[0]) for x in range(px.shape[1])}
    good = bigtiff.encode(pictures["a.tif"][0], 4)
    assert bigtiff.strips(lambda at, n: good[at : at + n], len(good))[:2] == (7, 10)
    broken = [good[:10], b"XX" + good[2:], good[:2] + struct.pack("<H", 42) + good[4:], good[:8] + struct.pack("<Q", 1 << 40) + good[16:], good[:-1], good[:16] + struct.pack("<Q", 1 << 50) + good[24:]]
    for bad in broken:
        with pytest.raises(ValueError):
            bigtiff.strips(lambda at, n, bad=bad: bad[at : at + n], len(bad))


def test_a_stale_run_is_cancelled(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    runs = latest.Latest(spark, str(tmp_path / "out"))
    began = time.time()
    runs.changed(lambda: spark.range(4).repartition(2).mapInPandas(slow, "id long"))
    time.sleep(3)
    runs.changed(lambda: spark.range(7))
    assert runs.wait().count() == 7 and time.time() - began < 45
    assert runs.published == 2 and list(runs.failed) == [1]
    runs.changed(lambda: spark.range(3).select(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        runs.wait()
    assert threading.active_count() < 50


def test_one_state_for_many_keys(spark, tmp_path):
    """300 keys in 4 buckets, in two batches: 4 states, and each call as if its key were alone."""
    rng = random.Random(9)
    calls = [(f"k{rng.randrange(300)}", k, k * 10) for k in range(1500)]
    schema = "key string, id long, at long"
    for part in (calls[:900], calls[900:]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.cached_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3000, buckets=4)
        with stateful.keyed_state(spark):
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
    got = {r.id: (r.key, r.hit, r.created_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    created, want = {}, {}
    for key, k, at in calls:
        hit = key in created and created[key] + 3000 > at
        created[key] = created[key] if hit else at
        want[k] = (key, hit, created[key])
    assert got == want
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_state_at_hand_first(spark, tmp_path):
    """Three batches: keys tell what they had at the start, then changes, those of one slot once, and no change twice."""
    path, schema = str(tmp_path / "in"), "key string, id long, at long, state string"
    at_start = spark.createDataFrame([("a", "on"), ("b", "off")], "key string, state string")
    batches = [
        [("a", 1, 10, "off"), ("a", 2, 11, "on"), ("c", 3, 12, "on")],
        [("a", 4, 100, "off"), ("c", 5, 105, "on"), ("a", 6, 150, "on")],
        [("a", 7, 200, "on"), ("b", 8, 201, "off"), ("c", 9, 300, "off")],
    ]
    out = tmp_path / "out"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        (df.unionByName(stateful.asking(at_start)) if k == 0 else df).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        with stateful.keyed_state(spark):
            q = stateful.observed(stream, at_start, 50).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        got = sorted((r.key, r.at, r.state, r.first) for r in spark.read.parquet(str(out)).na.fill(-1, ["at"]).collect())
        if k == 0:
            assert got == [("a", -1, "on", True), ("b", -1, "off", True), ("c", 12, "on", False)]
    assert got == [("a", -1, "on", True), ("a", 100, "off", False), ("a", 150, "on", False), ("b", -1, "off", True), ("c", 12, "on", False), ("c", 300, "off", False)]
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted((r.key, r.at if r.at is not None else -1, r.state, r.first) for r in stateful.observed_table(every, at_start, 50).collect()) == got
