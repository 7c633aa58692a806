"""Queries without SQL, and operators, against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenframe import plans
from lumenframe.functions import geometry
from lumenframe.functions import scalar as s
from lumenframe.functions.difference import removals
from lumenframe.operators import raster
from lumenframe.operators.components import min_labels
from lumenframe.operators.transforms import IDENTITY, chain
from lumenframe.sources.shared import Workspace


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def kept(s, gone):
    """Whether ``gone`` is a subsequence of s."""
    it = iter(s)
    return all(c in it for c in gone)


def test_difference(spark, sf_dir):
    r = random.Random(3)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in "ab")
        x, y = removals(a, b)
        assert len(a) - len(x) == len(b) - len(y) == common(a, b) and kept(a, x) and kept(b, y)
    for row in plans.QUERIES["string_difference"](spark, sf_dir).limit(20).collect():
        assert len(row.p_name) - len(row.removed) == common(row.p_name, row.p_type)


def test_all_digests(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = plans.QUERIES["all_digests"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert all(r[k] == hashlib.new(k, texts[r.doc_id]).hexdigest() for k in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))


def test_labels_settle_or_fail(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)], "node long, other long")
    assert {r.label for r in min_labels(nodes, edges, 60).collect()} == {0}
    with pytest.raises(RuntimeError):
        min_labels(nodes, edges, 2)


def _sets(cells, width):
    """Label, size and box of the largest set, by flooding."""
    left, best = set(cells), None
    for c in sorted(cells, key=lambda c: c[1] * width + c[0]):
        if c in left:
            left.discard(c)
            found = [c]
            for x, y in found:
                for near in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                    if near in left:
                        left.discard(near)
                        found.append(near)
            xs, ys = zip(*found)
            if best is None or len(found) > best[1]:
                best = (c[1] * width + c[0], len(found), min(xs), max(xs), min(ys), max(ys))
    return best


def test_long_way_through_tiles(spark):
    """A way that winds through hundreds of tiles, and sets of chance; few rounds of labels do."""
    winding = [(x, y) for y in range(64) for x in range(32) if y % 2 == 0 or x == (31 if y % 4 == 1 else 0)]
    for seed, cells in [(0, winding), *[(k, [(x, y) for y in range(100) for x in range(32) if random.Random(k * 10_000 + y * 32 + x).random() < 0.6]) for k in (1, 2)]]:
        mask = spark.createDataFrame(cells, "x int, y int")
        got = raster.largest_component(mask, 32, rounds=12, tile=4)
        assert [tuple(r) for r in got.collect()] == [_sets(cells, 32)] and got.schema["label"].dataType.simpleString() == "int", seed
    assert raster.largest_component(mask.limit(0), 32).count() == 0


def test_sizes_do_not_multiply(spark, monkeypatch):
    """A round's table has the size of its files; as a product of the rounds before, it grew until it filled the driver."""
    sizes = []

    def written(space, df, write=Workspace.written):
        out = write(space, df)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out

    monkeypatch.setattr(Workspace, "written", written)
    edges = spark.range(300).select(F.col("id").alias("node"), ((F.col("id") * 7919 + 1) % 300).alias("other"))
    labels = min_labels(spark.range(301).select(F.col("id").alias("node")), edges, 60)
    assert len(sizes) > 4 and max(sizes) < 1 << 20 and labels.select("label").distinct().count() >= 2


@pytest.mark.parametrize("name", ["xpath", "xpath_documents", "xpath_ways", "xpath_axes"])
def test_documents_are_parsed_once(spark, sf_dir, name):
    """One XPath expression, which Spark evaluates once a row, by all cores, however few row groups the file has."""
    df = plans.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"XPath\w+Evaluator\(.*?\)\.evaluate", plan))) == 1
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_settings_are_matched_once(spark, sf_dir):
    df = plans.QUERIES["develop_settings"](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert df.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    text = 'a:Exposure2012="5" Whites2012="1" b:Exposure2012="10" Whites2012="x" HueAdjustmentRed="50"'
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(s.develop_settings("t").alias("m")).collect()
    assert [r.m for r in got] == [{"Whites2012": 0.01, "Exposure2012": 2.0, "HueAdjustmentRed": 0.5}, {}, None]


def test_empty_chain_and_lines(spark):
    rows = spark.range(3)
    assert chain([])(rows).collect() == rows.collect() and chain([]).key == IDENTITY.key
    k = lambda *xy: tuple(F.lit(float(c)) for c in xy)
    got = rows.limit(1).select(geometry.line_crossing(k(0, 0), k(2, 2), k(0, 2), k(2, 0)).alias("a"), geometry.line_crossing(k(0, 0), k(1, 1), k(1, 0), k(2, 1)).alias("b")).first()
    assert tuple(got.a) == (1.0, 1.0) and got.b is None
