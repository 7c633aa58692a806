"""File sources, catalogue writes, streams and pieces without SQL."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import scalar as s
from lumenframe.operators import catalogue, stats
from lumenframe.operators.grid import GridFilter
from lumenframe.sources import files
from lumenframe.streaming import reactive


def test_pipe_table(spark, tmp_path):
    p = tmp_path / "t.tbl"
    p.write_text("# comment\n0|0|0|0|0|1000|1000\n160|-1|0|1|0|1000|1024\n368|1|2|3|0|1|1|4.5|6\nbad\n7|x|1|1\n9|1|2|3\n160|5|0|1|0|1000|1024\n")
    got = {r.lens_id: (r.contrast, r.wb_b, r.ca) for r in files.pipe_table(spark, str(p)).collect()}
    assert got == {0: (0, 1000, 0), 160: (5, 1024, 0), 368: (1, 1, 4.5), 9: (1, 0, 0)}


def test_json_lines_vectors_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"model": " X1 ", "trim_r": 9.0, "trim_b": 0.1}, {"model": "Y", "trim_r": None}]))
    assert [tuple(r) for r in files.json_array(spark, str(tmp_path / "b.json"), 0.5, 2.0).orderBy("model").collect()] == [("x1", 2.0, 0.5), ("y", 1.0, 1.0)]
    (tmp_path / "l1.txt").write_text("B\n# no\nA\n")
    (tmp_path / "l2.txt").write_text("A\r\nC\n")
    assert [r.line for r in files.line_lists(spark, str(tmp_path / "l1.txt"), str(tmp_path / "l2.txt")).orderBy("pos").collect()] == ["B", "A", "C"]
    np.save(tmp_path / "v.npy", np.array([1, 2.5], dtype=np.float32))
    assert files.load_vectors(spark, str(tmp_path)).collect()[0].vector == [1.0, 2.5]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.NEF").write_bytes(b"123")
    assert [r.length for r in files.scan_folder(spark, str(tmp_path), files.RAW_EXTENSIONS).collect()] == [3]
    rows = spark.createDataFrame([('{"a": 1}',), ("broken",)], "value string")
    assert [r.a for r in files.safe_decode(rows, "a int").collect()] == [1]


def test_insert_and_versions(spark, tmp_path):
    held, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    assert catalogue.insert_or_fail(new, held, ["k"]).count() == 2
    with pytest.raises(ValueError):
        catalogue.insert_or_fail(held, held, ["k"])
    path = catalogue.rewrite_with_backup(held, str(tmp_path), 2)
    assert spark.read.parquet(path).count() == 1


def test_masks_round_trip():
    for f in (GridFilter(flags=frozenset({0, 2}), min_rating=3, color=None), GridFilter(color=5, min_rating=5), GridFilter(flags=frozenset({1}), color=0)):
        assert GridFilter.unpack(f.pack()) == f


def test_histogram_rules(spark):
    rows = spark.createDataFrame([("c", 1)] * 1 + [("c", 254)] * 99, "channel string, bin int")
    h = stats.histogram(rows, ["channel"])
    r = stats.drives(stats.percentiles(h, ["channel"], {"p1": 0.01, "p90": 0.9, "p99": 0.99})).first()
    assert (r.p1, r.p90, r.p99) == (1, 254, 254) and abs(r.clip - 0.99) < 1e-12 and r.range == pytest.approx(np.log2(254))
    empty = stats.cdf(stats.histogram(rows.where("bin < 0").unionByName(rows.limit(0)), ["channel"]), ["channel"])
    assert empty.count() == 0


#: Expression and result by XPath 1.0.
XPATH = {"1 div 0": float("inf"), "-1 div 0": float("-inf"), "5 mod 2": 1.0, "-5 mod 2": -1.0, "1.5 mod -0.5": 0.0, "floor(-1.5)": -2.0, "ceiling(-1.5)": -1.0, "round(2.5)": 3.0, "round(-2.5)": -2.0, "string-length('title')": 5.0, "number('12')": 12.0, "sum(/a/b)": 3.0, "count(//b)": 2.0, "1 + 2 * 3": 7.0}


def test_xpath_numbers(spark):
    doc = F.lit("<a><b>1</b><b>2</b></a>")
    got = spark.range(1).select(*[F.xpath_double(doc, F.lit(e)).alias(str(i)) for i, e in enumerate(XPATH)]).first()
    assert list(got) == list(XPATH.values())
    words = {"concat('a', 'b')": "ab", "substring('12345', 2, 3)": "234", "substring-before('1999/04', '/')": "1999", "substring-after('1999/04', '/')": "04", "normalize-space('  a  b ')": "a b", "translate('bar', 'abc', 'ABC')": "BAr", "string(1 = 1)": "true", "boolean('')": "false", "not(1 = 2)": "true", "starts-with('tititoto', 'titi')": "true", "contains('tititoto', 'x')": "false"}
    got = spark.range(1).select(*[F.xpath_string(doc, F.lit(e)).alias(str(i)) for i, e in enumerate(words)]).first()
    assert list(got) == list(words.values())


def test_follow_and_debounce(spark, tmp_path, sf_dir):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = reactive.follow(stream, lambda df: df.agg(F.count("*").alias("n")), lambda: spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().n == 3
    rows = spark.createDataFrame([(1, 0, "a"), (1, 3, "b"), (1, 30, "c")], "k int, t int, v string").withColumn("t", F.timestamp_seconds("t"))
    assert sorted(r.v for r in reactive.debounce(rows, "k", "t", "10 seconds", ["v"]).collect()) == ["b", "c"]


def test_scalar_edges(spark):
    one = spark.range(1)
    got = one.select(s.tag(F.lit(" A|b   C ")), s.tag(F.lit(" | ")), s.human_size(F.lit(1023)), s.human_size(F.lit(999949)), s.human_size(F.lit(5 << 40)), s.trim_zeros(F.lit("1.500")), s.stack_key(F.lit(".hidden")), s.rational(F.lit("1/0")), s.rational(F.lit("3")), s.mirror(F.lit(-1), 1)).first()
    assert list(got) == ["a b c", None, "1023 B", "976.5 kB", "5.0 TB", "1.5", ".hidden", None, 3.0, 0]
