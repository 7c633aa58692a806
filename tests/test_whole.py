"""Queries over inputs larger than the supplied small tables: no row may be left out."""

import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from lumenframe import plans
from lumenframe.operators import lookup, raster, stats
from tests.compare import TABLES, connect, spark_rows, sql_rows


def _folder(tmp, sf_dir, documents):
    """The small tables with other documents."""
    for t in TABLES:
        if t != "documents":
            shutil.copy(f"{sf_dir}/{t}.parquet", tmp)
    import duckdb

    duckdb.sql(f"copy ({documents}) to '{tmp}/documents.parquet' (format parquet)")
    return str(tmp)


@pytest.fixture(scope="module")
def many(tmp_path_factory, sf_dir):
    return _folder(tmp_path_factory.mktemp("many"), sf_dir, "select i as doc_id, 'a' as text, 'en' as lang, 's' as source, (hash(i) % 5003)::bigint as n_chars from range(5000) t(i)")


PIX = "box_blur median_rows guided_filter erosion tile_mode tile_noise equalised equalised_tiles pixel_arithmetic blends layers lag_difference picture_difference copied_blocks best_segment scenes".split()


@pytest.mark.parametrize("name", PIX)
def test_whole_picture(spark, many, name):
    """As the SQL says of a view without its bound."""
    cols, want = sql_rows(connect(many), plans.SQL[name].replace("doc_id < 4096", "true"))
    df = plans.QUERIES[name](spark, many)
    assert sorted(df.columns) == cols and spark_rows(df) == want


def test_largest_blob_far_down(spark, tmp_path, sf_dir):
    d = _folder(tmp_path, sf_dir, "select i as doc_id, 'a' as text, 'en' as lang, 's' as source, case when i between 10 and 14 or i between 4500 and 4507 or i between 4533 and 4535 then 100 else 0 end::bigint as n_chars from range(5000) t(i)")
    assert [tuple(r) for r in plans.QUERIES["largest_blob"](spark, d).select("label", "n", "x0", "x1", "y0", "y1").collect()] == [(4500, 11, 20, 27, 140, 141)]


def test_next_across_shards(spark):
    rows = spark.createDataFrame([(y, float(y * y)) for y in (0, 1, 3, 4, 9, 10, 11, 30)], "y long, m double")
    assert sorted(tuple(r) for r in stats.with_next(rows, "y", "m", shard=4).select("y", "next").collect()) == [(0, 1.0), (1, 9.0), (3, 16.0), (4, 81.0), (9, 100.0), (10, 121.0), (11, 900.0), (30, None)]


def test_long_texts_have_digests(spark, tmp_path, sf_dir):
    """The edges of a text of over 64 KiB differ; hashes by hashlib."""
    d = _folder(tmp_path, sf_dir, "select i as doc_id, repeat(chr(97 + i::int), 10000 * i) || repeat('ü', 9000 * i) as text, 'en' as lang, 's' as source, 28000 * i as n_chars from range(8) t(i)")
    texts = {i: (chr(97 + i) * 10000 * i + "ü" * 9000 * i).encode() for i in range(8)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (hashlib.md5(b).hexdigest(), hashlib.sha1(b).hexdigest(), sha(b), f"{len(b)}:{sha(b[:65536])}:{sha(b[-65536:])}") for i, b in texts.items()}
    got = {r["doc_id"]: (r["md5"], r["sha1"], r["sha256"], r["fp"]) for r in plans.QUERIES["digests"](spark, d).collect()}
    assert got == want


def test_all_points_are_swept(spark, sf_dir):
    """As the SQL says without its samples, over 3,000 slopes."""
    con = connect(sf_dir)
    whole = plans.SQL["threshold_search"]
    assert "seq %" not in whole.split(", bins AS")[1] and spark_rows(plans.QUERIES["threshold_search"](spark, sf_dir)) == sql_rows(con, whole)[1]
    whole = plans.SQL["robust_slope"]
    assert "seq %" not in whole.split(", pts AS")[1] and "range(3000)" in whole
    assert spark_rows(plans.QUERIES["robust_slope"](spark, sf_dir)) == sql_rows(con, whole)[1]


def test_tables_beyond_the_bound(spark):
    n = lookup.SMALL_ROWS + 5
    rules = spark.range(n).select(F.col("id").alias("pos"), F.format_string("<%06d>", "id").alias("needle"), (F.col("id") * 2).alias("out"))
    rows = spark.createDataFrame([(k, f"a<{k:06d}>b") for k in (0, n - 2, n - 1)], "key long, text string")
    assert sorted(tuple(r) for r in lookup.first_containment(rows, rules, "key", "text").collect()) == [(k, 2 * k) for k in (0, n - 2, n - 1)]
    table = spark.range(300).select(F.col("id").alias("i"), (F.col("id") + 1).alias("o"))
    assert raster.lut(spark.range(300).select(F.col("id").alias("v")), table, "v").count() == 300


def test_ranks_order_counts_not_rows(spark):
    """The values of a sort, null the smallest; the window is behind an aggregate by value."""
    rows = [("a", i * 7919 % 13) for i in range(2000)] + [("b", None)] * 3 + [("b", 5), ("b", 2)]
    n = F.col("n")
    got = stats.ranked(spark.createDataFrame(rows, "c string, v int"), ["c"], "v", {"low": F.floor((n - 1) / 2), "p90": F.floor(n * 0.9), "last": n})
    want = []
    for c in "ab":
        v = sorted((x for k, x in rows if k == c), key=lambda x: -1 if x is None else x)
        want.append((c, v[(len(v) - 1) // 2], v[int(len(v) * 0.9)], v[-1]))
    assert sorted(tuple(r) for r in got.select("c", "low", "p90", "last").collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert max(k for k, x in enumerate(plan) if "Window" in x) < max(k for k, x in enumerate(plan) if "Aggregate" in x)
