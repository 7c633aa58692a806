"""Queries of the media browser, lookups and folder listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import lookup, media as ops, ordered
from .registry import query
from .scalars import NOW


@query("union_scans", "SRC5 ST1 SRC6", "SELECT id, label, mime, 0 AS scan FROM media WHERE mime LIKE 'image%' UNION ALL SELECT id, label, mime, 1 FROM media WHERE mime LIKE 'video%' UNION ALL SELECT id, label, mime, 2 FROM media WHERE mime LIKE '%/%' AND expiry IS NOT NULL")
def _(v):
    m = v.media
    return ops.union_scans(m.where("mime like 'image%'"), m.where("mime like 'video%'"), m.where("mime like '%/%' and expiry is not null")).select("id", "label", "mime", "scan")


@query("album_items", "PF13 PF14", "SELECT id FROM media WHERE bucket = 3 AND (mime LIKE 'video%' OR path LIKE '%.png')")
def _(v):
    return v.media.where((F.col("bucket") == 3) & (F.col("mime").like("video%") | F.col("path").like("%.png"))).select("id")


@query("path_suffixes", "PF15 PF17 PF18", "SELECT id, CASE WHEN lower(path) LIKE '%.jpg' THEN 'JPEG' ELSE 'other' END AS category FROM media WHERE lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.mp4'")
def _(v):
    return v.media.where(ops.path_suffix(F.col("path"), [".jpg", ".MP4"])).select("id", F.when(s.extension("path") == "jpg", "JPEG").otherwise("other").alias("category"))


@query("label_search", "PF16", "SELECT id, lower(label) LIKE 'o1%' AS prefix, lower(label) LIKE '%png' AS suffix, lower(label) LIKE '%7.%' AS inside FROM media")
def _(v):
    f = lambda q: ops.label_search(F.col("label"), q)
    return v.media.select("id", f("O1*").alias("prefix"), f("*PNG").alias("suffix"), f("7.").alias("inside"))


@query("albums", "AG6", "SELECT bucket, n, id, label, ts FROM (SELECT *, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY ts DESC, id DESC) AS k FROM media) WHERE k = 1")
def _(v):
    return ops.albums(v.media)


@query("sections", "AG7", """
, l AS (SELECT id, ts, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS section FROM media), h AS (SELECT section, max(ts) AS newest, count(*) AS size FROM l GROUP BY section)
SELECT section, newest, size, 1 AS is_header, NULL::BIGINT AS id, newest AS ts FROM h UNION ALL SELECT section, newest, size, 0, id, ts FROM l JOIN h USING (section)""")
def _(v):
    return ops.sections(v.media, F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))


@query("distinct_first", "AG8 ST2", "SELECT label, id, ts FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ts, id) AS k FROM media) WHERE k = 1")
def _(v):
    return ops.first_by(v.media.select("label", "id", "ts"), ["label"], ["ts", "id"])


@query("media_by_expiry", "SO9", "SELECT id, row_number() OVER (PARTITION BY bucket ORDER BY coalesce(expiry, ts) DESC, id DESC) AS pos FROM media")
def _(v):
    return ordered.positions(v.media, ["bucket"], ops.media_order("expiry", True)).select("id", "pos")


@query("file_sort", "SO10", "SELECT id, row_number() OVER (PARTITION BY bucket ORDER BY expiry ASC NULLS FIRST, id) AS added, row_number() OVER (PARTITION BY bucket ORDER BY size DESC NULLS LAST, id DESC) AS largest, row_number() OVER (PARTITION BY bucket ORDER BY lower(label), id) AS name FROM media")
def _(v):
    rows = v.media
    for name, order in (("added", ops.file_order("added", False)), ("largest", ops.file_order("size", True)), ("name", ops.file_order("name", False))):
        rows = ordered.positions(rows, ["bucket"], order, name)
    return rows.select("id", "added", "largest", "name")


@query("folder_listing", "SRC10 SO11", "SELECT p_partkey, p_name, p_size > 40 AS is_dir FROM part WHERE NOT (p_size > 40 AND lower(p_name) = 'ml/data') AND p_name NOT LIKE '%.ml6d' ORDER BY is_dir DESC, lower(p_name), p_partkey")
def _(v):
    from ..sources.files import list_folder

    return list_folder(v.table("part").select("p_partkey", "p_name", (F.col("p_size") > 40).alias("is_dir")), "p_name", "is_dir", ["p_partkey"])


@query("recent_count_sort", "SO12 KN14", "SELECT fmt, n, latest FROM (SELECT format AS fmt, count(*) AS n, max(added_at) AS latest FROM photos GROUP BY format) ORDER BY n DESC, latest DESC")
def _(v):
    return v.photos.groupBy(F.col("format").alias("fmt")).agg(F.count("*").alias("n"), F.max("added_at").alias("latest")).orderBy(F.desc("n"), F.desc("latest"))


@query("priority_brands", "SO14 KN15", "SELECT brand FROM (SELECT DISTINCT p_brand AS brand FROM part) ORDER BY CASE brand WHEN 'Brand#23' THEN 1 WHEN 'Brand#12' THEN 2 ELSE 9 END, brand")
def _(v):
    return lookup.priority_order(v.table("part").select(F.col("p_brand").alias("brand")).distinct(), "brand", ["Brand#23", "Brand#12"])


@query("lookup_default", "J5 J6 O13", """
, t(k, c) AS (VALUES (0, -9), (1, 10), (3, 30), (4, 0))
SELECT id, coalesce(t.c, d.c, 7)::INTEGER AS with_default, CASE WHEN id % 6 = 0 OR t.c = 0 THEN NULL ELSE t.c END::INTEGER AS or_null FROM photos LEFT JOIN t ON t.k = id % 6 LEFT JOIN t d ON d.k = 0""")
def _(v):
    rows = v.photos.select("id", (F.col("id") % 6).cast("int").alias("k"))
    table = v.spark.createDataFrame([(0, -9), (1, 10), (3, 30), (4, 0)], "k int, c int")
    out = lookup.with_default(rows, table, "k", "c", 0, 7)
    return out.select("id", F.col("c_or_default").alias("with_default"), F.when((F.col("k") != 0) & (F.col("c") != 0), F.col("c")).alias("or_null"))


@query("substring_rules", "J7 J8", """
, r(pos, needle, factor) AS (VALUES (0, 'burnished', 1.6), (1, 'promo', 1.5), (2, 'steel', 2.0))
SELECT p_partkey, factor::DOUBLE AS factor FROM (SELECT p_partkey, factor, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS k FROM part JOIN r ON contains(lower(p_type), needle) OR contains(needle, lower(p_type))) WHERE k = 1""")
def _(v):
    rules = v.spark.createDataFrame([(0, "burnished", 1.6), (1, "promo", 1.5), (2, "steel", 2.0)], "pos int, needle string, factor double")
    return lookup.first_containment(v.table("part").select("p_partkey", F.lower("p_type").alias("t")), rules, "p_partkey", "t").select("p_partkey", "factor")


@query("crop_factors", "J8", "SELECT id, CASE WHEN camera_make = 'Canon' AND camera_model LIKE '%7%' THEN 1.6 WHEN camera_make = 'Nikon' OR camera_model LIKE '%3%' THEN 1.5 ELSE 1.0 END::DOUBLE AS crop FROM photos")
def _(v):
    c = lambda x, y: F.col(x).contains(y)
    return v.photos.select("id", F.when(c("camera_make", "Canon") & c("camera_model", "7"), 1.6).when(c("camera_make", "Nikon") | c("camera_model", "3"), 1.5).otherwise(1.0).alias("crop"))


@query("autocomplete", "J11", "SELECT p_name, NOT starts_with(lower(p_name), 'a') AS late FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e') ORDER BY late, p_name LIMIT 25")
def _(v):
    return lookup.autocomplete(v.table("part").select("p_name").distinct(), "p_name", ["a", "e"], 25)


@query("relative_sections", "AG7 SF12", f"SELECT CASE WHEN ({NOW} - ts) // 86400 <= 1 THEN 'recent' ELSE 'older' END AS section, count(*) AS n FROM media GROUP BY 1")
def _(v):
    label = s.relative_day(F.col("ts"), NOW)
    return v.media.groupBy(F.when(label.isin("Today", "Yesterday"), "recent").otherwise("older").alias("section")).agg(F.count("*").alias("n"))
