"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as s
from .registry import query

NOW = 1_700_000_000


@query("stack_keys", "SF5 SF17", r"SELECT id, left(lower(CASE WHEN regexp_matches(display_name, '^.+\.[^.]*$') THEN regexp_extract(display_name, '^(.+)\.[^.]*$', 1) ELSE display_name END), 120) AS stack_key, lower(regexp_extract(display_name, '\.([^./]*)$', 1)) AS ext, split_part(source_uri, '/', -1) AS base FROM photos")
def _(v):
    return v.photos.select("id", s.stack_key("display_name").alias("stack_key"), s.extension("display_name").alias("ext"), s.basename("source_uri").alias("base"))


@query("human_size", "SF7", "SELECT l_orderkey * 8 + l_linenumber AS k, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 999950 THEN printf('%.1f kB', floor(b / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor((b // 1024) / 1024.0 * 10 + 0.5) / 10) END AS size FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS b FROM lineitem)")
def _(v):
    b = F.floor(F.col("l_extendedprice") * F.col("l_quantity"))
    return v.table("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), s.human_size(b).alias("size"))


@query("trim_zeros", "SF8", r"SELECT p_partkey, CASE WHEN t LIKE '%.%' THEN regexp_replace(regexp_replace(t, '0*$', ''), '\.$', '') ELSE t END AS trimmed FROM (SELECT p_partkey, printf('%.2f', floor(p_retailprice * 2) / 2) AS t FROM part)")
def _(v):
    t = F.format_string("%.2f", F.floor(F.col("p_retailprice") * 2) / 2)
    return v.table("part").select("p_partkey", s.trim_zeros(t).alias("trimmed"))


@query("rounding", "SF9 SF31", "SELECT p_partkey, floor(p_retailprice * 10 + 0.5) / 10.0 AS tenth, CAST(CASE WHEN floor(p_retailprice + 0.5) % 2 <> 0 THEN floor(p_retailprice + 0.5) ELSE floor(p_retailprice + 0.5) + 1 END AS BIGINT) AS odd, CAST(least(greatest(trunc(5500.0 / CASE WHEN p_size > 1 THEN p_retailprice / p_size ELSE 1.3 END), 2000), 10000) AS INTEGER) AS kelvin FROM part")
def _(v):
    x = F.col("p_retailprice")
    return v.table("part").select("p_partkey", s.round_to(x, 1).alias("tenth"), s.nearest_odd(x).alias("odd"), s.kelvin_estimate(x, F.col("p_size").cast("double")).alias("kelvin"))


@query("base64_text", "SF10", r"SELECT id, regexp_matches(b, '^(?:.{4})*$') AND regexp_matches(b, '^[A-Za-z0-9+/]*={0,2}$') AND length(b) > 0 AS ok, b AS stripped FROM (SELECT id, base64(encode(display_name)) || CASE WHEN id % 3 = 0 THEN '=' ELSE '' END AS b FROM photos)")
def _(v):
    b = F.concat(F.base64(F.encode("display_name", "utf-8")), F.when(F.col("id") % 3 == 0, "=").otherwise(""))
    return v.photos.select("id", s.is_base64(b).alias("ok"), s.strip_base64(F.concat(F.lit("data:x; ,\n"), b)).alias("stripped"))


@query("timestamps", "SF11 SF14", "SELECT id, strftime(make_timestamp(added_at * 1000), '%Y-%m-%d_%H-%M-%S') AS stamp, month(make_timestamp(added_at * 1000))::INTEGER AS m, day(make_timestamp(added_at * 1000))::INTEGER AS d, year(make_timestamp(added_at * 1000))::INTEGER AS y FROM photos")
def _(v):
    t = F.timestamp_millis("added_at")
    return v.photos.select("id", F.date_format(t, "yyyy-MM-dd_HH-mm-ss").alias("stamp"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), F.year(t).alias("y"))


@query("relative_dates", "SF12 SF13", f"""
, d AS (SELECT id, ts, make_timestamp(ts * 1000000) AS t, make_timestamp({NOW} * 1000000::BIGINT) AS n, ({NOW} - ts) // 86400 AS days FROM media)
SELECT id, CASE WHEN days = 0 THEN CASE WHEN day(n) = day(t) THEN 'Today' ELSE 'Yesterday' END WHEN days = 1 THEN 'Yesterday' WHEN days BETWEEN 2 AND 5 THEN strftime(t, '%A') WHEN year(n) > year(t) THEN strftime(t, '%A, %B %-d, %Y') ELSE strftime(t, '%A, %B %-d') END AS label,
       CASE WHEN year(n) <> year(t) THEN strftime(t, '%B %Y') ELSE strftime(t, '%B') END AS month FROM d""")
def _(v):
    return v.media.select("id", s.relative_day(F.col("ts"), NOW).alias("label"), s.month_label(F.col("ts"), NOW).alias("month"))


@query("date_ranges", "SF15 AG9", """
, d AS (SELECT bucket, make_timestamp(min(ts) * 1000000) AS a, make_timestamp(max(ts) * 1000000) AS b FROM media GROUP BY bucket)
SELECT bucket, CASE WHEN year(a) = year(b) THEN CASE WHEN month(a) = month(b) AND day(a) = day(b) THEN strftime(a, '%B %-d, %Y') WHEN month(a) = month(b) THEN strftime(a, '%B %-d') || ' - ' || strftime(b, '%-d, %Y') ELSE strftime(a, '%B %-d') || ' - ' || strftime(b, '%B %-d') || ', ' || strftime(a, '%Y') END ELSE strftime(a, '%B %-d, %Y') || ' - ' || strftime(b, '%B %-d, %Y') END AS header FROM d""")
def _(v):
    return v.media.groupBy("bucket").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("bucket", s.range_header(F.col("a"), F.col("b")).alias("header"))


@query("durations", "SF16", "SELECT id, printf('%02d:%02d', duration_ms // 60000, duration_ms // 1000 % 60) AS length FROM media WHERE duration_ms IS NOT NULL")
def _(v):
    return v.media.where("duration_ms is not null").select("id", s.min_sec(F.col("duration_ms")).alias("length"))


@query("url_codec", "SF18", "SELECT id, replace(url_encode(path), '%20', '+') AS once, path AS back FROM media")
def _(v):
    e = F.url_encode("path")
    return v.media.select("id", e.alias("once"), F.url_decode(F.url_decode(F.url_encode(e))).alias("back"))


@query("file_names", "SF19", "SELECT id, 'IMG_' || display_name || '(' || width || ')x(' || height || ')_' || upper(format) || '.jpg' AS name FROM photos")
def _(v):
    name = s.expand_name(r"\p_\o(\w)x(\h)_\S.\e", {"p": F.lit("IMG"), "o": F.col("display_name"), "w": F.col("width"), "h": F.col("height"), "s": F.col("format"), "e": F.lit("jpg")})
    return v.photos.select("id", name.alias("name"))


@query("digests", "SF20 SF6", """
, t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(t) AS md5, sha1(t) AS sha1, sha256(t) AS sha256, strlen(t) || ':' || sha256(encode(t)[1:65536]) || ':' || sha256(encode(t)[-65536:]) AS fp FROM t""")
def _(v):
    t = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return v.table("documents").select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), s.fingerprint(F.octet_length(t), t).alias("fp"))


@query("exposure_rules", "SF21 SF22 SF23 SF24 SF25 SF26", """
, x AS (SELECT id, iso, width + 1500 AS kelvin, height % 256 AS light, (width % 280) / 10.0 AS f, 1.0 + (id % 3) * 0.3 AS crop, (width % 300) / 10.0 AS shutter FROM photos)
, a AS (SELECT *, CASE WHEN iso <= 0 THEN 56 ELSE CAST(least(greatest(72 + floor(8.0 * (log2(iso) - log2(100.0)) + 0.5), 56), 136) AS INTEGER) END AS apex FROM x)
SELECT id, apex, CAST(floor(100.0 * pow(2.0, (apex - 72.0) / 8.0) + 0.5) AS INTEGER) AS back,
  CASE WHEN iso <= 200 THEN 0.0 WHEN iso <= 400 THEN 5.0 WHEN iso <= 800 THEN 12.0 WHEN iso <= 1600 THEN 22.0 WHEN iso <= 3200 THEN 35.0 WHEN iso <= 6400 THEN 50.0 ELSE 65.0 END::DOUBLE AS nr,
  CASE WHEN kelvin < 3500 THEN 0.08 WHEN kelvin < 4500 THEN 0.04 WHEN kelvin <= 6000 THEN 0 WHEN kelvin <= 7500 THEN -0.02 ELSE -0.04 END::DOUBLE AS wb,
  CASE WHEN light > 200 THEN -0.5 WHEN light < 30 THEN 0.3 ELSE 0 END::DOUBLE AS ettr,
  round(CASE WHEN f <= 0 OR f <= 11.0 / crop THEN 0 ELSE least(30, (f - 11.0 / crop) * 6) END::DOUBLE, 6) AS diffraction,
  round(CASE WHEN shutter <= 1 THEN 10 ELSE least(greatest(10 + least(20, greatest(6 * log2(shutter), 0)), 0), 100) END::DOUBLE, 6) AS thermal FROM a""")
def _(v):
    x = v.photos.select("id", "iso", (F.col("width") + 1500).alias("kelvin"), (F.col("height") % 256).alias("light"), ((F.col("width") % 280) / 10.0).alias("f"), (1.0 + (F.col("id") % 3) * 0.3).alias("crop"), ((F.col("width") % 300) / 10.0).alias("shutter"))
    x = x.withColumn("apex", s.iso_to_apex(F.col("iso")))
    return x.select(
        "id", "apex", s.apex_to_iso(F.col("apex")).alias("back"), s.noise_luma(F.col("iso")).alias("nr"), s.white_balance(F.col("kelvin")).alias("wb"), s.ettr_bias(F.col("light")).alias("ettr"),
        F.round(s.diffraction(F.col("f"), F.col("crop")), 6).alias("diffraction"), F.round(s.thermal(F.col("shutter"), F.lit(10.0), 6.0, 20.0), 6).alias("thermal"),
    )


@query("focus_flash_style", "SF27 SF28 SF29", """
, x AS (SELECT id, (id % 50) / 10.0 AS near, 1.4 + (id % 9) AS f, 20.0 + id % 180 AS focal, id % 3 = 0 AS fired, id % 12 AS light, width + 1500 AS kelvin, camera_make, id % 11 AS tag FROM photos)
SELECT id, round(CASE WHEN near <= 0 THEN 0 ELSE least(greatest(1 - near * 1000.0 / (focal * focal / (f * 0.03) + focal), 0), 1) END::DOUBLE, 6) AS ratio,
  CASE WHEN NOT fired THEN 0 WHEN light = 3 THEN -8 WHEN light = 2 THEN -2 WHEN light IN (1, 9, 10) THEN 0 WHEN kelvin < 3500 THEN -8 WHEN kelvin <= 4500 THEN -2 WHEN kelvin > 6500 THEN 3 ELSE 0 END::DOUBLE AS wb,
  CASE WHEN camera_make = 'Canon' AND tag IN (4, 5) THEN 0.5 ELSE 1.0 END::DOUBLE AS style_scale FROM x""")
def _(v):
    i = F.col("id")
    ratio = s.focus_ratio((i % 50) / 10.0, 1.4 + (i % 9), 20.0 + i % 180)
    wb = s.flash_wb(i % 3 == 0, i % 12, F.col("width") + 1500)
    styled = F.when(F.lower("camera_make").contains("canon") & (i % 11).isin(4, 5), 0.5).otherwise(1.0)
    return v.photos.select("id", F.round(ratio, 6).alias("ratio"), wb.alias("wb"), styled.alias("style_scale"))


@query("scenes", "SF30 SF32 AG15", """
, m AS (SELECT y, avg(0.299 * r + 0.587 * g + 0.114 * b) AS luma, avg(greatest(r, g, b) - least(r, g, b)) AS chroma, CAST(least(greatest(trunc(5500.0 / CASE WHEN sum(b) > 1 THEN sum(r) / sum(b) ELSE 1.3 END), 2000), 10000) AS INTEGER) AS kelvin FROM pix GROUP BY y),
q AS (SELECT y, max(CASE WHEN k = floor(n * 0.9) + 1 THEN l END) - max(CASE WHEN k = floor(n * 0.1) + 1 THEN l END) AS span FROM (SELECT y, 0.299 * r + 0.587 * g + 0.114 * b AS l, row_number() OVER (PARTITION BY y ORDER BY 0.299 * r + 0.587 * g + 0.114 * b) AS k, count(*) OVER (PARTITION BY y) AS n FROM pix) GROUP BY y)
SELECT y, round(luma::DOUBLE, 9) AS luma, round(chroma::DOUBLE, 6) AS chroma, kelvin, round(span::DOUBLE, 6) AS span, CASE WHEN luma < 70 AND span > 50 THEN 'Night Scene' WHEN luma < 70 THEN 'Underexposed' WHEN kelvin > 5800 AND luma > 100 THEN 'Golden Hour' WHEN kelvin < 4500 AND luma BETWEEN 60 AND 140 THEN 'Indoor Tungsten' WHEN chroma < 25 AND luma > 80 THEN 'Flat/Desaturated' WHEN span > 160 THEN 'High Contrast' ELSE 'Neutral' END AS scene FROM m JOIN q USING (y)""")
def _(v):
    from ..operators.stats import image_metrics

    m = image_metrics(v.pix, ["y"])
    return m.select("y", F.round("luma", 9).alias("luma"), F.round("chroma", 6).alias("chroma"), "kelvin", F.round("span", 6).alias("span"), s.scene(F.col("luma"), F.col("chroma"), F.col("kelvin"), F.col("span")).alias("scene"))


@query("lens_query", "SF33 SF34", "SELECT id, [(id % 200) || '.5mm', '1.8', 'canon'] AS needles, CASE WHEN camera_make = '' THEN 'Canon EF ' || id ELSE CASE WHEN camera_make = 'Canon' THEN 'EF ' || id ELSE 'Canon EF ' || id END END AS lens FROM photos")
def _(v):
    text = F.concat(F.lit("  Canon the "), (F.col("id") % 200).cast("string"), F.lit(".5 mm f/1.8 lens a"))
    return v.photos.select("id", s.lens_needles(text).alias("needles"), s.strip_brand(F.concat(F.lit("Canon EF "), F.col("id").cast("string")), F.concat("camera_make", F.lit(" Body"))).alias("lens"))


@query("mirror_index", "SF37 SF38 SF35", "SELECT id, CASE WHEN ((id - 500) % 18 + 18) % 18 < 10 THEN ((id - 500) % 18 + 18) % 18 ELSE 18 - ((id - 500) % 18 + 18) % 18 END AS at, CAST(trunc(width * 0.3) AS INTEGER) AS w30, round(1 / (1 + exp(-(rating - 2.0))), 9) AS tone FROM photos")
def _(v):
    return v.photos.select("id", s.mirror(F.col("id") - 500, 10).alias("at"), s.percent_size(F.col("width"), 30).alias("w30"), F.round(s.sigmoid(F.col("rating") - 2.0), 9).alias("tone"))


@query("volume_paths", "PF22", "SELECT id, regexp_full_match('/storage/' || lower(hex(id * 7919 % 65536 + 65536)[-4:]) || '-' || CASE WHEN id % 4 = 0 THEN 'zz' ELSE '12ab' END, '.*[0-9a-f]{4}-[0-9a-f]{4}') AS volume FROM photos")
def _(v):
    path = F.concat(F.lit("/storage/"), F.lower(F.right(F.hex(F.col("id") * 7919 % 65536 + 65536), F.lit(4))), F.lit("-"), F.when(F.col("id") % 4 == 0, "zz").otherwise("12ab"))
    return v.photos.select("id", path.rlike("^.*[0-9a-f]{4}-[0-9a-f]{4}$").alias("volume"))


@query("rationals", "SRC15", "SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE id / (id % 5)::DOUBLE END AS exposure FROM photos")
def _(v):
    return v.photos.select("id", s.rational(F.concat(F.col("id").cast("string"), F.lit("/"), (F.col("id") % 5).cast("string"))).alias("exposure"))
