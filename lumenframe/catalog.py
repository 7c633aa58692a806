"""The photo catalogue as views over the supplied tables, each defined once in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: name: (table, filter, columns). Times are epoch milliseconds, as in the catalogue; media times are seconds.
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "photos": (
        "documents",
        "true",
        {
            "id": "doc_id",
            "project": "source",
            "size_bytes": "n_chars",
            "format": "lang",
            "display_name": "concat('DOC_', lpad(cast(doc_id as string), 6, '0'), case when doc_id % 13 = 0 then '' else concat('.', lang) end)",
            "rating": "cast(n_chars % 6 as int)",
            "flag_state": "cast(doc_id % 3 as int)",
            "color_label": "cast(doc_id % 5 as int)",
            "captured_at": "case when doc_id % 7 = 0 then null else 1700000000000 + (doc_id * 7919 % 1000) * 60000 end",
            "added_at": "1700000000000 + doc_id * 1000",
            "deleted_at": "case when doc_id % 11 = 0 then 1700000000000 + doc_id * 3600000 end",
            "camera_make": "case doc_id % 4 when 0 then '' when 1 then 'Canon' when 2 then 'Nikon' else 'Sony' end",
            "camera_model": "case when doc_id % 4 = 0 then '' else concat('Body ', cast(doc_id % 9 as string)) end",
            "lens_model": "case when doc_id % 5 = 0 then '' else concat('Lens ', cast(doc_id % 17 as string), 'mm') end",
            "iso": "cast(case doc_id % 6 when 0 then 0 when 1 then 100 when 2 then 250 when 3 then 800 when 4 then 3200 else 12800 end as int)",
            "keywords": "case when doc_id % 8 = 0 then '' else concat('|', lang, '|k', cast(doc_id % 8 as string), '|') end",
            "stack_key": "case when doc_id % 3 = 2 then '' else concat('stack', cast(cast(floor(doc_id / 4) as bigint) as string)) end",
            "uri_ok": "doc_id % 10 <> 0",
            "source_uri": "concat('content://photos/', cast(doc_id - doc_id % 2 as string))",
            "fingerprint": "case when doc_id % 9 = 0 then null else concat(cast(n_chars as string), ':', lang) end",
            "mime": "case doc_id % 4 when 0 then 'image/jpeg' when 1 then 'image/x-raw' when 2 then 'video/mp4' else 'application/pdf' end",
            "width": "cast(100 + doc_id % 4000 as int)",
            "height": "cast(100 + doc_id * 3 % 3000 as int)",
        },
    ),
    "edits": ("labels", "true", {"photo_id": "doc_id", "is_neutral": "cast(case when quality = 0 then 1 else 0 end as int)", "revisions": "cast(doc_id % 50 as int)", "updated_at": "1700000000000 + doc_id"}),
    "thumbnails": ("documents", "doc_id % 4 <> 0", {"photo_id": "doc_id", "path": "concat('/t/', cast(doc_id as string))", "bytes": "n_chars * 2", "last_accessed_at": "doc_id * 7919 % 100003"}),
    "media": (
        "orders",
        "true",
        {
            "id": "o_orderkey",
            "bucket": "o_custkey % 20",
            "label": "concat(o_orderstatus, cast(o_orderkey % 97 as string), '.', case o_orderkey % 3 when 0 then 'JPG' when 1 then 'png' else 'mp4' end)",
            "mime": "case o_orderkey % 3 when 2 then 'video/mp4' else 'image/jpeg' end",
            "path": "concat('/sd/', o_orderpriority, '/', cast(o_orderkey as string), case o_orderkey % 3 when 0 then '.JPG' when 1 then '.png' else '.mp4' end)",
            "ts": "cast(1700000000 - (o_orderkey * 7919 % 2000) * 3600 as bigint)",
            "expiry": "case when o_orderkey % 5 = 0 then cast(1700000000 + o_orderkey % 1000 as bigint) end",
            "duration_ms": "case when o_orderkey % 3 = 2 then o_orderkey * 37 % 600000 end",
            "size": "cast(floor(o_totalprice) as bigint)",
        },
    ),
    "pix": (
        "documents",
        "true",
        {"x": "cast(doc_id % 32 as int)", "y": "cast(floor(doc_id / 32) as int)", "r": "cast(n_chars % 256 as int)", "g": "cast(n_chars * 7 % 256 as int)", "b": "cast(n_chars * 13 % 256 as int)"},
    ),
    "levels": ("lineitem", "true", {"channel": "l_returnflag", "bin": "cast(floor(l_extendedprice / 420) % 256 as int)", "plane": "cast(l_linenumber % 4 as int)", "seq": "l_orderkey * 8 + l_linenumber", "v": "cast(l_quantity as double)"}),
}


def views_sql() -> str:
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {t} WHERE {w})" for n, (t, w, cols) in VIEWS.items())


class Views:
    """The supplied tables and the catalogue's views over them, as DataFrames read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        t, w, cols = VIEWS[name]
        return self.table(t).where(w).selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])

    photos = cached_property(lambda self: self.view("photos"))
    edits = cached_property(lambda self: self.view("edits"))
    thumbnails = cached_property(lambda self: self.view("thumbnails"))
    media = cached_property(lambda self: self.view("media"))
    pix = cached_property(lambda self: self.view("pix"))
    levels = cached_property(lambda self: self.view("levels"))
