"""The media browser: typed unions, albums, searches and dated sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_scans(*scans: DataFrame) -> DataFrame:
    """All scans as one, with the order of scans kept in ``scan``."""
    return reduce(DataFrame.unionByName, (s.withColumn("scan", F.lit(i)) for i, s in enumerate(scans)))


def path_suffix(path: Column, suffixes: list[str]) -> Column:
    return reduce(Column.__or__, (F.lower(path).endswith(x.lower()) for x in suffixes))


def label_search(label: Column, query: str) -> Column:
    """``*x`` ends with x, ``x*`` begins with x, else contains it; case does not matter."""
    low, q = F.lower(label), query.lower()
    if q.startswith("*"):
        return low.endswith(q[1:])
    return low.startswith(q[:-1]) if q.endswith("*") else low.contains(q)


def albums(media: DataFrame) -> DataFrame:
    """Per bucket the count and the newest item; of equally new ones the later in the scan."""
    newest = F.max_by(F.struct("id", "label", "ts"), F.struct("ts", "id"))
    return media.groupBy("bucket").agg(F.count("*").alias("n"), newest.alias("top")).select("bucket", "n", F.col("top.id").alias("id"), F.col("top.label").alias("label"), F.col("top.ts").alias("ts"))


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; aggregated before the shuffle, so a frequent key costs no more than others."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def sections(rows: DataFrame, label: Column) -> DataFrame:
    """Items under dated headers, newest first, in one table: per label a header (is_header) and its members.

    A section's place is that of its newest member. Group lists are not collected: header and members share the label.
    """
    items = rows.select(label.alias("section"), "id", "ts")
    heads = items.groupBy("section").agg(F.max("ts").alias("newest"), F.count("*").alias("size"))
    members = items.join(heads, "section").select("section", "newest", "size", F.lit(0).alias("is_header"), "id", "ts")
    return heads.select("section", "newest", "size", F.lit(1).alias("is_header"), F.lit(None).cast("bigint").alias("id"), F.col("newest").alias("ts")).unionByName(members)


def media_order(sort: str, descending: bool) -> list[Column]:
    key = {"date": F.col("ts"), "label": F.lower("label"), "expiry": F.coalesce("expiry", "ts")}[sort]
    return [key.desc(), F.desc("id")] if descending else [key.asc(), F.asc("id")]


def file_order(sort: str, descending: bool) -> list[Column]:
    """Files by date, name, size, type or extension; what is missing is smallest."""
    key = {"modified": F.col("ts"), "added": F.col("expiry"), "name": F.lower("label"), "size": F.col("size"), "mime": F.col("mime"), "extension": F.lower(F.regexp_extract("label", r"\.([^.]*)$", 1))}[sort]
    return [key.desc_nulls_last(), F.desc("id")] if descending else [key.asc_nulls_first(), F.asc("id")]
