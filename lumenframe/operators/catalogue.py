"""Catalogue operators: facets, storage, eviction, and mutations as new tables (nothing is changed in place)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_MS = 30 * 86_400_000



def _versions() -> dict[int, dict[str, Column]]:
    return {
        2: {"camera_make": F.lit(""), "camera_model": F.lit(""), "lens_model": F.lit(""), "iso": F.lit(0)},
        3: {"keywords": F.lit(""), "deleted_at": F.lit(None).cast("bigint")},
        4: {"stack_key": F.lit("")},
    }


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "id", "left_semi")


def expired(photos: DataFrame, now_ms: int) -> DataFrame:
    return photos.where(F.col("deleted_at") < now_ms - RETENTION_MS)


def keywords_in_scope(photos: DataFrame, project: str | None) -> DataFrame:
    rows = photos.where("keywords <> '' and deleted_at is null")
    return (rows if project is None else rows.where(F.col("project") == project)).select("keywords")


def unedited(photos: DataFrame, edits: DataFrame) -> DataFrame:
    return photos.where("deleted_at is null").join(edits.select(F.col("photo_id").alias("id")), "id", "left_anti")


def victims(photos: DataFrame, thumbnails: DataFrame, fair_share: int) -> DataFrame:
    """Thumbnails to evict first: those of the projects furthest above their share, then the least recently seen."""
    owned = thumbnails.join(photos.select(F.col("id").alias("photo_id"), "project"), "photo_id")
    used = owned.groupBy("project").agg((F.sum("bytes") - fair_share).alias("over_share"))
    return owned.join(used, "project").orderBy(F.desc("over_share"), "last_accessed_at", "photo_id").select("photo_id", "bytes", "over_share")


def facet(photos: DataFrame, column: str, top: int = 12) -> DataFrame:
    return photos.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def with_stack_count(photos: DataFrame) -> DataFrame:
    """Counted by a join, not a window: the many photos without a key would all meet in one task."""
    sizes = photos.where("stack_key <> ''").groupBy("stack_key").agg(F.count("*").alias("_n"))
    return photos.join(sizes, "stack_key", "left").withColumn("stack_count", F.coalesce("_n", F.lit(1))).drop("_n")


def relink(photos: DataFrame) -> DataFrame:
    """Unreachable photos and the reachable ones with the same content."""
    lost = photos.where("not uri_ok").select("id", "fingerprint")
    return lost.join(photos.where("uri_ok").select(F.col("id").alias("candidate"), "fingerprint"), "fingerprint").select("id", "candidate")


def new_rows(incoming: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    return incoming.join(held.select(*key).distinct(), key, "left_anti")


def insert_or_fail(incoming: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """``held`` and ``incoming``; a row whose key exists, or occurs twice, fails the insert. The check runs two jobs when called."""
    if incoming.join(held.select(*key), key, "left_semi").limit(1).count() or incoming.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows with the same {', '.join(key)} exist")
    return held.unionByName(incoming)


def upsert(held: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    return held.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def delete_by_key(held: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return held.join(keys, key, "left_anti")


def delete_project(photos: DataFrame, edits: DataFrame, thumbnails: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    dead = photos.where(F.col("project") == project).select(F.col("id").alias("photo_id"))
    return photos.where(F.col("project") != project), edits.join(dead, "photo_id", "left_anti"), thumbnails.join(dead, "photo_id", "left_anti")


def update_by_ids(rows: DataFrame, ids: DataFrame, values: dict[str, Column]) -> DataFrame:
    marked = rows.join(ids.select("id", F.lit(True).alias("_hit")).dropDuplicates(["id"]), "id", "left")
    return marked.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def backfill(photos: DataFrame, probed: DataFrame) -> DataFrame:
    """Probed metadata by id: the make is replaced, a number only by one above 0, a nullable text only by one that is not null."""
    p = probed.select("id", F.lit(True).alias("_hit"), F.col("camera_make").alias("_make"), F.col("iso").alias("_iso"), F.col("lens_model").alias("_lens"))
    new = {"camera_make": F.when(F.col("_hit"), F.col("_make")).otherwise(F.col("camera_make")), "iso": F.when(F.col("_iso") > 0, F.col("_iso")).otherwise(F.col("iso")), "lens_model": F.coalesce("_lens", "lens_model")}
    return photos.join(p, "id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in photos.columns])


def migrate(rows: DataFrame, version: int) -> DataFrame:
    for v, columns in _versions().items():
        if v > version:
            rows = rows.withColumns({c: d for c, d in columns.items() if c not in rows.columns})
    return rows


def rewrite_with_backup(new: DataFrame, path: str, version: int) -> str:
    """The next version of a table beside the old one, which stays as the backup; returns the new path."""
    to = f"{path.rstrip('/')}/v{version}"
    new.write.mode("errorifexists").parquet(to)
    return to


