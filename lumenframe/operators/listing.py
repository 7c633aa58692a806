"""A folder's contents level by level: each level's entries are ready before the next level is looked at."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Workspace


def walk(entries: DataFrame, root: object, space: Workspace) -> Iterator[DataFrame]:
    """The entries (id, parent, is_dir and further columns) below ``root``, one DataFrame with ``level`` for each level, until a level has no folders.

    Each level is a join of the folders found last with the table; it lies in the workspace when it is handed out. An
    entry is listed once even if folders form a ring.
    """
    frontier, seen, level = entries.sparkSession.createDataFrame([(root,)], f"_at {dict(entries.dtypes)['id']}"), None, 0
    while True:
        found = entries.join(frontier, F.col("parent") == F.col("_at")).drop("_at").withColumn("level", F.lit(level))
        if seen is not None:
            found = found.join(seen, "id", "left_anti")
        found = space.written(found)
        if found.isEmpty():
            return
        yield found
        frontier = found.where("is_dir").select(F.col("id").alias("_at"))
        seen = found.select("id") if seen is None else seen.unionByName(found.select("id"))
        level += 1


def list_all(entries: DataFrame, root: object, modified: str, space: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """The files of each level as they were found, and then all of them, newest first (equal times by id)."""
    levels = [found.where("not is_dir") for found in walk(entries, root, space)]
    whole = None
    for found in levels:
        whole = found if whole is None else whole.unionByName(found)
    if whole is None:
        whole = entries.withColumn("level", F.lit(0)).limit(0)
    return levels, whole.orderBy(F.desc(modified), "id")
