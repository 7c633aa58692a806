"""The catalogue grid: filter, search, sort and page over photos with their thumbnails and edits."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 6
SORTS = {
    "captured": lambda: F.coalesce("captured_at", "added_at"),
    "added": lambda: F.col("added_at"),
    "name": lambda: F.lower("display_name"),
    "size": lambda: F.col("size_bytes"),
    "rating": lambda: F.col("rating"),
}
STATES = (0, 1, 2)


@dataclass(frozen=True)
class GridFilter:
    """What the grid shows. ``project`` None: all of them; no or all flag states: no condition."""

    project: str | None = None
    trash: bool = False
    flags: frozenset[int] = field(default_factory=frozenset)
    min_rating: int = 0
    color: int | None = None
    search: str = ""

    @staticmethod
    def unpack(mask: int) -> GridFilter:
        """From the stored bits: three flag states, three bits of rating, four bits of colour label, 15 for any."""
        color = mask >> 6 & 15
        return GridFilter(flags=frozenset(s for s in STATES if mask >> s & 1), min_rating=min(mask >> 3 & 7, 5), color=None if color > 5 else color)

    def pack(self) -> int:
        return sum(1 << s for s in self.flags) | min(max(self.min_rating, 0), 5) << 3 | (15 if self.color is None else min(max(self.color, 0), 5)) << 6

    def condition(self) -> Column:
        parts = [F.col("deleted_at").isNotNull() if self.trash else F.col("deleted_at").isNull()]
        if self.project is not None:
            parts.append(F.col("project") == self.project)
        if 0 < len(self.flags) < len(STATES):
            parts.append(F.col("flag_state").isin(sorted(self.flags)))
        if self.min_rating > 0:
            parts.append(F.col("rating") >= self.min_rating)
        if self.color is not None:
            parts.append(F.col("color_label") == self.color)
        for term in self.search.lower().split()[:MAX_TERMS]:
            parts.append(reduce(Column.__or__, (F.lower(c).contains(term) for c in ("display_name", "camera_model", "lens_model", "keywords"))))
        return reduce(Column.__and__, parts)


def order(sort: str, descending: bool) -> list[Column]:
    """The sort key and id in one direction; null is the smallest."""
    key, tie = SORTS[sort](), F.col("id")
    return [key.desc_nulls_last(), tie.desc()] if descending else [key.asc_nulls_first(), tie.asc()]


def grid(photos: DataFrame, thumbnails: DataFrame, edits: DataFrame, shown: GridFilter, sort: str = "captured", descending: bool = True) -> DataFrame:
    """One joined row per photo; both joins find one row at most."""
    thumbs = thumbnails.select(F.col("photo_id").alias("id"), F.col("path").alias("thumb_path"))
    edited = edits.select(F.col("photo_id").alias("id"), F.when(F.col("is_neutral") == 1, 0).otherwise(1).alias("_edited"))
    rows = photos.where(shown.condition()).join(thumbs, "id", "left").join(edited, "id", "left")
    return rows.withColumn("edited", F.coalesce("_edited", F.lit(0))).drop("_edited").orderBy(*order(sort, descending))


def grid_ids(photos: DataFrame, shown: GridFilter, sort: str = "captured", descending: bool = True) -> DataFrame:
    """Ids in display order; neither join is needed."""
    return photos.where(shown.condition()).orderBy(*order(sort, descending)).select("id")


def grid_count(photos: DataFrame, shown: GridFilter) -> DataFrame:
    return photos.where(shown.condition()).agg(F.count("*").alias("n"))


def page_after(photos: DataFrame, shown: GridFilter, last_key: int | None, last_id: int, size: int) -> DataFrame:
    """The next page by added time, newest first: rows behind the last one seen, so that no offset is counted through."""
    rows = photos.where(shown.condition())
    if last_key is not None:
        rows = rows.where((F.col("added_at") < last_key) | ((F.col("added_at") == last_key) & (F.col("id") < last_id)))
    return rows.orderBy(F.desc("added_at"), F.desc("id")).limit(size)
