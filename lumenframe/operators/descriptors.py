"""Descriptors of media queries: which columns, which rows, in which order, stated once and applied to any scan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON = ("id", "path", "label", "bucket", "ts")


@dataclass(frozen=True)
class MediaQuery:
    """Columns, patterns of which a row must match one (a LIKE of a column each), and the sort column, newest first."""

    columns: tuple[str, ...] = (*COMMON, "duration_ms", "mime")
    where: tuple[tuple[str, str], ...] = ()
    sort: str | None = None
    album: int | None = None

    @staticmethod
    def photos() -> MediaQuery:
        return MediaQuery(where=(("mime", "image%"),), sort="ts")

    @staticmethod
    def videos() -> MediaQuery:
        return MediaQuery(where=(("mime", "video%"),), sort="ts")

    @staticmethod
    def albums() -> MediaQuery:
        return MediaQuery(columns=("bucket", "label", "path", "id", "mime", "ts"))

    @staticmethod
    def files(*patterns: str) -> MediaQuery:
        return MediaQuery(where=tuple(("path", p) for p in patterns), sort="ts")

    def in_album(self, bucket: int) -> MediaQuery:
        return replace(self, album=bucket)

    def condition(self) -> Column:
        any_ = reduce(Column.__or__, (F.col(c).like(p) for c, p in self.where)) if self.where else F.lit(True)
        return any_ & (F.col("bucket") == self.album) if self.album is not None else any_

    def rows(self, media: DataFrame) -> DataFrame:
        return media.where(self.condition()).select(*self.columns)

    def ordered(self, media: DataFrame) -> DataFrame:
        found = self.rows(media)
        return found.orderBy(F.desc(self.sort), F.desc("id")) if self.sort else found
