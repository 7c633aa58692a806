"""Lookups in small tables: with defaults, by containment, by priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables up to so many rows are broadcast; larger ones are joined as Spark sees fit.
SMALL_ROWS = 10_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else table


def with_default(rows: DataFrame, table: DataFrame, key: str, value: str, default_key: int, constant: int) -> DataFrame:
    """``value`` of the row's key (null on a miss), and ``<value>_or_default``: else that of the default key, else the constant."""
    default = table.where(F.col(key) == default_key).agg(F.first(value).alias("_d"))  # one row
    return rows.join(_small(table), key, "left").crossJoin(F.broadcast(default)).withColumn(f"{value}_or_default", F.coalesce(value, "_d", F.lit(constant))).drop("_d")


def first_containment(rows: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """The first rule, by ``pos``, whose needle contains the text or is contained in it. The rules must be few: they are tried on each row."""
    names = [c for c in rules.columns if c not in ("pos", "needle")]
    fits = F.col(text).contains(F.col("needle")) | F.col("needle").contains(F.col(text))
    met = rows.join(_small(rules), fits)
    return met.groupBy(key).agg(F.min_by(F.struct(*names), "pos").alias("_r")).select(key, "_r.*")


def priority_order(rows: DataFrame, column: str, first: list[str]) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(column))
    return rows.orderBy(F.when(at > 0, at).otherwise(len(first) + 1), column)


def autocomplete(names: DataFrame, column: str, needles: list[str], most: int) -> DataFrame:
    """Names that contain all needles, those that begin with the first one before the others."""
    low = F.lower(column)
    hit: Column = reduce(Column.__and__, (low.contains(n) for n in needles))
    return names.where(hit).withColumn("late", ~low.startswith(needles[0])).orderBy("late", column).limit(most)
