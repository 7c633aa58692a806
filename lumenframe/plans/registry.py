"""Registered queries: a function of the views, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Views, views_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable:
    """``sql``: a SELECT, or further common table expressions beginning with a comma, behind those of the views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        COVERS[name] = covers
        if sql:
            SQL[name] = views_sql() + "\n" + sql
        return f

    return add
