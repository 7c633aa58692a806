"""Rows of a query beside those of its SQL in DuckDB, in any order; numbers to nine digits."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def spark_rows(df) -> list:
    cols = sorted(df.columns)
    return sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list]:
    r = con.sql(sql)
    cols = r.columns
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())
