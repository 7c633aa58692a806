"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that one task takes, and nodes of which a worker keeps the links before it passes them on.
EDGES_A_TASK, NODES_KEPT = 500_000, 1_000_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one partition as links to the smallest node that they reach; no component changes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        up = parent.setdefault(x, x)
        while up != x:
            parent[x] = parent[up]
            x, up = up, parent[up]
        return x

    def links() -> pd.DataFrame:
        nodes = [x for x in parent if root(x) != x]
        return pd.DataFrame({"u": nodes, "v": [root(x) for x in nodes]}, dtype="int64")

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > NODES_KEPT:
            yield links()
            parent.clear()
    yield links()


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node (a number) that has an edge to another one.

    Each partition first shortens its own edges to stars. Then each round links every node's larger neighbours, and its
    smaller ones, to the smallest it knows; the edge count never grows, and chains shorten to stars in a few rounds. The
    edges go to a scratch table each round, and the one before it goes.
    """
    first = scratch.cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    tasks = first.count() // EDGES_A_TASK + 1  # so that few edges do not travel in many small files
    now = scratch.cut(first.coalesce(tasks).mapInPandas(_stars, "u long, v long").distinct().coalesce(tasks))
    scratch.drop(first)
    seen = _print(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        low = to_low = scratch.cut(low)  # a table of its own, so that the join can split a hub's links
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, now = now, scratch.cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(tasks))
        scratch.drop(last, to_low)
        seen, before = _print(now), seen
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    found = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
