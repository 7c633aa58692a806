"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Workspace


def _told(edges: DataFrame) -> tuple:
    """What tells a set of edges from the one of the round before."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def min_labels(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label): the smallest node of each component; an error if they do not settle in ``rounds``.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest that it knows, so paths halve and
    the edges never grow in number. A round's edges are a table in a folder, and the one before goes: a checkpoint would
    hand on the estimated size of what it was made of, a product that has more digits each round until it fills the driver.
    """
    with Workspace(nodes.sparkSession) as space:
        now = space.written(edges.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).where("u <> v").distinct())
        told = _told(now)
        for _ in range(rounds):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = space.written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            last, now = now, space.written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
            space.drop(last, large)
            told, before = _told(now), told
            if told == before:
                break
        else:
            raise RuntimeError("labels did not settle")
        found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
        return space.kept(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("least", "node").alias("label")))
