"""Queries that follow their tables: a change re-runs the query and the newest whole result replaces the old one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Workspace


def follow(stream: DataFrame, run: Callable[[Any], DataFrame], snapshot: Callable[[], Any], out: str, every: str | None = None):
    """Start a stream that, at each trigger with changes, runs ``run`` over the whole of ``snapshot()`` and writes the result as version ``batch_id``.

    Changes between triggers are conflated into one run; with ``every`` None, what is there is handled and the stream ends.
    """

    def on_change(_: DataFrame, batch_id: int) -> None:
        run(snapshot()).write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    writer = stream.writeStream.foreachBatch(on_change).option("checkpointLocation", f"{out}-state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def requery(spark: SparkSession, sf_dir: str, table: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The latest version that following ``table`` has produced."""
    return requery_all(spark, sf_dir, [table], lambda tables: run(tables[table]))


def requery_all(spark: SparkSession, sf_dir: str, tables: list[str], run: Callable[[dict[str, DataFrame]], DataFrame]) -> DataFrame:
    """The latest version that following all the ``tables`` has produced: a change of any of them runs the query once more."""
    path = lambda t: f"{sf_dir}/{t}.parquet"
    streams = [spark.readStream.schema(spark.read.parquet(path(t)).schema).parquet(path(t)[:-1] + "[t]").select(F.lit(t).alias("table")) for t in tables]
    stream = reduce(DataFrame.unionByName, streams)
    with Workspace(spark) as space:
        out = space.path()
        follow(stream, run, lambda: {t: spark.read.parquet(path(t)) for t in tables}, out).awaitTermination()
        versions = spark.read.parquet(out)
        latest = versions.agg(F.max("version").alias("version"))
        return space.kept(versions.join(F.broadcast(latest), "version", "left_semi").drop("version"))


def throttle_latest(events: DataFrame, key: str, ts: str, seconds: int, columns: list[str]) -> DataFrame:
    """Per key and slot of ``seconds``, the last event: what a throttle that forwards the newest lets through."""
    t = F.unix_seconds(F.col(ts).cast("timestamp")) if dict(events.dtypes)[ts] != "bigint" else F.col(ts)
    rows = events.withColumn("slot", F.floor(t / seconds))
    last = F.max_by(F.struct(*columns), F.struct(ts, columns[0]))
    return rows.groupBy(key, "slot").agg(last.alias("_r")).select(key, "slot", "_r.*")


def debounce(events: DataFrame, key: str, ts: str, gap: str, columns: list[str]) -> DataFrame:
    """Per key and burst of events with pauses under ``gap``, the last event; runs on streams with a watermark as well."""
    last = F.max_by(F.struct(*columns), F.struct(ts, columns[0]))
    return events.groupBy(key, F.session_window(ts, gap).alias("burst")).agg(last.alias("_r")).select(key, "burst", "_r.*")
