"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each query ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables in the shared folder that an operator needs only while it runs; they go one by one, or all with the block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        with shuffles_deleted(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(self.paths[id(t)][0])

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.top)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that a lost executor costs nothing that lies before it.

    For what a returned DataFrame reads: Spark deletes the files when nothing refers to them any more, where the cluster
    sets spark.cleaner.referenceTracking.cleanCheckpoints. The rows pass a scratch table first, as only a write deletes
    its shuffle files.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with Scratch(df.sparkSession) as scratch:
        return scratch.cut(df).checkpoint()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)
