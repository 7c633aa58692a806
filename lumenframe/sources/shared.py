"""The folder that driver and executors share, and tables that are needed only for a while."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: on one machine a temporary folder, on a cluster the warehouse, which must not be local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            return tempfile.mkdtemp(prefix="spark-")
        found = spark.conf.get("spark.sql.warehouse.dir")
        if re.match(r"(file:|/)", found):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all cores by a key: a file of one row group is read by one task, too few where a row costs much work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the shared folder, in the partitions and the order that they have; Spark deletes them when nothing refers to them (where it is told to clean checkpoints)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Workspace:
    """A folder in the shared one that goes, with all in it, when the block ends; what is to outlive it is ``kept``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.count, self.paths = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", 0, {}

    def path(self) -> str:
        self.count += 1
        return f"{self.top}/{self.count}"

    def written(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that were ``written`` before the block ends."""
        for t in tables:
            self._delete(self.paths.pop(id(t))[0])

    def kept(self, df: DataFrame) -> DataFrame:
        return checkpointed(df)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.top)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
