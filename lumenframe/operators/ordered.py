"""Positions in a global order, and in the order of each group, without a window over a whole group.

Rows are range-partitioned by group and order and sorted there. A task counts each group's rows in its range; a group that
goes on from one range to the next gets the rows of the ranges before as an offset. There is at most one such group in a
range, so the offsets are fewer than the ranges and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpointed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the row's number in its group's run, from 1, and the range. The group is in the first column, never null."""
    range_, last, done = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = last is None or keys[0] != last
        at = np.arange(len(keys))
        start = np.maximum.accumulate(np.where(new, at, -1))
        k = np.where(start < 0, done + at, at - start) + 1  # start < 0: the run of the batch before goes on
        last, done = keys[-1], int(k[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int64()), pa.array(np.full(len(k), range_), pa.int32())], [*b.schema.names, "_k", "_range"])


def in_ranges(rows: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """``rows`` in ranges of one global order, with _group, _k (its number in the group's run there) and _range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}).alias("_group") if groups else F.lit("").alias("_group"), *rows.columns)
    by = [F.col("_group"), *order]
    ranges = named.repartitionByRange(n, *by).sortWithinPartitions(*by)  # a stated number, so that no range is merged afterwards
    schema = T.StructType([*ranges.schema.fields, T.StructField("_k", T.LongType()), T.StructField("_range", T.IntegerType())])
    return checkpointed(ranges.mapInArrow(_counted, schema))  # Spark samples for the bounds of ranges, so a second evaluation may have others


def positions(rows: DataFrame, groups: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """``rows`` with the position, from 1, of each row in its group. ``order`` must tell all rows of a group apart."""
    placed = in_ranges(rows, groups, order)
    runs = placed.groupBy("_group", "_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range that the group reaches
    later = runs.withColumn("_before", before).where("_before > 0").select("_group", "_range", "_before")
    out = placed.join(F.broadcast(later), ["_group", "_range"], "left")  # one group at most goes on into a range
    return out.withColumn(name, F.col("_k") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def beside(rows: DataFrame, groups: list[str], order: list[Column], value: str) -> DataFrame:
    """``rows`` with ``before`` and ``after``: ``value`` in the row before and in the row after it in its group, null at its ends.

    Neighbours come from a window over stretches of a group (a range and a block of its rows); where two stretches meet,
    each passes its outermost value on.
    """
    block = 4096
    placed = positions(rows, groups, order, "_pos")
    keyed = placed.withColumn("_group", F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")).withColumn("_block", F.floor((F.col("_pos") - 1) / block))
    # The last row of a block also visits the next one, the first row the one before.
    last, first = (F.col("_pos") % block) == 0, (F.col("_pos") % block) == 1
    to = F.array_compact(F.array(F.col("_block"), F.when(last, F.col("_block") + 1), F.when(first & (F.col("_block") > 0), F.col("_block") - 1)))
    seen = keyed.select("*", F.explode(to).alias("_in"))
    w = Window.partitionBy("_group", "_in").orderBy("_pos")
    found = seen.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))
    return found.where("_in = _block").select(*rows.columns, "before", "after")
