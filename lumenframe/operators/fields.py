"""Which of several interleaved groups of rows are brighter, by letting their histograms rise together.

All groups' counts are raised to the same level, step by step; the level each needs is the value it has reached. The walk
ends when a second group reaches the ceiling. A group's value at a level is the first one whose cumulative count gets there,
and every stop is a count at a known value, so the walk's end follows from the cumulative counts without walking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The shares of samples that the walk may rise to, and below which the floor is read.
TOP, FLOOR = 0.998, 0.05


def high_water(levels: DataFrame, group: str, value: str, values: int, black: int, white: int) -> DataFrame:
    """group, raw, floor, height (raw - floor), median, bright, and verdict (ok, count or pairs), a row for each group of 0..3.

    ``value`` lies in 0 .. values - 1. The samples of group 0 are the reference. The floor is the value reached at the last
    level below 5 % at which no group was above a quarter of the way from black to white. Bright are those above the mean of
    the two middle heights: two must be (else "count"), one of 0 and 2 and one of 1 and 3 (else "pairs").
    """
    groups = levels.sparkSession.range(4).select(F.col("id").cast("int").alias("g"))
    bins = groups.crossJoin(F.broadcast(levels.sparkSession.range(values).select(F.col("id").alias("v"))))  # 4 x values
    counts = levels.where(F.col(value).between(0, values - 1)).groupBy(F.col(group).alias("g"), F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("g").orderBy("v")
    cum = bins.join(counts, ["g", "v"], "left").select("g", "v", F.sum(F.coalesce("n", F.lit(0))).over(up_to).alias("need"))
    quarter = black + int((white - black) / 4)  # towards zero
    # A positive level is reached at the first value whose count, with all before it, gets there, and reads one more than that.
    below = lambda v: F.coalesce(F.max(F.when(F.col("v") == v - 1, F.col("need"))), F.lit(0))
    marks = cum.groupBy("g").agg(F.max("need").alias("total"), below(white - 1).alias("at_white"), below(quarter - 1).alias("at_quarter"))
    total = F.max(F.when(F.col("g") == 0, F.col("total")))
    whites = F.sort_array(F.collect_list(F.col("at_white") + 1))  # of four groups
    ends = marks.agg((total * TOP).cast("long").alias("top"), (total * FLOOR).cast("long").alias("low"), whites[1].alias("second"), F.min("at_quarter").alias("dim"))
    # The last level that the walk tries, and the last one at which floors are read; -1: none.
    last = F.least(F.col("top") - 1, F.col("second")) if white > 0 else F.least(F.col("top") - 1, F.lit(0))
    ends = ends.select(last.alias("last"), F.least(F.col("low") - 1, last, F.col("dim") if quarter > 0 else F.lit(-1)).alias("read"))
    found = cum.crossJoin(F.broadcast(ends)).groupBy("g", "last", "read").agg(F.count(F.when(F.col("need") < F.col("last"), 1)).alias("a"), F.count(F.when(F.col("need") < F.col("read"), 1)).alias("b"))
    # A level above need(v) passes v; a positive level always passes into the first value.
    raw = lambda c, level: F.when(F.col(level) > 0, F.least(F.col(c) + 1, F.lit(values))).otherwise(0)
    found = found.select("g", raw("a", "last").alias("raw"), raw("b", "read").alias("floor"))
    all_ = Window.partitionBy(F.lit(0))  # four rows
    found = found.withColumn("height", F.col("raw") - F.col("floor")).withColumn("h", F.sort_array(F.collect_list("height").over(all_)))
    found = found.withColumn("median", (F.col("h")[1] + F.col("h")[2]) / 2.0).withColumn("bright", F.col("height") > F.col("median"))
    of = F.sort_array(F.collect_list(F.struct("g", "bright")).over(all_))
    found = found.withColumn("of", F.transform(of, lambda x: x["bright"].cast("int")))
    b = lambda i: F.col("of")[i]
    verdict = F.when(b(0) + b(1) + b(2) + b(3) != 2, "count").when((b(0) == b(2)) | (b(1) == b(3)), "pairs").otherwise("ok")
    return found.select(F.col("g").alias(group), "raw", "floor", "height", "median", "bright", verdict.alias("verdict"))
