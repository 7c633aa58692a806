"""Mixing sources to target weights by Poisson replication.

Each source gets a target share of the characters of the result, from explicit weights or from its size to the power
``alpha``. A document of source s appears Poisson(rate_s) times, rate_s being target over present share times
``epochs``. The count inverts the distribution at a uniform number that md5 makes from the seed and the document, so a
rerun after a lost executor gives the same copies. The copies are then put into one global order by a second hash, whose
ranges are even and known beforehand, so nothing is sampled for the sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, text_or_empty

#: Up to so many probabilities (a double each), the table of rates is broadcast; larger ones are joined by a shuffle.
BROADCAST_DOUBLES = 1_000_000
#: Characters of text for one partition of the result, about.
PARTITION_CHARS = 128 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _log_factorial(k: Column) -> Column:
    """ln k!, exact up to 15 and by Stirling's series beyond, good to 15 digits."""
    exact = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(k, F.lit(16)).cast("double")
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < 16, F.get(exact, k.cast("int"))).otherwise(series)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: mix_source, chars, rate (its mean number of repetitions), low, cdf (cumulated probabilities from low on).

    Sources that ``weights`` does not name get weight 0. A null source is a source of its own. A source without
    characters has rate 0, as no repetition of it changes the mix. Counts below low, and those past the end of cdf, have
    a probability under 1e-30.
    """
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.char_length(text_or_empty())).alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(alpha))
    else:
        weight = F.coalesce(*[F.when(F.col("mix_source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    whole = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_chars") * F.lit(epochs) / F.col("chars"))
    rated = sizes.crossJoin(whole).select("mix_source", "chars", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # one row on the right
    wide = 12 * F.sqrt("rate") + 30
    low, last = F.greatest(F.floor(F.col("rate") - wide), F.lit(0)), F.ceil(F.col("rate") + wide)
    terms = rated.select("*", low.alias("low"), F.explode(F.sequence(low, F.when(F.col("rate") > 0, last).otherwise(low))).alias("k"))
    p = F.when(F.col("rate") > 0, F.exp(-F.col("rate") + F.col("k") * F.log(F.greatest("rate", F.lit(1e-300))) - _log_factorial(F.col("k")))).otherwise(1.0)
    upward = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # some 24 roots of the rate
    summed = terms.withColumn("below", F.sum(p).over(upward))
    return summed.groupBy("mix_source", "chars", "rate", "low").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "below"))), lambda x: x["below"]).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 1) -> DataFrame:
    """``docs`` with each document repeated by its Poisson count, in a global pseudo-random order.

    Adds ``copy_no`` (0 upwards) and ``shuffle_key`` (the rows are sorted by it). Null or empty texts count no
    characters but are repeated like the rest of their source; very long ones move whole, as any other. Rows that share a
    doc_id share their counts; ties of the key keep no order; an empty table gives an empty table; further columns pass
    through, whatever their names, but those named like the two new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy_no", "shuffle_key")
    rates = cut(source_rates(docs, weights, alpha, epochs))
    doubles, chars = rates.agg(F.sum(F.size("cdf")), F.sum(F.col("chars") * F.col("rate"))).first()
    table = rates.select("mix_source", "low", "cdf")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("of"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"))
    joined = rows.join(F.broadcast(table) if (doubles or 0) <= BROADCAST_DOUBLES else table, F.col("of").eqNullSafe(F.col("mix_source")))
    u = uniform(F.lit(f"{seed}:count"), F.col("id"))
    count = (F.col("low") + F.size(F.filter("cdf", lambda c: c <= u))).cast("int")
    counted = joined.select("row", "id", count.alias("n")).where("n > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy_no"))
    copies = copies.select("row", "copy_no", F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.col("id"), F.col("copy_no").cast("string"))).alias("shuffle_key"))
    parts = max(shuffle_partitions(spark), int((chars or 0) // PARTITION_CHARS))
    prefix = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
    dealt = copies.repartitionById(parts, F.floor(prefix * parts / (1 << 32)).cast("int"))  # even ranges of the hash, in order
    return dealt.sortWithinPartitions("shuffle_key").select("row.*", "copy_no", "shuffle_key")


def oracle_sql(docs: str = "documents", alpha: float = 0.5, seed: int = 1, columns: str = "d.doc_id, d.text, d.lang, d.source, d.n_chars") -> str:
    return f"""
    WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM {docs} GROUP BY source),
    w AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {alpha}) ELSE 0 END AS weight FROM sizes),
    r AS (SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * sum(chars) OVER () / chars ELSE 0 END AS rate FROM w),
    t AS (SELECT source, rate, unnest(range(greatest(0, floor(rate - 12 * sqrt(rate) - 30))::BIGINT, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
    p AS (SELECT source, k, CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - lgamma(k + 1)) ELSE CASE WHEN k = 0 THEN 1 ELSE 0 END END AS pmf FROM t),
    c AS (SELECT source, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
    low AS (SELECT source, min(k) AS low FROM c GROUP BY source),
    u AS (SELECT *, ('0x' || substr(md5('{seed}:count|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM {docs}),
    n AS (SELECT d.doc_id, d.source, count(c.k) + any_value(low.low) AS n FROM u d JOIN low ON low.source = d.source LEFT JOIN c ON c.source = d.source AND c.cdf <= d.u GROUP BY ALL)
    SELECT {columns}, g.copy_no::INTEGER AS copy_no, md5('{seed}:order|' || d.doc_id || '|' || g.copy_no) AS shuffle_key
    FROM {docs} d JOIN n ON n.doc_id = d.doc_id, LATERAL (SELECT unnest(range(0, n.n)) AS copy_no) g
    """
