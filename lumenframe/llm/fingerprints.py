"""Document fingerprints: SimHash, and a search for all fingerprints within a Hamming radius.

A term is a pair of neighbouring words, its weight the number of letters in it, so that pairs of short, common words
count less. Each term's 64-bit hash votes on 64 signed bits. Two votes share one 64-bit sum (32 bits each), so 32 sums
stand for the 64 counters; a text has under 2^31 characters, so no half overflows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, text_or_empty

LANES = 32
LANE_ONES = (1 << 32) | 1
#: Documents whose ids agree in all but the last bits are ordered in one task.
BUCKET = 256


def _terms(text: Column) -> Column:
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per group of ``keys`` with ``fp``, the signed 64-bit SimHash of the group's texts; without words it is 0."""
    rows = texts.select(*keys, F.inline_outer(_terms(F.col(text))).alias("a", "b"))
    weight = (F.char_length(F.coalesce("a", F.lit(""))) + F.char_length(F.coalesce("b", F.lit("")))).cast("bigint")
    rows = rows.select(*keys, F.xxhash64("a", "b").alias("h"), weight.alias("w"))
    lane = lambda j: F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(LANE_ONES)) * F.col("w")).alias(f"l{j}")
    summed = rows.groupBy(*keys).agg(F.sum("w").alias("w"), *map(lane, range(LANES)))
    bits = F.lit(0).cast("bigint")
    for j in range(LANES):
        low, high = F.col(f"l{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"l{j}", 32)
        for count, bit in ((low, j), (high, j + 32)):
            value = (1 << bit) if bit < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("w"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return summed.select(*keys, bits.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (bucket, rn, is_tail, doc_id, text, next_text): each document beside the next by doc_id, the last beside the first.

    Ids are dealt by range into buckets, each ordered by itself. What follows a bucket's last document is the head of the
    next bucket that exists, appended as a row with is_tail. Buckets are dealt by range into the shuffle's partitions and
    ordered there; only one row of each partition is ordered in one task, however sparse the ids are.
    """
    base = docs.select(F.coalesce(F.floor(F.col("doc_id") / BUCKET), F.lit(-(1 << 62))).alias("bucket"), "doc_id", text_or_empty().alias("text"))
    heads = base.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    order = cut(base.select("bucket").distinct().repartitionByRange("bucket").withColumn("super", F.spark_partition_id()))
    supers = order.groupBy("super").agg(F.min("bucket").alias("low"))
    wrap = Window.orderBy("super")  # one row for each partition
    supers = supers.select("super", F.coalesce(F.lead("low").over(wrap), F.min("low").over(Window.partitionBy())).alias("after"))
    inside = order.withColumn("following", F.lead("bucket").over(Window.partitionBy("super").orderBy("bucket")))
    following = inside.join(supers, "super").select("bucket", F.coalesce("following", "after").alias("following"))
    tails = following.join(heads.withColumnRenamed("bucket", "following"), "following").select("bucket", F.lit(1).alias("is_tail"), F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"))
    rows = base.withColumn("is_tail", F.lit(0)).unionByName(tails)
    inside_bucket = Window.partitionBy("bucket").orderBy("is_tail", "doc_id", "text")
    return rows.select("bucket", F.row_number().over(inside_bucket).alias("rn"), "is_tail", "doc_id", "text", F.coalesce(F.lead("text").over(inside_bucket), F.lit("")).alias("next_text"))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (second half replaced by the next document's start), and the next document's."""
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("bucket", "rn", "is_tail", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "rn", "is_tail", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.posexplode(F.array("text", "edited")).alias("which", "t"))
    fps = simhash(both, [*keys, "which"], "t")
    pairs = fps.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    pairs = pairs.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn")))
    return pairs.where("is_tail = 0").drop("bucket", "rn", "is_tail")


def block_keys(fp: Column, radius: int) -> Column:
    """Keys of the permuted tables: of 2 * radius blocks, each choice of radius blocks that may be free of differing bits."""
    blocks, keys = 2 * radius, []
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    for t, chosen in enumerate(combinations(range(blocks), radius)):
        mask = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask)).alias("k")))
    return F.array(*keys)


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(q, fp, n): for each fingerprint q of ``queries``, each fingerprint of ``fps`` that differs in ``radius`` bits at most, and its number of documents.

    Equal fingerprints are counted first, so copies meet once. Two fingerprints within the radius agree in at least half
    of 2 * radius blocks and so meet in a table; a pair that meets in several tables is kept once.
    """
    index = fps.groupBy("fp").agg(F.count("*").alias("n")).select("fp", "n", F.explode(block_keys(F.col("fp"), radius)).alias("key")).select("fp", "n", "key.*")
    asked = queries.select(F.col("fp").alias("q")).distinct().select("q", F.explode(block_keys(F.col("q"), radius)).alias("key")).select("q", "key.*")
    met = asked.join(index, ["t", "k"]).where(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius)
    return met.groupBy("q", "fp").agg(F.first("n").alias("n"))


def digest(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The query's rows. ``n_within``: for doc_ids divisible by 100, the documents within the radius (itself included); else null.

    A null text counts as empty; fingerprints of texts without words are 0; very long texts count whole. Rows with equal
    doc_id are ordered by text, a null doc_id comes first; an empty table gives no rows; further columns are not read,
    whatever their names.
    """
    fps = cut(fingerprint_pairs(docs))
    asked = fps.where(F.col("doc_id") % 100 == 0)
    counts = within_radius(fps, asked, radius).groupBy("q").agg(F.sum("n").alias("n_within"))
    out = fps.join(counts, (fps["fp"] == counts["q"]) & (F.col("doc_id") % 100 == 0), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )
