"""Near-duplicates: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

Documents with equal shingle sets are one class first. Each class gets one pass over its shingles: the hash's high bits
choose a bin, each bin keeps its smallest hash, and an empty bin borrows from the bin that its own probing sequence finds
first. Forty bands of four bins find a pair at the threshold of 0.75 but for a chance of about 3 in 10 million. In a
bucket of a few classes all pairs are candidates. A larger one is dealt into cells of about eight, and each class is
paired with the bucket's centre, the same one in most buckets of a family, and with its cell's. Candidates are confirmed
on the full sets.

Classes of a large bucket that still holds several components then meet by their rare shingles: with shingles ordered
from rare to common, two near sets share one among the first seventh of the smaller set and the first quarter of the
larger one, at places that leave enough for the overlap wanted. So what stars have not linked is found without pairing a
bucket out, and exactly: a passage that thousands of different documents share is common, and no first shingle of theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut
from .components import components
from .shingles import U, scramble, shingle_sets

BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
THRESHOLD = 75  # per cent
ALL_PAIRS_UP_TO = 8
#: Members of a cell of a large bucket, about.
CELL = 8
#: Longs of the bit map of a class: bit h modulo 1024 is set for each shingle h. It bounds how many shingles two sets can share.
LONGS = 16
#: Up to so many ids (8 bytes each), the ids of classes to confirm are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Characters whose shingle sets a worker returns at a time.
TEXT_AT_ONCE = 4 << 20
PROBES = 2048
_rng = np.random.default_rng(20_17)
PROBE = _rng.integers(0, BINS, (BINS, PROBES), dtype=np.int16)
BIN_FACTORS = _rng.integers(1, 1 << 62, ROWS, dtype=np.int64).astype(U) * U(2) + U(1)


def signature(found: np.ndarray) -> np.ndarray:
    """Of a set of ascending hashes, the smallest hash of each bin, empty bins filled by probing."""
    bins = ((found >> U(32)) * U(BINS)) >> U(32)
    where, first = np.unique(bins, return_index=True)
    sig = np.zeros(BINS, dtype=U)
    full = np.zeros(BINS, dtype=bool)
    sig[where], full[where] = found[first], True
    empty = np.flatnonzero(~full)
    for probes in (32, PROBES):
        if not len(empty):
            break
        tried = full[PROBE[empty, :probes]]
        hit = tried.any(axis=1)
        sig[empty[hit]] = sig[PROBE[empty[hit], tried[hit].argmax(axis=1)]]
        empty = empty[~hit]
    sig[empty] = found[0]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    return scramble((sig.reshape(BANDS, ROWS) * BIN_FACTORS).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U)).view(np.int64)


def bit_map(found: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * LONGS, dtype=bool)
    bits[found % U(64 * LONGS)] = True
    return np.packbits(bits).view(np.int64)


def flat(side: str) -> list[Column]:
    """n and the longs of bits as columns of their own, named after the side of a join."""
    return [F.col("n").alias(f"{side}n"), *(F.col("bits")[i].alias(f"{side}{i}") for i in range(LONGS))]


def may_be_near(x: str, y: str) -> Column:
    """False only for pairs that cannot be near: too few shingles of the larger set, or too many bits that the other one lacks.

    Sets with nx and ny shingles and the wanted similarity share at least 75 (nx + ny) / 175 of them, so the rest of either
    set, and with it the bits that only this one has, is bounded.
    """
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    only = lambda x, y: reduce(Column.__add__, [F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in range(LONGS)])
    fits = lambda n, x, y: (n - only(x, y)) * (100 + THRESHOLD) >= THRESHOLD * (nx + ny)
    return (F.least(nx, ny) * 100 >= THRESHOLD * F.greatest(nx, ny)) & fits(nx, x, y) & fits(ny, y, x)


def _by_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in runs of a few megabytes of text, so that a worker never holds the sets of a whole batch."""
    for batch in batches:
        for _, some in batch.groupby(batch["text"].map(lambda t: len(t or "")).cumsum() // TEXT_AT_ONCE, sort=False):
            yield some


def _fold(found: np.ndarray, seed: int) -> int:
    return int(scramble(found ^ U(seed)).sum(dtype=U).view(np.int64))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _by_text(batches):
        sets = shingle_sets(list(batch["text"]))
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "t": batch["t"],
                "n": [len(s) for s in sets],
                "s1": [_fold(s, 0) for s in sets],
                "s2": [_fold(s, 0x5851F42D4C957F2D) for s in sets],
                "bits": [bit_map(s) for s in sets],
                "keys": [band_keys(signature(s)) if len(s) else np.empty(0, np.int64) for s in sets],
            }
        )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _by_text(batches):
        sets = shingle_sets(list(batch["text"]))
        yield pd.DataFrame({"doc_id": batch["doc_id"], "s1": [_fold(s, 0) for s in sets], "s": [s.tobytes() for s in sets]})


def _common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        same = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            both = np.concatenate((np.frombuffer(x, U), np.frombuffer(y, U)))
            both.sort(kind="stable")
            same.append(int((both[1:] == both[:-1]).sum()))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "na": [len(x) // 8 for x in batch["sa"]], "nb": [len(x) // 8 for x in batch["sb"]], "both": same})


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch["s"]]
        size = [len(s) for s in sets]
        yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), size), "label": np.repeat(batch["label"].to_numpy(), size), "n": np.repeat(size, size), "token": np.concatenate([*sets, np.empty(0, np.int64)])})


def _sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (low, s1 and more columns; a written table) with s, the packed shingle set of the class."""
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("low").alias("doc_id")).distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInPandas(_sets, "doc_id long, s1 long, s binary").withColumnsRenamed({"doc_id": "low"})
    found = sets.join(F.broadcast(wanted) if few else wanted, ["low", "s1"])
    return found.dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are near."""
    for side, end in (("x", "a"), ("y", "b")):
        pairs = pairs.join(classes.select(F.col("node").alias(end), *flat(side)), end)
    pairs = scratch.cut(pairs.where(may_be_near("x", "y")).select("a", "b"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.cut(classes.select("node", "low", "s1").join(ends, "node"))
    sets = _sets_of(wanted, docs)
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    counted = two.mapInPandas(_common, "a long, b long, na long, nb long, both long")
    near = scratch.cut(counted.where(F.col("both") * 100 >= THRESHOLD * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))
    scratch.drop(pairs, wanted)
    return near


def bucket_pairs(met: DataFrame) -> DataFrame:
    """(a, b), distinct, from rows (key, size, centre, node, n) of the buckets: all pairs of small ones, stars in large ones."""
    few = met.where(F.col("size") <= ALL_PAIRS_UP_TO).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    few = few.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, ALL_PAIRS_UP_TO)).alias("y"))
    few = few.where(F.least("x.n", "y.n") * 100 >= THRESHOLD * F.greatest("x.n", "y.n")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = met.where(F.col("size") > ALL_PAIRS_UP_TO)
    mixed = F.xxhash64("key", "node")
    cells = large.withColumn("cell", F.pmod(mixed, F.ceil(F.col("size") / CELL)))
    seats = cells.groupBy("key", "cell").agg(F.min_by("node", F.xxhash64("node", "key")).alias("own"))
    seated = cells.join(seats, ["key", "cell"]).select("node", F.explode(F.array("centre", "own")).alias("to")).where("node <> to")
    return few.unionByName(seated.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))).distinct()


def prefix_pairs(sets: DataFrame, bits: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), distinct: all pairs of different labels that may be near, from rows (node, label, s) and the nodes' bit maps.

    Sets with n and m shingles, n <= m, are near only if they share 75 (n + m) / 175. If p shingles of one stand before
    the first shared one, n + m is at most 7 (n - p) / 3 for either of them. A node with p before a shingle so reaches
    sizes up to (4 n - 7 p) / 3 there, and both must reach the other's size. Sizes go in bands, so that few rows meet, and
    bit maps rule out most pairs where they meet.
    """
    tokens = scratch.cut(sets.mapInPandas(_shingles, "node long, label long, n long, token long"))
    often = scratch.cut(tokens.groupBy("token").agg(F.count("*").alias("often"), F.min("label").alias("x"), F.max("label").alias("y")).where("often > 1"))
    shared = tokens.join(often, "token")
    rare_first = Window.partitionBy("node").orderBy("often", "token")  # one document's shingles
    own = F.col("n") - F.count("*").over(Window.partitionBy("node"))  # the shingles that only this node has come first
    ranked = shared.withColumn("p", own + F.row_number().over(rare_first) - 1).where("x <> y and 4 * p <= n")
    base = 100 / THRESHOLD
    band = lambda x: F.floor(F.log(F.greatest(x, F.lit(1)).cast("double") + 0.5) / math.log(base))
    ranked = ranked.select("node", "label", "n", "token", F.floor((4 * F.col("n") - 7 * F.col("p")) / 3).alias("reach"))
    rows = scratch.cut(ranked.join(bits.select("node", "bits"), "node"))
    name = lambda side: [*(F.col(c).alias(c + side) for c in ("node", "label", "reach")), *flat(side)]
    small = rows.where("reach >= n").select("token", *name("a"), F.explode(F.sequence(band(F.col("n")), band(F.col("reach")))).alias("band"))
    large = rows.select("token", *name("b"), band(F.col("n")).alias("band"))
    fits = F.expr("labela <> labelb and an <= bn and bn <= reacha and an <= reachb")
    met = small.join(large, ["token", "band"]).where(fits & may_be_near("a", "b"))
    found = scratch.cut(met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct())
    scratch.drop(tokens, often, rows)
    return found


def near_edges(classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of classes (node, low, s1, n, bits, keys), enough of those whose sets are near to link all that are."""
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node")).alias("centre")).where("size > 1")
    sizes = scratch.cut(sizes)  # a table of its own, so that the join can split a hot bucket
    met = scratch.cut(keyed.join(sizes, "key").select("key", "size", "centre", "node", "n"))
    near = _confirmed(bucket_pairs(met), classes, docs, scratch)
    large = met.where(F.col("size") > ALL_PAIRS_UP_TO).select("key", "node")
    labelled = large.join(components(near, "a", "b", scratch), "node", "left")
    labelled = scratch.cut(labelled.select("key", "node", F.coalesce("component", "node").alias("label")))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = scratch.cut(classes.select("node", "low", "s1").join(labelled.join(open_, "key", "left_semi").select("node", "label").distinct(), "node"))
    scratch.drop(sizes, met, labelled)
    pairs = prefix_pairs(_sets_of(left, docs).select("node", "label", "s"), classes, scratch)
    return near.unionByName(_confirmed(pairs, classes, docs, scratch))


def _judged(docs: DataFrame) -> DataFrame:
    """What ``near_duplicates`` returns, and t, the hash of the text."""
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.withColumn("t", F.xxhash64("text"))
        sketches = scratch.cut(rows.mapInPandas(_sketches, "doc_id long, t long, n long, s1 long, s2 long, bits array<long>, keys array<long>"))
        worded = sketches.where("n > 0 and doc_id is not null")
        grouped = worded.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("low"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
        classes = scratch.cut(grouped.withColumn("node", F.monotonically_increasing_id()))
        linked = components(near_edges(classes, docs, scratch), "a", "b", scratch)
        of = classes.select("node", "n", "s1", "s2", "low").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = of.groupBy("component").agg(F.min("low").alias("component_id"))
        named = of.join(least, "component").select("n", "s1", "s2", "component_id")
        out = sketches.select("doc_id", "t", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return cut(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "t"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links of 0.75 and more reach), kept.

    A null or empty text, or one without words, has no shingles and links with nothing. Rows that share a doc_id are
    documents of their own, each with its text. A row without a doc_id has nothing to be named by: it links with nothing,
    its component_id is null and it is kept. An empty table gives no rows. Very long texts are taken whole, a few
    megabytes at a time. Further columns are not read, whatever their names.
    """
    return _judged(docs).drop("t")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; documents without words, or without a doc_id, all stay.

    Rows that share both doc_id and text stay or go together. An empty table stays empty; all columns pass through,
    whatever their names.
    """
    gone = _judged(docs).where("not kept").select("doc_id", "t").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("t"))
    return rows.join(gone, ["doc_id", "t"], "left_anti").select("row.*")


#: The textbook form: all pairs that share a shingle, confirmed by counting.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
"""
