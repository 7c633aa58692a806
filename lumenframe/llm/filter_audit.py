"""Filter interaction audit: what each of five filters removes, in every order that they can be applied in.

Which filters a document fails is a mask of five bits, and with the order it decides the step that removes the document:
the first one whose filter is in the mask. A table of 32 masks by 120 orders holds that step. Each task looks its
documents' masks up there and counts removals by part, order, step and label; these partial arrays are summed. Every
measure is a sum over documents, so the shares of the tasks add up to the result.

Filter E asks whether an earlier document has the same text anywhere in the table. Texts meet as SHA-256 values; only those
that occur more than once are joined back, from a table of their own, so that Spark can split the rows of a common one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, text_or_empty

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5  # words; distinct words and capitals in a hundred
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
ORDERS = list(permutations(range(5)))
ORDER_NAMES = ["".join(FILTERS[f] for f in o) for o in ORDERS]
#: The step of each mask (row) in each order (column) that removes a document, from 0; 5 where none does.
FIRST = np.array([[next((s for s, f in enumerate(o) if m >> f & 1), 5) for o in ORDERS] for m in range(32)])
AT = np.array(ORDERS)  # the filter of each step
PARTS_KEPT = 512  # parts that a task counts before it passes their arrays on

FLAGGED = "doc_id long, part string, mask int, digest binary"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SHARES = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)


def fails(text: bytes) -> int:
    """The filters A to D that a text in UTF-8 fails."""
    words = text.split()  # at the six ASCII white spaces
    n, points = len(words), len(text) if text.isascii() else len(text.decode("utf-8", "surrogatepass"))
    mask = A * (n < MIN_WORDS) + B * (100 * len(set(words)) < MIN_DISTINCT * n)
    mask += C * (100 * (len(text) - len(text.translate(None, CAPITALS))) > MAX_CAPITALS * points)
    return mask + D * (len(text) > len(text.translate(None, SIGNS)))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = [], []
        for value in b.column("text"):
            text = value.as_buffer().to_pybytes()
            masks.append(fails(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.record_batch([b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def shares(counts: np.ndarray) -> np.ndarray:
    """``counts``: documents by mask (32) and label (bit 0 good, bit 1 toxic). Gives the measures by order, step and measure."""
    mask, label = np.nonzero(counts)
    n = counts[mask, label]
    # exact: float64 weights hold whole numbers up to 2^53
    where = (np.arange(120) * 6 + FIRST[mask]) * 4 + label[:, None]
    removed = np.bincount(where.ravel(), np.repeat(n, 120), 120 * 6 * 4).astype(np.int64).reshape(120, 6, 4)[:, :5]
    by_mask = counts.sum(axis=1)
    failing = np.array([by_mask[[m for m in range(32) if m >> f & 1]].sum() for f in range(5)])
    out = np.zeros((120, 5, len(MEASURES)), dtype=np.int64)
    gone = removed.sum(axis=2)
    out[:, :, 0] = by_mask.sum() - gone.cumsum(axis=1)
    out[:, :, 1] = gone
    out[:, :, 2] = failing[AT] - gone
    out[:, :, 3] = by_mask[1 << AT]
    out[:, :, 4] = removed[:, :, 1] + removed[:, :, 3]
    out[:, :, 5] = removed[:, :, 2] + removed[:, :, 3]
    out[:, :, 6] = np.bincount(AT.ravel(), gone.ravel(), 5).astype(np.int64)[AT]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}

    def partial() -> Iterator[pa.RecordBatch]:
        for part, counts in seen.items():
            measured = shares(counts).reshape(600, len(MEASURES))
            names = pa.array(np.repeat(ORDER_NAMES, 5).tolist(), pa.string())
            steps = pa.array(np.tile(np.arange(1, 6, dtype=np.int32), 120))
            yield pa.record_batch([pa.array([part] * 600, pa.string()), names, steps, *(pa.array(np.ascontiguousarray(c)) for c in measured.T)], ["part", "filter_order", "step", *MEASURES])
        seen.clear()

    for b in batches:
        coded = pc.dictionary_encode(b.column("part"))
        cell = (coded.indices.to_numpy() * 32 + b.column("mask").to_numpy()) * 4 + b.column("label").to_numpy()
        counts = np.bincount(cell, minlength=len(coded.dictionary) * 128).reshape(-1, 32, 4)
        for part, own in zip(coded.dictionary.to_pylist(), counts, strict=True):
            seen[part] = seen[part] + own if part in seen else own
        if len(seen) > PARTS_KEPT:
            yield from partial()
    yield from partial()


def audit_filters(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """part, filter_order (120), step (1 to 5), and the measures, 600 rows for each part that occurs, zeros included.

    kept: documents of the part left after the step; removed: removed there; redundant: failing the step's filter but
    removed earlier; unique_fails: failing no other filter; good_lost, toxic_lost: removed there and labelled quality 1,
    toxic 1; shapley: what the filter removes, summed over all orders.

    ``part`` is ``source`` unless given; null is the empty part. A null text is empty, and an empty one fails A alone, and E
    where an earlier one is empty. A null doc_id is earlier than all others and has no label; rows of equal doc_id and text
    are not earlier than each other. Of several labels of a doc_id one of 1 is enough. Very long texts are taken whole; an
    empty table gives no rows. Columns other than doc_id, text, source, and doc_id, quality, toxic of ``labels``, are not read.
    """
    part = F.col("source") if part is None else part
    rows = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + 2 * F.max(F.when(F.col("toxic") == 1, 1).otherwise(0))).alias("label"))
    with Scratch(docs.sparkSession) as scratch:
        flagged = scratch.cut(rows.mapInArrow(_flag, FLAGGED))
        first = flagged.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        first, marks = scratch.cut(first), scratch.cut(marks.where("label > 0"))
        # a null doc_id has no label: such rows are dealt out by their text instead of meeting in one task
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part", "mask")).otherwise(F.lit(0))
        rows = flagged.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
        rows = rows.join(first, "digest", "left")
        mask = F.col("mask") + F.when(F.struct("doc_id") > F.col("first"), E).otherwise(0)
        counted = rows.select("part", mask.cast("int").alias("mask"), F.coalesce("label", F.lit(0)).cast("int").alias("label")).mapInArrow(_count, SHARES)
        return cut(counted.groupBy("part", "filter_order", "step").agg(*(F.sum(m).alias(m) for m in MEASURES)))


#: The definition, filter by filter and order by order.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, doc_id > first AS e FROM w),
g AS (SELECT f.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM f LEFT JOIN labels l USING (doc_id)),
fails AS (SELECT doc_id, part, good, toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS n, unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([a, b, c, d, e]) AS failing FROM g),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM letters v, letters w, letters x, letters y, letters z
           WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter FROM orders, range(1, 6) r(step)),
-- each document in each order: the step that removes it, 6 where none does
gone AS (SELECT g.doc_id, g.part, g.good, g.toxic, o.filter_order,
                least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END, CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END,
                      CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END, CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS place
         FROM g, orders o),
removed AS (SELECT part, filter_order, place, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM gone GROUP BY ALL),
totals AS (SELECT part, count(*) AS n FROM g GROUP BY part),
single AS (SELECT part, letter, count(*) FILTER (failing) AS failing, count(*) FILTER (failing AND n = 1) AS alone FROM fails GROUP BY ALL),
out AS (SELECT s.part, t.filter_order, t.step, t.letter, s.failing, s.alone, coalesce(r.n, 0) AS removed, coalesce(r.good, 0) AS good, coalesce(r.toxic, 0) AS toxic
        FROM single s JOIN steps t USING (letter) LEFT JOIN removed r ON r.part = s.part AND r.filter_order = t.filter_order AND r.place = t.step)
SELECT part, filter_order, step, (t.n - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step))::BIGINT AS kept, removed::BIGINT AS removed,
       (failing - removed)::BIGINT AS redundant, alone::BIGINT AS unique_fails, good::BIGINT AS good_lost, toxic::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM out JOIN totals t USING (part)
"""
