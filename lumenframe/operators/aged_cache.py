"""A keyed cache whose entries live for a time: which calls are hits, and which ones fetch anew.

A call is a hit while the key's entry is younger than the age; any other call fetches and is the new entry. So what a call
does hangs on all calls before it. Calls are range-partitioned by key and time. In its range a task links each call to the
first one that is an age or more later: the calls that fetch are a chain of such links. Only a key that goes on from the
range before has an unknown beginning; for it, the task says where each possible chain ends, and these short tables,
one for each range, give every range its beginning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpointed

NEVER = -(1 << 62)  # an entry that no age keeps


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Table]]:
    """(key, times, rows) for each key of a sorted range; _key and _at come first."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        keys = t.column("_key").to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(edges, edges[1:]):
            if held and i < j and held[0].column("_key")[0].as_py() != keys[i]:
                yield _joined(held)
                held = []
            if i < j:
                held.append(t.slice(i, j - i))
    if held:
        yield _joined(held)


def _joined(held: list[pa.Table]) -> tuple[str, np.ndarray, pa.Table]:
    t = pa.concat_tables(held).combine_chunks()
    return t.column("_key")[0].as_py(), t.column("_at").to_numpy(), t


def ends(at: np.ndarray, age: int) -> tuple[np.ndarray, np.ndarray]:
    """For a chain that enters at the first call of at least t: (up to which t, the time of its last fetch), ascending."""
    follow = np.searchsorted(at, at + age)
    end = at.copy()
    for i in range(len(at) - 1, -1, -1):
        if follow[i] < len(at):
            end[i] = end[follow[i]]
    last = np.append(end[1:] != end[:-1], True)
    return at[last], end[last]


def _chain(at: np.ndarray, created: int, age: int) -> np.ndarray:
    """Which calls fetch, if the entry is of ``created`` when they begin."""
    fetch = np.zeros(len(at), dtype=bool)
    i = int(np.searchsorted(at, created + age))
    while i < len(at):
        fetch[i] = True
        i = int(np.searchsorted(at, at[i] + age))
    return fetch


SUMMARY = "range int, first string, last string, until array<long>, end array<long>, created long"


def _summary(age: int) -> Callable:
    """Of each range: its first key with the ends of its chains, its last key and, unless that is the first, its last fetch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = until = end = range_ = None
        created = NEVER  # not used where the last key is the first
        for key, at, rows in _runs(batches):
            if first is None:
                first, range_, (until, end) = key, rows.column("_range")[0].as_py(), ends(at, age)
            else:
                created = int(at[_chain(at, NEVER, age)][-1])
            last = key
        if first is not None:
            row = [[range_], [first], [last], [until.tolist()], [end.tolist()], [created]]
            types = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["range", "first", "last", "until", "end", "created"])

    return run


def _begin(age: int) -> Callable:
    """The entry that each range's first key begins with, where an earlier range has that key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, key, created = [], None, None
        for r in rows.sort_values("range").itertuples():
            entry = created if key == r.first else NEVER
            if entry != NEVER:
                out.append((r.range, entry))
            k = int(np.searchsorted(r.until, entry + age))
            after = entry if k == len(r.until) else int(r.end[k])
            key, created = r.last, after if r.first == r.last else int(r.created)
        return pd.DataFrame(out, columns=["_range", "_created"])

    return run


def _marked(age: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = False
        for _, at, t in _runs(batches):
            entry = NEVER if began else (t.column("_created")[0].as_py() or NEVER)
            began = True
            fetch = _chain(at, entry, age)
            created = np.maximum.accumulate(np.where(fetch, at, entry))
            t = t.drop_columns(["_key", "_at", "_created"]).append_column("hit", pa.array(~fetch)).append_column("created_at", pa.array(created, pa.int64()))
            yield from t.to_batches(max_chunksize=10_000)

    return run


def cached_calls(calls: DataFrame, keys: list[str], at: str, age: int, tie: str) -> DataFrame:
    """``calls`` with ``hit`` (the entry is younger than ``age``) and ``created_at``, when the entry that serves the call was fetched.

    ``at`` is a number; calls of one time are taken by ``tie``. Nulls in keys are a key; calls without a time are left out.
    """
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = calls.where(F.col(at).isNotNull()).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key"), F.col(at).cast("long").alias("_at"), *calls.columns)
    ranges = named.repartitionByRange(n, "_key", "_at", tie).sortWithinPartitions("_key", "_at", tie).withColumn("_range", F.spark_partition_id())
    ranges = checkpointed(ranges)  # Spark samples for the bounds of ranges, so a second evaluation may have others
    # A table of a row for each range, in one task.
    summary = ranges.select("_key", "_at", "_range").mapInArrow(_summary(age), SUMMARY)
    begin = summary.groupBy().applyInPandas(_begin(age), "_range int, _created long")
    entered = ranges.join(F.broadcast(begin), "_range", "left").select("_key", "_at", *calls.columns, "_created")
    schema = T.StructType([*calls.schema.fields, T.StructField("hit", T.BooleanType()), T.StructField("created_at", T.LongType())])
    return entered.mapInArrow(_marked(age), schema)
