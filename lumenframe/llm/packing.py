"""Packing documents into sequences of 1024 tokens by cutting-stock column generation.

A document's ids are cut into full pieces of 1024, a tail that is a multiple of 16, and a crumb of under 16, so that the
histogram of lengths has at most 79 kinds. A linear program over patterns (how many pieces of each kind share a sequence)
is solved by column generation: a knapsack dynamic program over the capacity prices new patterns from the dual values.
Patterns are used as often as the solution says, rounded down; what is left over, a few sequences for each pattern, is
packed first-fit decreasing. Only the histogram reaches the driver. Pieces are ranked within their kind and shard, and a
piece's rank says which use of which pattern it fills, so sequence and offset come from one join with the pattern table.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

CAPACITY, GRAIN = 1024, 16
END = np.array([0], dtype="<u4").tobytes()
#: Pieces of a kind are numbered in shards of about so many, each in one task, joined by the shards' counts.
SHARD_ROWS = 1_000_000
#: Distinct words whose ids a worker keeps; the table starts anew when full.
CACHED_WORDS = 1_000_000

#: A space beside other white space, where the plain cut is not safe; and the spaces where it is.
ODD_SPACE, SAFE_SPACE = re.compile(r"\s | \s"), re.compile(r"(?<=\S) (?=\S)")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _encoder(path: str, ranks_path: str | None) -> Callable[[str], list[int]]:
    """Ids of a text, as the tokenizer file gives them without special tokens added; one that stands in the text is its id.

    The same vocabulary as ranks, where given, is several times as fast; tests hold the two equal.
    """
    if ranks_path is None:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    # Fixed value: the expression that splits a text before byte pairs are merged.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    if not special:
        return encode
    between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def run(text: str) -> list[int]:
        if not between.search(text):
            return encode(text)
        return [i for p in between.split(text) if p for i in ([special[p]] if p in special else encode(p))]

    return run


def token_bytes(encode: Callable[[str], list[int]]) -> Callable[[str], bytes]:
    """Ids of a text as little-endian 32-bit numbers, with a table of words seen before.

    A space between two characters that are not white space always begins a new token, so a text is cut there and the
    parts are looked up; a part is a word with the space before it.
    """
    seen: dict[str, bytes] = {}

    def part(p: str) -> bytes:
        ids = encode(p)
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(p) <= 40:
            if len(seen) >= CACHED_WORDS:
                seen.clear()
            seen[p] = got
        return got

    def run(text: str) -> bytes:
        words = SAFE_SPACE.split(text) if ODD_SPACE.search(text) else text.split(" ")
        parts = [words[0], *[" " + w for w in words[1:]]]
        got = list(map(seen.get, parts))
        if None in got:
            got = [part(p) if g is None else g for p, g in zip(parts, got, strict=True)]
        return b"".join(got)

    return run


def _pieces(path: str, ranks_path: str | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = token_bytes(_encoder(path, ranks_path))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of(text or "") + END
                n = len(ids) // 4
                tail = n % CAPACITY
                edges = [*range(0, n - tail + 1, CAPACITY), n - tail % GRAIN, n]
                rows += [(doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n) for a, b in zip(edges, edges[1:]) if b > a]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def cut_documents(docs: DataFrame, path: str, ranks_path: str | None = None) -> DataFrame:
    """Pieces of each document's ids and the id 0 that ends it: doc_id, start, length, ids_crc32, doc_tokens."""
    return docs.select("doc_id", "text").mapInPandas(_pieces(path, ranks_path), PIECES)


def _best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the counts of each kind with the largest worth that fit."""
    use = np.flatnonzero(worth > 1e-12)
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    size, value = lengths[use], worth[use]
    order = np.argsort(size)
    size, value, use = size[order], value[order], use[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            total = best[c - size[:k]] + value[:k]
            if total[i := int(total.argmax())] > best[c] + 1e-12:
                best[c], took[c] = total[i], i
    counts, c = np.zeros(len(lengths), dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[use[took[c]]] += 1
            c -= size[took[c]]
    return counts


def solve_patterns(lengths: np.ndarray, need: np.ndarray, capacity: int = CAPACITY, steps: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """(counts by kind, uses) such that the uses hold exactly ``need`` pieces of each kind."""
    k = len(lengths)
    if not k:
        return []
    basis = np.diag(capacity // lengths).astype(float)
    held = need / np.diag(basis)
    steps_left = steps
    while True:
        inverse = np.linalg.inv(basis)
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        new = _best_pattern(lengths, duals, capacity)
        if duals @ new <= 1 + 1e-7:
            break
        steps_left -= 1
        if not steps_left:
            raise RuntimeError("column generation did not settle")
        held = np.maximum(inverse @ need, 0)
        by = inverse @ new
        ratio = np.where(by > 1e-9, held / np.where(by > 1e-9, by, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    held = np.maximum(np.linalg.solve(basis, need.astype(float)), 0)
    uses = np.floor(held + 1e-6).astype(np.int64)
    patterns = [(basis[:, j].round().astype(np.int64), int(uses[j])) for j in range(k) if uses[j]]
    left = need - sum((c * u for c, u in patterns), np.zeros(k, dtype=np.int64))
    while (left < 0).any():  # rounding met a count from above
        j = next(i for i, (c, _) in enumerate(patterns) if (c[left < 0] > 0).any())
        c, u = patterns[j]
        patterns[j] = (c, u - 1)
        left = left + c
    open_: list[tuple[np.ndarray, int]] = []
    for i in np.argsort(-lengths):
        for _ in range(int(left[i])):
            for j, (c, free) in enumerate(open_):
                if free >= lengths[i]:
                    c[i] += 1
                    open_[j] = (c, free - lengths[i])
                    break
            else:
                c = np.zeros(k, dtype=np.int64)
                c[i] = 1
                open_.append((c, capacity - lengths[i]))
    return [p for p in patterns if p[1]] + [(c, 1) for c, _ in open_]


def pack(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 in each sequence, at most 1024 tokens."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most 79 lengths
    lengths = np.array(sorted(x for x in counts if x < CAPACITY), dtype=np.int64)
    found = solve_patterns(lengths, np.array([counts[x] for x in lengths], dtype=np.int64))
    rows, first, taken = [], 0, dict.fromkeys(counts, 0)
    if CAPACITY in counts:
        rows.append((CAPACITY, 0, counts[CAPACITY], 1, 0, 0))
        first = counts[CAPACITY]
    for kinds, uses in found:
        offset = 0
        for length, each in zip(lengths.tolist(), kinds.tolist(), strict=True):
            if each:
                rows.append((length, taken[length], taken[length] + each * uses, each, first, offset))
                taken[length] += each * uses
                offset += each * length
        first += uses
    table = spark.createDataFrame(rows, "length long, low long, high long, each long, first long, begin long")
    shards = max(shuffle_partitions(spark), max(counts.values(), default=0) // SHARD_ROWS + 1)
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))
    sharded = pieces.withColumn("shard", shard)
    sizes = sharded.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = sizes.select("length", "shard", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = sharded.withColumn("rn", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "shard"]).withColumn("rank", F.col("before") + F.col("rn"))  # at most 79 rows for each million pieces, or for each shuffle partition
    placed = ranked.join(F.broadcast(table), "length").where("rank >= low and rank < high")  # some hundred rows, by the count of lengths
    local = F.col("rank") - F.col("low")
    sequence = F.col("first") + F.floor(local / F.col("each"))
    offset = F.col("begin") + F.pmod(local, F.col("each")) * F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("bigint").alias("sequence_id"), offset.cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None) -> DataFrame:
    """All documents' pieces with their places.

    A null or empty text is the end id alone; a very long one is cut into many pieces; rows that share a doc_id, or repeat
    or lack it, are packed each for itself; an empty table packs nothing; further columns are not read, whatever their names.
    """
    return pack(cut(cut_documents(docs, path, ranks_path)))
