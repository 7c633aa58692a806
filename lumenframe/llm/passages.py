"""Substring dedup by fixed-block anchors: words in a passage of 35 words that occurs anywhere else are removed.

Blocks of 18 words, side by side from a document's start, are the index. A window of 35 words holds exactly one whole block
of its own document, so a window that repeats holds a block that the other place has too, at any offset. Three steps:

* every rolling window of 18 words probes the index: a block is hit if its words also start at another place;
* each hit is extended by i words to the left and 17 - i to the right, for each i, and the extended hits meet: those that
  occur twice or more are windows that repeat, and their overlapping runs are the maximal repeats;
* the words under them go.

Documents travel in groups of neighbouring ids; a group sends a window that it has many times only once. Windows meet by
hash in parts of about 4 MB of text, packed in binary columns and worked on by numpy: a probe takes 5 bytes, 38 bits of
hash beside the part's, and only says which hits to extend; an extended hit takes 16, with 96 bits beside the part's.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, shuffle_partitions
from .shingles import BASE, SPACE, U, powers, scramble

WINDOW = 35
BLOCK = (WINDOW + 1) // 2  # each window holds one whole block, whatever its offset
BUCKET = 128
SEGMENT = 1 << 20  # bytes whose words are hashed at a time
PART = 4 << 20  # bytes of text whose windows meet in one part, about
ALIGNED, SEVERAL = 1, 2
KEY = U(40 - 2)  # bits of a probe's hash
NOWHERE = 0xFFFFFFFF
EXTENDED = np.dtype([("a", "<u8"), ("b", "<u4"), ("start", "<u4")])
STARTS = np.dtype([("start", "<u4"), ("n", "<u4")])


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The scrambled hash of each word, a polynomial of its bytes from prefix sums, in segments cut between words."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        s, e = int(starts[i]), int(ends[j - 1])
        up, down = powers(e - s)
        sums = np.zeros(e - s + 1, dtype=U)
        np.cumsum((buf[s:e].astype(U) + U(1)) * up, out=sums[1:])
        out[i:j] = scramble((sums[ends[i:j] - s] - sums[starts[i:j] - s]) * down[starts[i:j] - s])
        i = j
    return out


def _rolling(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of the n words that start at each place, or at the places ``at``."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * up[:-1], out=sums[1:])
    at = slice(0, max(0, len(words) - n + 1)) if at is None else at
    ends = slice(n, None) if isinstance(at, slice) else at + n
    return scramble((sums[ends] - sums[at]) * down[at])


class Words:
    """The words of one group's texts, always in the same order."""

    def __init__(self, texts: list[bytes]) -> None:
        buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = SPACE[buf]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(text_ends, starts, side="right").astype(np.int32)
        self.firsts = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = _hashes(buf, starts, ends)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of BLOCK words inside one text: place, hash, and whether it is a block."""
        n = max(0, len(self.hash) - BLOCK + 1)
        at = np.flatnonzero(self.text[:n] == self.text[BLOCK - 1 :]) if n else np.empty(0, np.int64)
        h = _rolling(self.hash, BLOCK)[at] if n else np.empty(0, U)
        return at, h, (at - self.firsts[self.text[at]]) % BLOCK == 0

    def around(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of WINDOW words that hold one of these blocks: place and two hashes."""
        at = (blocks[:, None] - np.arange(WINDOW - BLOCK, -1, -1)).ravel()
        at = at[at >= np.repeat(self.firsts[self.text[blocks]], WINDOW - BLOCK + 1)]
        at = at[at + WINDOW <= self.firsts[self.text[at] + 1]]
        if not len(at):
            return at, np.empty(0, U), np.empty(0, U)
        return at, _rolling(self.hash, WINDOW, at), _rolling(scramble(self.hash ^ U(BASE)), WINDOW, at)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """floor(h / 2^64 * parts); the fraction is h * parts modulo 2^64 and grows with h inside a part."""
    p, low = U(parts), U(0xFFFFFFFF)
    return (((h >> U(32)) * p + (((h & low) * p) >> U(32))) >> U(32)).astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that occur in an ascending array."""
    edges = np.searchsorted(part, np.arange(parts + 1))
    return [(int(p), int(edges[p]), int(edges[p + 1])) for p in np.flatnonzero(np.diff(edges))]


def _texts(docs: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
    docs = docs.sort_values(["doc_id", "text"], kind="stable", na_position="first").reset_index(drop=True)
    return docs, [b"" if t is None else bytes(t) for t in docs["text"]]


def _distinct(h: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes, and their flags: a block has it, several windows have it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    flag = np.where(np.diff(np.append(first, len(s))) > 1, SEVERAL, 0)
    if len(first):
        flag += np.maximum.reduceat(aligned[order].astype(np.int64), first) * ALIGNED
    return s[first], flag


def _send(parts: int) -> Callable:
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        _, h, aligned = Words(_texts(docs)[1]).probes()
        h, flag = _distinct(h, aligned)
        packed = ((h * U(parts)) >> (U(64) - KEY) << U(2)) | flag.astype(U)
        raw = packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        rows = [(p, key[0], a, raw[a:b].tobytes()) for p, a, b in _by_part(_part(h, parts), parts)]
        return pd.DataFrame(rows, columns=["part", "bucket", "first", "probes"])

    return run


def _probe(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each group, which of its entries are blocks that also start at another place."""
    rows = rows.sort_values("bucket", kind="stable").reset_index(drop=True)
    each = []
    for b in rows["probes"]:
        wide = np.zeros((len(b) // 5, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
        each.append(wide.view("<u8").ravel())
    x = np.concatenate(each)
    blocks = np.unique(x[x & U(ALIGNED) > 0] >> U(2))
    k = np.searchsorted(blocks, x >> U(2))
    there = k < len(blocks)
    there[there] = blocks[k[there]] == x[there] >> U(2)
    places = np.bincount(k[there], 1 + (x[there] & U(SEVERAL) > 0), minlength=len(blocks))
    out = []
    for bucket, first, x in zip(rows["bucket"], rows["first"], each, strict=True):
        own = np.flatnonzero(x & U(ALIGNED) > 0)
        hit = own[places[np.searchsorted(blocks, x[own] >> U(2))] > 1]
        if len(hit):
            out.append((bucket, (hit + first).astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["bucket", "hits"])


def _runs(starts: np.ndarray) -> bytes:
    """Ascending numbers as runs of neighbours."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(starts)), bool), np.diff(starts) != 1)))
    out = np.zeros(len(first), dtype=STARTS)
    out["start"], out["n"] = starts[first], np.diff(np.append(first, len(starts)))
    return out.tobytes()


def _extend(parts: int) -> Callable:
    def run(key: tuple, docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(docs) and len(hits):
            words = Words(_texts(docs)[1])
            at, h, aligned = words.probes()
            hit = np.unique(h)[np.concatenate([np.frombuffer(b, "<u4") for b in hits["hits"]])]
            at, a, b = words.around(at[aligned][np.isin(h[aligned], hit)])
            b = b >> U(32)
            order = np.lexsort((b, a))
            at, a, b = at[order], a[order], b[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            known = np.sort(at[np.repeat(n > 1, n)])
            if len(known):
                rows.append((-1, key[0], _runs(known)))
            out = np.zeros(len(first), dtype=EXTENDED)
            out["a"], out["b"] = a[first] * U(parts), b[first]
            out["start"] = np.where(n > 1, NOWHERE, at[first])
            rows += [(p, key[0], out[i:j].tobytes()) for p, i, j in _by_part(_part(a[first], parts), parts)]
        return pd.DataFrame(rows, columns=["part", "bucket", "data"])

    return run


def _repeats(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each group, where its extended hits start that another group has too."""
    rows = rows.sort_values("bucket", kind="stable").reset_index(drop=True)
    each = [np.frombuffer(b, EXTENDED) for b in rows["data"]]
    x = np.concatenate(each)
    owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
    order = np.lexsort((x["b"], x["a"]))
    a, b = x["a"][order], x["b"][order]
    twin = np.zeros(len(order), dtype=bool)
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twin[1:] |= same
    twin[:-1] |= same
    found = order[twin]
    found = np.sort(found[x["start"][found] != NOWHERE])  # those are known to their group
    edges = np.searchsorted(owner[found], np.arange(len(each) + 1))
    some = np.flatnonzero(np.diff(edges))
    data = [_runs(np.sort(x["start"][found[edges[i] : edges[i + 1]]].astype(np.int64))) for i in some]
    return pd.DataFrame({"bucket": rows["bucket"].to_numpy()[some], "data": data}, columns=["bucket", "data"])


def _remove(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    docs, texts = _texts(docs)
    lists = [t.split() for t in texts]  # at the six ASCII white spaces
    firsts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    cover = np.zeros(firsts[-1] + WINDOW + 1, dtype=np.int64)
    for b in told["data"]:
        r = np.frombuffer(b, STARTS)
        np.add.at(cover, r["start"], 1)  # a run of n windows covers n + 34 words
        np.add.at(cover, r["start"].astype(np.int64) + r["n"] + (WINDOW - 1), -1)
    kept = np.cumsum(cover)[: firsts[-1]] == 0
    out = []
    for doc_id, words, i, j in zip(docs["doc_id"], lists, firsts[:-1], firsts[1:], strict=True):
        left = kept[i:j]
        out.append((doc_id, len(words), int((~left).sum()), b" ".join(compress(words, left.tolist())).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by spaces), one row for each row of ``docs``.

    All places of a repeated window go, in one document or several. A null, empty or blank text has no words; one of under
    35 loses none. Rows that repeat lose all windows, whatever their doc_ids; null doc_ids stay null. Very long texts are
    taken whole; an empty table gives no rows. Further columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(shuffle_partitions(spark), size // PART))
    # Rows without a doc_id are grouped by text; the doc_id of a group says nothing about what repeats.
    bucket = F.coalesce(F.floor(F.col("doc_id") / BUCKET), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), bucket.alias("bucket"))
    by_bucket = rows.groupBy("bucket")
    sent = by_bucket.applyInPandas(_send(parts), "part int, bucket long, first long, probes binary")
    with Scratch(spark) as scratch:
        hits = scratch.cut(sent.groupBy("part").applyInPandas(_probe, "bucket long, hits binary"))
        extended = scratch.cut(by_bucket.cogroup(hits.groupBy("bucket")).applyInPandas(_extend(parts), "part int, bucket long, data binary"))
        met = extended.where("part >= 0").groupBy("part").applyInPandas(_repeats, "bucket long, data binary")
        told = cut(extended.where("part < 0").select("bucket", "data").unionByName(met))
    out = by_bucket.cogroup(told.groupBy("bucket")).applyInPandas(_remove, "doc_id string, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    return remove_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The textbook form: every window of 35 words with the number of places that it starts at.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS places FROM s) WHERE places > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, {WINDOW}) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
"""
