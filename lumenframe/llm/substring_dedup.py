"""Exact substring dedup: bytes covered by a 50-byte string that also starts in an earlier document are removed.

Suffix arrays are built in shards, and a shard only gets bytes that can repeat. In each document, every 50-byte string
names the 16-byte gram of smallest hash inside it as its anchor, so equal strings name equal grams at equal places. The
strings of an anchor follow each other; its context is the bytes that they lie in, 84 at most. Anchors meet by gram hash:

* equal contexts: all strings of the later documents repeat, decided by 128 bits, of the gram's hash and the context's;
* different contexts that agree on the gram and 17 more bytes on one side: one copy of each context goes to the gram's
  shard, where a suffix array by induced sorting and permuted common prefixes tell which of its strings start in an
  earlier document's context;
* all others cannot share a 50-byte string.

A gram in very many entries would fill one task. A sample of the groups finds such grams, and only decides their way: each
string in their contexts goes by its own hash, its smallest document comes from an aggregate, and no task gets a whole gram.

Documents travel in groups of neighbouring ids; a group sends each different pair of gram and context once, so a passage
that many documents share is counted before it is shuffled. Everything is packed in binary columns and worked on by numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, shuffle_partitions
from .shingles import U, powers, scramble
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
SIDE = WINDOW - 1
HALF = WINDOW // 2
BUCKET = 128
POSITION = (1 << 28) - 1
SEGMENT = 1 << 22  # longer texts are worked on in segments of so many bytes
PART = 4 << 20  # bytes of text whose anchors meet in one part, about
HOT, SAMPLE = 1 << 15, 16  # entries from which a gram is split; one group of so many is counted
FEW = 200_000  # so many repeated strings, of three numbers each, are broadcast

ENTRIES = np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<u2"), ("l", "<u2"), ("r", "<u2")])
REPLIES = np.dtype([("entry", "<u4"), ("flag", "u1")])
CONTEXTS = np.dtype([("entry", "<u4"), ("doc", "<u2"), ("n", "u1")])
MASKS = np.dtype([("entry", "<u4"), ("mask", "<u8")])
FULL, UNSURE = 1, 2


class Anchors:
    """Anchors of the texts of one group, and their different (gram, context) pairs, always in the same order."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], parts: int, hot: np.ndarray, chunk: int = 1 << 19) -> None:
        self.buf = np.frombuffer(b"".join(texts) or b"\0", dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.rank = np.unique(ids, return_inverse=True)[1]
        found, i = [], 0
        while i < len(size):  # whole texts, about half a megabyte at a time; the strings of very long ones in segments
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + chunk, side="right")))
            for s in range(int(self.starts[i]), int(self.ends[j - 1]) - LENGTH + 1, SEGMENT if size[i] > SEGMENT else 1 << 62):
                found.append(self._anchors(i, j, s, min(s + SEGMENT + LENGTH - 1, int(self.ends[j - 1]))))
            i = j
        none = np.empty(0, np.int64)
        self.at, self.low, self.high, text, self.begin, self.end = (np.concatenate([f[k] for f in found] or [none]) for k in range(6))
        gram, context, left, right = (np.concatenate([f[k] for f in found] or [none.astype(U)]) for k in range(6, 10))
        self.doc = self.rank[text]
        # The part follows from the gram's high bits, so this order is by part too; equal pairs stay in document order.
        # Entries of hot grams come last, in a part of their own that is not sent.
        order = np.lexsort((context, gram, np.isin(gram, hot))) if len(hot) else np.lexsort((context, gram))
        g, c, d = gram[order], context[order], self.doc[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.low_doc = d[first]
        self.one = o = order[first]  # an occurrence in the smallest document
        several = d[np.append(first[1:], len(d)) - 1] > self.low_doc if len(first) else np.empty(0, bool)
        out = np.zeros(len(first), dtype=ENTRIES)
        out["a"], out["c"] = gram[o], context[o]
        out["doc"] = self.low_doc | (several.astype(np.int64) << 15)
        out["l"], out["r"] = left[o], right[o]
        self.entries, self.part = out, ((gram[o] >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        self.gram = gram[o]
        if len(hot):
            self.part[np.isin(self.gram, hot)] = parts

    def _anchors(self, i: int, j: int, s: int, e: int) -> tuple[np.ndarray, ...]:
        t, n = self.buf[s:e], e - s
        starts, ends = np.clip(self.starts[i:j], s, e) - s, np.clip(self.ends[i:j], s, e) - s
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum((t.astype(U) + U(1)) * up[:n], out=sums[1:])
        grams = n - GRAM + 1
        h = scramble((sums[GRAM:] - sums[:grams]) * down[:grams])
        m, span = (h & ~U(POSITION)) | np.arange(grams, dtype=U), 1
        while span * 2 <= WINDOW:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < WINDOW:
            m = np.minimum(m[: len(m) - (WINDOW - span)], m[WINDOW - span :])
        inside = np.zeros(n + 1, dtype=np.int8)  # places where a string of a text starts that ends in it
        long = ends - starts >= LENGTH
        inside[starts[long]] = 1
        inside[ends[long] - LENGTH + 1] -= 1
        valid = np.flatnonzero(np.cumsum(inside[: len(m)], dtype=np.int8))
        at = (m[valid] & U(POSITION)).astype(np.int64)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
        a, low, high = at[first], valid[first], valid[np.append(first[1:], len(at)) - 1] if len(at) else at
        text = np.searchsorted(ends, a, side="right")
        hashed = lambda b, x: scramble((sums[x] - sums[b]) * down[b] + (x - b).astype(U))
        begin, end = low, high + LENGTH
        short = lambda b, x, has: np.where(has, (hashed(np.where(has, b, 0), np.where(has, x, 0)) & U(0xFFFE)) + U(1), U(0))
        left, right = short(a - HALF, a + GRAM, low <= a - HALF), short(a, a + GRAM + HALF, high >= a - HALF)
        context = scramble(hashed(begin, end) + (a - begin).astype(U) * U(0x9E3779B97F4A7C15))
        gram = h[a] * U(0x9E3779B97F4A7C15)  # anchors have small hashes; their high bits, which choose the part, are dealt anew
        return a + s, low + s, high + s, text + i, begin + s, end + s, gram, context, left, right


def _group(key: tuple, docs: pd.DataFrame, parts: int, hot: np.ndarray) -> Anchors:
    return Anchors(docs["doc_id"].to_numpy(), [(t or "").encode("utf-8") for t in docs["text"]], parts, hot)


def _sorted(docs: pd.DataFrame) -> pd.DataFrame:
    return docs.sort_values(["doc_id", "text"], kind="stable", na_position="first").reset_index(drop=True)


def _send(parts: int, hot: np.ndarray) -> Callable:
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        x = _group(key, _sorted(docs), parts, hot)
        edges = np.searchsorted(x.part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edges))
        return pd.DataFrame({"part": some.astype(np.int32), "bucket": key[0], "first": edges[some], "entries": [x.entries[edges[p] : edges[p + 1]].tobytes() for p in some]}, columns=["part", "bucket", "first", "entries"])

    return run


def _meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each group, the entries whose context an earlier group has (FULL), and those that may share a string with another context (UNSURE)."""
    rows = rows.sort_values("bucket", kind="stable").reset_index(drop=True)
    each = [np.frombuffer(b, ENTRIES) for b in rows["entries"]]
    e = np.concatenate(each)
    size = np.array([len(x) for x in each])
    owner = np.repeat(np.arange(len(each)), size)
    number = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(rows["first"].to_numpy(), size)
    order = np.lexsort((e["c"], e["a"]))  # stable, so that groups stay in their order
    a, c = e["a"][order], e["c"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    flag = np.zeros(len(order), dtype=np.uint8)
    flag[~new] = FULL
    heads = np.flatnonzero(new)  # one for each context, in its earliest group
    for side in ("l", "r"):
        half = e[side][order[heads]]
        has = np.flatnonzero(half > 0)
        k = heads[has]
        key2 = a[k] * U(0x9E3779B97F4A7C15) + half[has]  # one too many that seems equal only means more work
        by = np.argsort(key2, kind="stable")
        s = key2[by]
        twin = np.zeros(len(s), dtype=bool)
        twin[1:] |= s[1:] == s[:-1]
        twin[:-1] |= s[1:] == s[:-1]
        flag[k[by[twin]]] |= UNSURE
    told = order[flag > 0]
    told = told[np.argsort(told)]
    back = np.empty(len(order), dtype=np.uint8)
    back[order] = flag
    reply = np.zeros(len(told), dtype=REPLIES)
    reply["entry"], reply["flag"] = number[told], back[told]
    edges = np.searchsorted(owner[told], np.arange(len(each) + 1))
    some = np.flatnonzero(np.diff(edges))
    return pd.DataFrame({"bucket": rows["bucket"].to_numpy()[some], "kind": np.int32(0), "data": [reply[edges[i] : edges[i + 1]].tobytes() for i in some]}, columns=["bucket", "kind", "data"])


def _flags(x: Anchors, rows: pd.DataFrame) -> np.ndarray:
    flags = np.zeros(len(x.entries), dtype=np.uint8)
    for b in rows.loc[rows["kind"] == 0, "data"]:
        r = np.frombuffer(b, REPLIES)
        flags[r["entry"]] = r["flag"]
    return flags


#: What a group sends in the second pass: contexts to the shards, and, with part -1, the strings of hot grams.
ASKED = "part int, bucket long, data binary, entry array<long>, k array<int>, gram array<long>, string array<long>, doc array<long>"
NAMES = [x.split()[0] for x in ASKED.split(", ")]


def _contexts(parts: int, hot: np.ndarray) -> Callable:
    def run(key: tuple, docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=NAMES)
        if not len(docs) or not (len(replies) or len(hot)):
            return out
        docs = _sorted(docs)
        x = _group(key, docs, parts, hot)
        rows = []
        ask = np.flatnonzero(_flags(x, replies) & UNSURE)
        if len(ask):
            one = x.one[ask]
            data = np.zeros(len(ask), dtype=CONTEXTS)
            data["entry"], data["doc"], data["n"] = ask, x.low_doc[ask], x.end[one] - x.begin[one]
            edges = np.searchsorted(x.part[ask], np.arange(parts + 1))
            n = data["n"].astype(np.int64)
            to = np.cumsum(n)
            raw = x.buf[np.arange(to[-1]) + np.repeat(x.begin[one] - to + n, n)]
            to = np.concatenate(([0], to))
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                rows.append((p, key[0], np.uint32(b - a).tobytes() + data[a:b].tobytes() + raw[to[a] : to[b]].tobytes(), *[None] * 5))
        if (x.part == parts).any():
            rows.append((-1, key[0], None, *_strings(x, docs, parts)))
        return pd.DataFrame(rows, columns=NAMES) if rows else out

    return run


def _repeats(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each context of the shard, a mask of the strings in it that also start in an earlier document's context."""
    rows = rows.sort_values("bucket", kind="stable").reset_index(drop=True)
    heads, raws = [], []
    for b in rows["data"]:
        n = int(np.frombuffer(b, "<u4", 1)[0])
        heads.append(np.frombuffer(b, CONTEXTS, n, 4))
        raws.append(np.frombuffer(b, np.uint8, -1, 4 + n * CONTEXTS.itemsize))
    h, raw = np.concatenate(heads), np.concatenate(raws)
    owner = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
    n = h["n"].astype(np.int32)
    of = np.repeat(np.arange(len(h), dtype=np.int32), n + 1)  # each context, and a 0 behind it
    start = np.cumsum(n + 1) - n - 1
    inside = np.arange(len(of), dtype=np.int32) - start[of]
    text = np.zeros(len(of), dtype=np.uint16)
    text[inside < n[of]] = raw.astype(np.uint16) + np.uint16(1)
    room = inside + LENGTH <= n[of]  # where a whole string starts
    sa = suffix_array(text)
    joins = common_prefixes(text, sa, 63, room)[sa] >= LENGTH
    run = np.cumsum(~joins) - 1
    order = (owner * (1 << 15) + h["doc"])[of[sa]]
    usable = room[sa]
    least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run[usable], order[usable])
    hit = sa[usable & (order > least[run])]
    mask = np.zeros(len(h), dtype=U)
    np.bitwise_or.at(mask, of[hit], U(1) << inside[hit].astype(U))
    some = np.flatnonzero(mask)
    out = np.zeros(len(some), dtype=MASKS)
    out["entry"], out["mask"] = h["entry"][some], mask[some]
    edges = np.searchsorted(owner[some], np.arange(len(heads) + 1))
    full = np.flatnonzero(np.diff(edges))
    return pd.DataFrame({"bucket": rows["bucket"].to_numpy()[full], "kind": np.int32(1), "data": [out[edges[i] : edges[i + 1]].tobytes() for i in full]}, columns=["bucket", "kind", "data"])


def _counts(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
    gram, n = np.unique(_group(key, _sorted(docs), 1, np.empty(0, U)).gram, return_counts=True)
    return pd.DataFrame({"gram": gram.view(np.int64), "n": n})


def hot_grams(rows: DataFrame, bound: int) -> np.ndarray:
    """Grams with so many entries that they are split, as a sample of the groups tells. Either way gives the same rows."""
    some = rows.where(F.pmod(F.xxhash64("bucket"), F.lit(SAMPLE)) == 0)
    counts = some.groupBy("bucket").applyInPandas(_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(bound // SAMPLE, 2)).select("gram").collect()  # few: each has many entries
    return np.array([r.gram for r in found], dtype=np.int64).view(U)


def _strings(x: Anchors, docs: pd.DataFrame, parts: int) -> tuple[np.ndarray, ...]:
    """Each string in a context of a hot gram: entry, place, gram, hash, and the smallest document of the group that has the context."""
    ask = np.flatnonzero(x.part == parts)
    one = x.one[ask]
    n = x.end[one] - x.begin[one]
    raw = x.buf[np.minimum(x.begin[one][:, None] + np.arange(SIDE + LENGTH), len(x.buf) - 1)]
    up, down = powers(SIDE + LENGTH + 1)
    sums = np.zeros((len(ask), SIDE + LENGTH + 1), dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * up[: SIDE + LENGTH], axis=1, out=sums[:, 1:])
    h = scramble((sums[:, LENGTH:] - sums[:, : SIDE + 1]) * down[: SIDE + 1])
    i, k = np.nonzero(np.arange(SIDE + 1) + LENGTH <= n[:, None])
    low = np.unique(docs["doc_id"].to_numpy())[x.low_doc[ask]]
    return ask[i], k.astype(np.int32), x.gram[ask][i].view(np.int64), h[i, k].view(np.int64), low[i]


def _masks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(len(rows), dtype=MASKS)
    out["entry"], out["mask"] = rows["entry"].to_numpy(), rows["mask"].to_numpy().astype(U)
    return pd.DataFrame({"bucket": [key[0]], "kind": np.int32(1), "data": [out.tobytes()]})


def _split(asked: DataFrame, scratch: Scratch) -> DataFrame:
    """The masks of hot grams' contexts, as ``_repeats`` gives them for the others."""
    listed = asked.where("part = -1").select("bucket", F.arrays_zip("entry", "k", "gram", "string", "doc").alias("x"))
    strings = listed.select("bucket", F.inline("x"))
    of = ["gram", "string"]
    least = scratch.cut(strings.groupBy(*of).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"))
    # Both sides are tables of their own, so that Spark can split the rows of a string in many entries.
    met = strings.join(F.broadcast(least) if least.count() <= FEW else least, of)
    masks = met.where("doc > least").groupBy("bucket", "entry").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    return masks.groupBy("bucket").applyInPandas(_masks, "bucket long, kind int, data binary")


def _remove(parts: int, hot: np.ndarray) -> Callable:
    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        docs = _sorted(docs)
        x = _group(key, docs, parts, hot)
        flags = _flags(x, told)
        later = x.doc > x.low_doc[x.entry] if len(x.entry) else np.empty(0, bool)
        whole = (flags[x.entry] & FULL > 0) | later
        mark = np.zeros(len(x.buf) + 1, dtype=np.int32)
        mark[x.low[whole]] += 1  # each place is the low or the high end of one anchor only
        mark[x.high[whole] + 1] -= 1
        begins = np.cumsum(mark[:-1]) > 0
        masks = np.zeros(len(x.entries), dtype=U)
        for b in told.loc[told["kind"] == 1, "data"]:
            m = np.frombuffer(b, MASKS)
            masks[m["entry"]] = m["mask"]
        if masks.any():
            some = np.flatnonzero((masks[x.entry] > 0) & ~whole)
            bits = (masks[x.entry[some]][:, None] >> np.arange(SIDE + 1, dtype=U)) & U(1) > 0
            i, k = np.nonzero(bits)
            begins[x.begin[some][i] + k] = True
        cover = np.zeros(len(x.buf) + LENGTH + 1, dtype=np.int32)
        at = np.flatnonzero(begins)
        cover[at] += 1
        cover[at + LENGTH] -= 1
        gone = np.cumsum(cover)[: len(x.buf)] > 0
        out = []
        for doc_id, s, e in zip(docs["doc_id"], x.starts, x.ends, strict=True):
            g = gone[s:e]
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            out.append((doc_id, e - s, int(g.sum()), spans, x.buf[s:e][~g].tobytes()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


def remove_repeats(docs: DataFrame, bound: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), one row for each row of ``docs``.

    A null or empty text has nothing to remove. Rows that share a doc_id are one document: neither is earlier. A null
    doc_id is earlier than all others. Very long texts are taken whole, in segments; an empty table gives no rows.
    Further columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), size // PART)
    rows = docs.select("doc_id", "text", F.coalesce(F.floor(F.col("doc_id") / BUCKET), F.lit(-(1 << 62))).alias("bucket"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    hot = hot_grams(rows, bound)
    by_bucket = rows.groupBy("bucket")
    sent = by_bucket.applyInPandas(_send(parts, hot), "part int, bucket long, first long, entries binary")
    replies = cut(sent.groupBy("part").applyInPandas(_meet, "bucket long, kind int, data binary"))
    with Scratch(spark) as scratch:
        asked = scratch.cut(by_bucket.cogroup(replies.groupBy("bucket")).applyInPandas(_contexts(parts, hot), ASKED))
        masks = asked.where("part >= 0").groupBy("part").applyInPandas(_repeats, "bucket long, kind int, data binary")
        masks = cut(masks.unionByName(_split(asked, scratch)) if len(hot) else masks)
    told = replies.unionByName(masks)
    out = by_bucket.cogroup(told.groupBy("bucket")).applyInPandas(_remove(parts, hot), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The textbook form: each string of 50 bytes with the first document that it starts in.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, b[i : i + {LENGTH - 1}] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
h AS (SELECT doc_id, i FROM s JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM h)),
x AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH - 1} AS e FROM g GROUP BY doc_id, run),
k AS (SELECT x.*, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS after FROM x),
o AS (SELECT doc_id, sum(e - a + 1) AS n, count(*) AS spans, string_agg(hex(b[after : a - 1]), '' ORDER BY a) || hex(any_value(b)[max(e) + 1 :]) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(o.n, 0)::BIGINT AS n_removed, coalesce(o.spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(o.kept), d.b)) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
