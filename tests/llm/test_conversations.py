"""Conversation repair against a search over all edits, and on odd rows and long conversations."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

from lumenframe.llm.conversations import damage, digest, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, n string, kind string, same string, first long, stretch long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def search(rows):
    """The cheapest, then ASCII-least, edits by Dijkstra over (rows done, initials as a state): the definition, no matrices."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, end, lines = heapq.heappop(heap)
        if k == len(rows) and end in ("", "a"):
            return cost, audit, lines
        if (k, end) in done:
            continue
        done.add((k, end))

        def put(role, extra, letter, text, step, cost=cost, audit=audit, k=k, end=end, lines=lines):
            if {"": "su", "s": "u", "u": "a", "a": "u"}[end].count(role[:1]) and role:
                heapq.heappush(heap, (cost + extra, audit + letter, k + step, role[0], (*lines, f"{role}:{text}")))

        for role in ("user", "assistant"):
            put(role, 5, "I", "", 0)
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, end, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                put(role, more, "K", text, 1)
                for new in ("user", "assistant"):
                    put(new, 1 + more, "R", text, 1)


def brute(original):
    key = lambda x: (x is not None, x or 0)
    out, rows = {}, damaged(original)
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (key(r[1]), r[2].encode(), r[3].encode()))
        seen, told = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        cost, audit, lines = search(told)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        count = [sum(f == x for _, _, f in told) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def held(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def some_rows(n, turns, seed):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No!", "why", "", None, " \t", "é?\n", "a.b", "\x1c", "ok. "]
    for conv in range(n):
        at = 0
        for _ in range(rng.randrange(turns)):
            at += rng.choice((0, 1, 1, 1, 3))
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "agent"])
            out.append((None if conv == 5 else conv, None if rng.random() < 0.1 else at, role, rng.choice(texts)))
    return out


def test_against_search(spark):
    rows = some_rows(150, 9, 1) + [(1000 + k, None, None, None) for k in range(60)] + [(2000, 4, "user", "Repeated row.")] * 5
    got = held(digest(frame(spark, rows).repartition(3)))
    assert got == brute(rows)
    assert any(g[:1] + g[5:7] == (0, 0, "") for g in got.values())
    assert digest(frame(spark, rows).limit(0)).count() == 0


def test_long_conversations_meet_across_partitions(spark):
    rng = random.Random(3)
    long = [(1, k // 2, rng.choice(["user", "assistant", "system"]), f"{rng.choice('abc')} {k % 700}{rng.choice(['.', '', '!'])}") for k in range(4000)]
    same = [(2, k, "user", "Again.") for k in range(3000)]
    rows = long + same + [(3, k, "user" if k % 2 == 0 else "assistant", "word " * 40_000 + "end.") for k in range(6)] + some_rows(40, 5, 8)
    rows = [r for r in rows if r[0] is not None]
    got, want = held(digest(frame(spark, rows).repartition(7))), brute(rows)
    assert got == want


def test_repaired_turns(spark):
    rows = damage(frame(spark, [(7, 0, "assistant", "Hello."), (7, 1, "assistant", "There!"), (7, 2, "user", "Cut off"), (8, 0, None, None)]))
    found, _ = repair(rows)
    turns = [(r.conv_id, r.role) for r in repaired_turns(rows).orderBy("conv_id", "stretch", "position").collect()]
    assert all([role for _, role in g][:1] in (["user"], ["system"]) for _, g in groupby(turns, key=lambda x: x[0]))
    assert {r.conv_id for r in found.collect()} == {7, 8}
