"""The filter audit against its definition, document by document and order by order, and on odd rows."""

import re
from collections import Counter
from itertools import permutations

from lumenframe.llm.filter_audit import audit_filters

SCHEMA = "doc_id long, text string, source string, part string, mask int, label int, first string, digest string"
LABELS = "doc_id long, quality int, toxic int, part string"


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    caps = len(re.findall("[A-Z]", text))
    return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * caps > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc_id, text, source in rows:
        fails = {f for f, x in failing(text or "").items() if x}
        key = lambda i: (i is not None, i or 0)
        if any((t or "") == (text or "") and key(i) < key(doc_id) for i, t, _ in rows):
            fails.add("E")
        docs.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total, steps = Counter(), {}
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                steps["".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        out |= {(part, o, s): (*m, total[o[s - 1]]) for (o, s), m in steps.items()}
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", 1, 2, "y", "z") for i, t, s in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, q, t, "w") for i, q, t in labels], LABELS)


def held(df):
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}
    return got


def test_against_definition(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = ["", None, "a b", long, long, long + " #", "A " * 60, long.upper(), long + "\x1c\x85é", "é" * 70, " ".join(["same"] * 60), long + "\t\n" + long, "x" * 300_000, long, "Ab\x00|", "a b"]
    rows = [(None if k == 12 else 7 if k in (3, 13) else k, t, None if k % 5 == 0 else "" if k % 5 == 1 else f"s{k % 3}") for k, t in enumerate(texts)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 16, 2)] + [(None, 1, 1), (4, 1, 1), (6, None, None), (99, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = held(audit_filters(*frames(spark, rows, labels)))
    assert got == brute(rows, labels)
    assert {k[0] for k in got} == {"", "s0", "s1", "s2"} and len(got) == 4 * 600


def test_many_parts_and_none(spark):
    rows = [(k, "one two" if k % 2 else "#", f"p{k}") for k in range(1200)]
    docs, labels = frames(spark, rows, [])
    out = audit_filters(docs.coalesce(1), labels)
    assert out.count() == 1200 * 600 and out.where("part = 'p7' and step = 1 and filter_order like 'E%'").first().removed == 1
    assert audit_filters(docs.limit(0), labels).count() == 0
    assert audit_filters(docs, labels, docs["text"]).select("part").distinct().count() == 2
