"""Repeated passages against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

from lumenframe.llm.passages import WINDOW, digest, remove_passages

SCHEMA = "doc_id long, text string, bucket long, part int, first string, data binary, kept string"


def frame(spark, ids, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", None, "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def brute(texts):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    windows = Counter(tuple(w[i : i + WINDOW]) for w in lists for i in range(len(w) - WINDOW + 1))
    out = []
    for w in lists:
        gone = {i + k for i in range(len(w) - WINDOW + 1) if windows[tuple(w[i : i + WINDOW])] > 1 for k in range(WINDOW)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def some_texts(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [fresh(n) for n in (17, 18, 34, 35, 36, 37, 52, 53, 70, 200)]
    texts = []
    for _ in range(300):  # over several groups of ids
        words = fresh(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            words += rng.choice((p, p[cut:], p[:cut], p[: len(p) // 2] + fresh(1) + p[len(p) // 2 :])) + fresh(rng.randrange(40))
        texts.append(rng.choice((" ", "\n", "\t ", "\x0b")).join(words))
    return texts


def test_against_brute_force(spark):
    loop = "tick " * 36
    texts = some_texts(4) + ["", None, " \n\t ", "one", "a b " * 40, loop, "tick " * 34, "é\x1cß\x85 " * 50, "zz " + " x " * 45]
    texts += [texts[0]] * 140 + ["x" * 3_000_000 + " " + " ".join(f"q{k}" for k in range(300_000))]  # a longest text, more than one segment
    ids = [None if k % 50 == 7 else k // 2 if k % 40 == 3 else k for k in range(len(texts))]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in digest(frame(spark, ids, texts).repartition(5)).collect())
    want = sorted((i is not None, i or 0, *w) for i, w in zip(ids, brute(texts), strict=True))
    assert got == want
    assert sum(w[1] > 0 for w in brute(texts)) > 150


def test_repeats_in_one_document_and_none(spark):
    half = " ".join(f"v{k}" for k in range(50))
    row = remove_passages(frame(spark, [1 << 60], [f"{half} mid {half} end"])).first()
    assert (row.doc_id, row.n_words, row.n_removed, row.kept) == (1 << 60, 102, 100, "mid end")
    assert remove_passages(frame(spark, [], [])).count() == 0
