"""Very common passages, against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenframe.llm import line_dedup
from lumenframe.llm import substring_dedup as sd
from tests.llm.test_free import brute_removed
from tests.llm.test_native import brute_lines


def test_line_in_thousands_of_contexts(spark):
    """Its gram is split: no part gets many entries of one gram, and the rows are those of brute force."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = [noise(49), noise(40), noise(62)]
    texts = [noise(rng.randint(0, 60)) + shared[i % 3] + (rng.choice("XYZ") if i % 5 else "") + noise(rng.randint(0, 60)) for i in range(4000)]
    texts[7] = texts[3000] = None
    ids = [16 * i for i in range(4000)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    rows = docs.withColumn("bucket", F.floor(F.col("doc_id") / sd.BUCKET))
    hot = sd.hot_grams(rows, 256)
    assert len(hot)
    sent = [np.frombuffer(r.entries, sd.ENTRIES)["a"] for r in rows.groupBy("bucket").applyInPandas(sd._send(8, hot), "part int, bucket long, first long, entries binary").collect()]
    assert pd.Series(np.concatenate(sent)).value_counts().max() < 512
    got = {}
    for r in sd.remove_repeats(docs, bound=256).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()))
    want = brute_removed(ids, texts)
    assert sum(w[0][1] for w in want.values()) > 0 and got == {i: sorted(v) for i, v in want.items()}


def test_most_common_lines_are_dealt_out(spark, monkeypatch):
    """Lines of every document go by several keys, with the decisions of brute force."""
    monkeypatch.setattr(line_dedup, "OFTEN", 20)
    monkeypatch.setattr(line_dedup, "COMMON", 2)
    rng = random.Random(6)
    every, many = "All rights are reserved by the authors of this", "This is a line that many documents carry along"
    texts = []
    for i in range(150):
        lines = [every if i % 7 else every[:-1] + "x", f"own line number {rng.randrange(10**9)} of its kind", "ok", ""] + [many] * (i % 3 == 0)
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    got = {(r.doc_id, r.line_no, r.keeper_doc_id, r.keeper_line_no, r.kept) for r in line_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_lines(texts)
