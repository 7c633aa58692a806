"""The pipeline's stages against brute force, one after the other, on the small table and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import toxicity
from lumenframe.llm.queries import tokenizer_paths
from tests.llm.test_free import brute_components
from tests.llm.test_native import brute_count, brute_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_dedup(rows):
    rows = sorted(rows, key=lambda r: r.doc_id)
    kept = defaultdict(list)
    for i, n, *_, keep in sorted(brute_lines([r.text for r in rows])):
        if keep:
            kept[i].append(n)
    out = {}
    for i, r in enumerate(rows):
        lines = (r.text or "").split("\n")
        left = "\n".join(lines[n] for n in kept[i])
        if len(kept[i]) == len(lines):
            out[r.doc_id] = r.text
        elif re.sub(r"[\n\t\r ]", "", left):
            out[r.doc_id] = left
    return out


def brute_copies(rows):
    chars = Counter()
    for r in rows:
        chars[r.source] += len(r.text or "")
    w = {s: math.sqrt(c) for s, c in chars.items()}
    rate = {s: w[s] / sum(w.values()) * sum(chars.values()) / c if c else 0 for s, c in chars.items()}
    u = lambda r: int(hashlib.md5(f"1:count|{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return {r.doc_id: n for r in rows if (n := brute_count(rate[r.source], u(r)))}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(*_held(stage(spark, out[-1], sf_dir))))
    return out


def _held(df):
    return df.collect(), df.schema


def test_each_stage_against_brute_force(spark, sf_dir, stages):
    docs, clean, lined, single, mixed, packed = [s.collect() for s in stages]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:-1])
    weights, bias = toxicity.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def toxic(text):
        found = {f for w in set(toxicity.WORD.findall(text.lower())) for f in toxicity.word_features(w)}
        return bias + math.fsum(weights[f] for f in found if f in weights) >= 0

    assert {r.doc_id for r in clean} == {r.doc_id for r in docs if not toxic(r.text)}
    assert {r.doc_id: r.text for r in lined} == brute_dedup(clean)
    before = {r.doc_id: r for r in clean}
    assert all(r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text)) for r in lined)
    ids = [r.doc_id for r in lined]
    assert {r.doc_id for r in single} == {i for i, (_, c) in brute_components(ids, [r.text for r in lined]).items() if i == c}
    assert Counter(r.doc_id for r in mixed) == brute_copies(single)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_paths()[0])
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in single}
    got, copies = Counter(), Counter(r.doc_id for r in mixed)
    for r in packed:
        assert r.doc_tokens == want[r.doc_id]
        got[r.doc_id] += r.length
    assert got == {i: want[i] * n for i, n in copies.items()}
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 1024


def test_run_gives_the_stages_rows(spark, sf_dir, stages):
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    pieces = lambda df: rows(df.drop("sequence_id", "offset"))
    assert pieces(corpus_pipeline.run(spark, sf_dir)) == pieces(stages[-1])


def test_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns, and an empty table."""
    long = "many words in one line that goes on " * 3000
    rows = [(1, None, None, None, None), (None, "a text without id", "en", "s", 3), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (4, "x y", "en", None, 3), (4, "x y", "en", None, 3), (4, "other text", "de", "s", 10)]
    frame = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in ("row", "key", "t", "before", "_id", "_gone", "cdf", "node", "score", "n", "shuffle_key")})
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == corpus_pipeline.COLUMNS or name == "packing"
            docs = spark.createDataFrame(*_held(docs))
            if name == "near-duplicates":
                assert docs.count() in (0, 7)
        assert docs.count() == 0 or docs.agg(F.sum("length")).first()[0] > 0  # how often the long text comes is for its rate to say
