"""Toxicity by weak supervision.

Voters look at a text: lexicons of insults, lexicons mined from labelled training rows (words, and beginnings of words of
3, 4 and 5 letters, as inflected insults share a stem), and patterns. A generative label model estimates by EM how often
each voter fires on toxic and on clean texts, and how voters correlate given the class; correlated voters share their
weight. Its posterior labels train a linear classifier over the presence of words and stems, which scores every document.

Learning uses at most ``max_train`` labelled rows, those whose hashed doc_id is smallest, and never rows whose
crc32(doc_id) mod 5 is 0. Scores see the text only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Defaults of the parameters of ``train``: labelled rows learnt from, and features of the classifier, those that tell the
#: classes apart best, by a log-likelihood ratio (12 comes about by chance once in 2,000).
MAX_TRAIN, MAX_FEATURES, MIN_GAIN = 20_000, 4_000, 12.0
WORD = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5)
#: Words whose features a worker keeps; the table starts anew when full.
KEPT_WORDS = 400_000

# General insults by language.
LEXICONS = {
    "en": "idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb jerk bastard imbecile vermin filth retard hate kill".split(),
    "fr": "idiot imbécile crétin connard salaud abruti débile ordure minable".split(),
    "de": "idiot dummkopf trottel arschloch abschaum wertlos erbärmlich versager".split(),
    "es": "idiota imbécil estúpido basura escoria patético inútil payaso".split(),
}
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}"),
    "exclaiming": re.compile(r"!!"),
    "you_are": re.compile(r"(?i)\b(?:you|u)(?:'re| are)? (?:an? )?\w+(?:ing)? (?:idiot|moron|loser|clown)"),
    "masked": re.compile(r"\b\w+[*@#$]+\w+\b"),
    "repeating": re.compile(r"\b(\w+)(?: \1\b){4}"),
}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def word_features(word: str) -> list[str]:
    return ["w" + word, *[f"{k}{word[:k]}" for k in STEMS if len(word) >= k]]


def _train_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        feats, votes = [], []
        for text in batch["text"]:
            words = set(WORD.findall(text.lower()))
            feats.append(sorted({f for w in words for f in word_features(w)}))
            votes.append([int(not words.isdisjoint(x)) for x in LEXICONS.values()] + [int(p.search(text) is not None) for p in PATTERNS.values()])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "features": feats, "votes": votes})


def _gain(a: Column, n: Column, pos: float, neg: float) -> Column:
    """Log-likelihood ratio of a feature that occurs in a of pos toxic and n - a of neg clean rows; 0 if it speaks for clean."""
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share, whole = n / F.lit(pos + neg), F.lit(pos + neg)
    b, c, d = n - a, F.lit(pos) - a, F.lit(neg) - n + a
    g = 2 * (term(a, share * pos) + term(b, share * neg) + term(c, (1 - share) * pos) + term(d, (1 - share) * neg))
    return F.when((a * neg > b * pos) & (n < whole), g).otherwise(0.0)


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of being toxic. ``votes``: 0/1 by row and voter; ``gold``: 0/1, itself a voter that starts as reliable.

    EM over per-class firing rates. Given the class, a voter's weight is divided by one plus the sum of its positive
    correlations with the other voters, so a family that fires together counts about once.
    """
    v = np.column_stack([votes, gold]).astype(float)
    q = np.where(gold == 1, 0.95, 0.05)
    for _ in range(rounds):
        prior = min(max(q.mean(), 1e-4), 1 - 1e-4)
        rates, tilt = [], np.ones(v.shape[1])
        for weight in (q, 1 - q):
            rate = (weight @ v + 0.5) / (weight.sum() + 1.0)
            rates.append(rate)
            off = (v - rate) * np.sqrt(weight)[:, None]
            cov = off.T @ off
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = cov / np.outer(sd, sd)
            rho[rho < 0.2] = 0  # weaker ones are noise of the estimate
            np.fill_diagonal(rho, 0)
            rho[:, -1] = rho[-1, :] = 0
            tilt = np.maximum(tilt, 1 + rho.sum(axis=1))
        one, zero = rates
        score = math.log(prior / (1 - prior)) + (v * (np.log(one / zero) / tilt)).sum(axis=1) + ((1 - v) * (np.log((1 - one) / (1 - zero)) / tilt)).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            return new
        q = new
    return q


def fit_linear(rows: list[np.ndarray], q: np.ndarray, size: int, l2: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; rows hold the indices of present features."""
    n = len(rows)
    index = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    w, b = np.zeros(size), math.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3))
    scale = 1 + np.bincount(index, minlength=size) / n * max(1.0, np.mean([len(r) for r in rows]) if n else 1)
    rate, vw, vb = 2.0, np.zeros(size), 0.0
    for t in range(steps):
        look, lb = w + 0.9 * vw, b + 0.9 * vb
        z = np.bincount(owner, weights=look[index], minlength=n) + lb
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) / n
        gw = np.bincount(index, weights=e[owner], minlength=size) + l2 * look / n
        vw, vb = 0.9 * vw - rate * gw / scale * 4, 0.9 * vb - rate * e.sum()
        w, b = w + vw, b + vb
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, min_gain: float = MIN_GAIN) -> tuple[dict[str, float], float]:
    """Weights of features, and the bias. Without labels of both classes, the lexicons alone decide."""
    fallback = {"w" + w: 4.0 for x in LEXICONS.values() for w in x}, -3.0
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of a number each, so the broadcast is bounded.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").mapInPandas(_train_rows, "doc_id long, toxic int, features array<string>, votes array<int>").persist()
    try:
        pos, n = rows.agg(F.sum("toxic"), F.count("*")).first()
        if not n or not pos or pos == n:
            return fallback
        counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("a >= 2")
        best = counts.withColumn("gain", _gain(F.col("a"), F.col("n"), float(pos), float(n - pos))).where(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "f").limit(max_features).collect()
        names = [r["f"] for r in best]
        table = {f: i for i, f in enumerate(names)}
        known = frozenset(names)

        def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(features=[[f for f in x if f in known] for x in b["features"]])

        got = rows.mapInPandas(only, rows.schema).orderBy("doc_id").toPandas()
    finally:
        rows.unpersist()
    present = [np.array([table[f] for f in x], dtype=np.int64) for x in got["features"]]
    sure = [i for i, r in enumerate(best) if r["a"] / r["n"] >= 0.9]
    families = {k: np.array([i for i in sure if names[i][0] == k], dtype=np.int64) for k in ("w", *map(str, STEMS))}
    mined = np.column_stack([[int(np.isin(x, ids).any()) for x in present] for ids in families.values()])
    gold = got["toxic"].to_numpy()
    q = label_model(np.column_stack([np.array(got["votes"].tolist()), mined]), gold)
    w, b = fit_linear(present, q, len(names))
    return {f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b)


def scorer(weights: dict[str, float], bias: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch["_text"]:
                present: set[str] = set()
                for w in set(WORD.findall(text.lower())):
                    hits = seen.get(w)
                    if hits is None:
                        hits = tuple(f for f in word_features(w) if f in weights)
                        if len(w) <= 40:
                            if len(seen) >= KEPT_WORDS:
                                seen.clear()
                            seen[w] = hits
                    if hits:
                        present.update(hits)
                z = bias + math.fsum(weights[f] for f in present)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            out = batch.drop(columns="_text")
            out["score"] = scores
            yield out

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5), one row for each row of ``docs``, repeated ones too.

    A null text counts as empty; a null doc_id is not held out; very long texts are scored whole; an empty table gives no
    rows; without labels of both classes lexicons decide. Further columns are not read, whatever their names.
    """
    weights, bias = train(docs, labels, max_train)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_or_empty().alias("_text"))
    scored = rows.mapInPandas(scorer(weights, bias), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; the others pass unchanged, repeated ones too, with all their columns.

    A null or empty text is scored by the bias alone, very long ones whole; an empty table stays empty; without labels of
    both classes lexicons decide.
    """
    weights, bias = train(docs, labels)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in scorer(weights, bias)(pd.DataFrame({"_text": t}) for t in texts):
            yield t["score"]

    return docs.where(score(text_or_empty()) < 0.5)
