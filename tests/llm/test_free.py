"""The operators with Python in their tasks, against brute force, round trips and held-out accuracy, and on odd inputs."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import media, minhash, packing, substring_dedup, toxicity, url_filter
from lumenframe.llm.common import Scratch
from lumenframe.llm.components import components
from lumenframe.llm.queries import tokenizer_paths
from lumenframe.llm.shingles import shingle_sets
from lumenframe.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, keys string, rank int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, "k", 2) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def some_texts(n=120, seed=5):
    """Random prose with exact copies, near copies, shared passages, very long and odd texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [prose(60) for _ in range(4)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            out.append(prose(r.randint(1, 300)))
        elif kind == 1:
            out.append(r.choice(out))
        elif kind == 2:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 3:
            out.append(prose(r.randint(0, 40)) + " " + r.choice(passages) + "\n" + prose(r.randint(0, 40)))
        elif kind == 4:
            out.append("é" * r.randint(0, 90) + prose(5) * 3)
        else:
            out.append(prose(3) + " again" * r.randint(10, 200))
    return [*out, "", "one", "a b c d e", "A B\tc D e", "a b c d", prose(9000), "x" * 30000]


def brute_shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(ids, texts):
    sets = [brute_shingles(t) for t in texts]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(ids[x]), root(ids[y])))
                    parent[b] = a
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("pairs_up_to", [8, 1])
def test_near_duplicates(spark, monkeypatch, pairs_up_to):
    monkeypatch.setattr(minhash, "ALL_PAIRS_UP_TO", pairs_up_to)
    texts = [*some_texts(), None]
    ids = list(range(3, 3 + len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts, ids)).collect()}
    assert got == brute_components(ids, texts)
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs(spark, texts, ids)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}
    assert minhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0
    assert minhash.drop_near_duplicates(docs(spark, ["a", "a"], [None, None])).count() == 2
    twice = docs(spark, ["one two", "three four", "one two", "one two"], [4, 4, 9, None])
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_duplicates(twice).collect()) == [(0, 1, 0, True), (4, 1, 4, True), (4, 1, 4, True), (9, 1, 4, False)]
    assert minhash.drop_near_duplicates(twice).count() == 3


def test_near_duplicates_on_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = frame.orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute_components([r.doc_id for r in rows], [r.text for r in rows])


def test_long_words_built_to_collide():
    """Thue-Morse words have equal polynomial hashes modulo 2^64, whatever the base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 12))
    a, b = shingle_sets([f"{w} one two three four" for w in (word, word.translate(str.maketrans("ab", "ba")))])
    assert len(a) == len(b) == 1 and a[0] != b[0]
    assert (shingle_sets([word.upper()])[0] == shingle_sets([word])[0]).all()


def test_signature_of_small_sets():
    s = minhash.signature(np.array([7], dtype=np.uint64))
    assert (s == 7).all()
    big = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    a, b = minhash.signature(big), minhash.signature(big[: 4000])
    assert 0.6 < (a == b).mean() < 0.95


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(200, x) for x in range(201, 300)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "p long, q long").repartition(5), "p", "q", scratch).collect()}
    assert got == {x: root(x) for x in linked}


def test_large_bucket_without_links(spark):
    """A passage that fills many buckets, in documents of which few are near others."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(60)]
    texts = [passage + [word() for _ in range(40)] for _ in range(60)]
    texts += [[*t[:98], "changed", "too"] for t in texts[:5]] + [t[1:] for t in texts[5:9]]
    texts = [" ".join(t) for t in texts]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(list(range(len(texts))), texts) and len({c for _, c in got.values()}) == 60


def test_pairs_by_rare_shingles_are_all_there(spark):
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(r.choice(pool[: r.choice([60, 400])], size=r.integers(1, 60))) for _ in range(150)]
    sets += [np.unique(np.append(s[r.random(len(s)) > 0.1], pool[:1])) for s in sets]
    frame = spark.createDataFrame([(i, i % 140, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, label long, s binary")
    with Scratch(spark) as scratch:
        bits = spark.createDataFrame([(i, minhash.bit_map(s).tolist()) for i, s in enumerate(sets)], "node long, bits array<long>")
        got = {(x.a, x.b) for x in minhash.prefix_pairs(frame, bits, scratch).collect()}
    share = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i % 140 != j % 140 and share(sets[i], sets[j]) >= 0.75}
    assert want <= got and len(want) > 50


def test_suffix_array():
    r = random.Random(4)
    for k in range(60):
        n = r.choice([1, 2, 3, 10, 200, 2000])
        t = np.array([r.randrange(r.choice([1, 2, 4, 256])) + 1 for _ in range(n)]) if k % 3 else np.array(([1, 2, 1, 1] * n)[:n])
        sa = suffix_array(t)
        b = bytes((t - 1).tolist())
        want = sorted(range(n), key=lambda i: b[i:])
        assert sa.tolist() == want
        shared = common_prefixes(t, sa, 63)
        for x, y in zip(want, want[1:]):
            m = 0
            while m < 63 and max(x, y) + m < n and b[x + m] == b[y + m]:
                m += 1
            assert min(shared[y], 63) == m


def brute_removed(ids, texts):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in zip(ids, texts)]
    for i, b in raw:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = defaultdict(list)
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i].append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def test_substring_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    odd = [*some_texts(160), None]
    for ids, texts in (([r.doc_id for r in rows], [r.text for r in rows]), ([900 - 3 * i for i in range(len(odd))], odd), ([i // 2 for i in range(len(odd))], odd)):
        got = defaultdict(list)
        for r in substring_dedup.digest(docs(spark, texts, ids)).collect():
            got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert {i: sorted(x) for i, x in got.items()} == brute_removed(ids, texts)
    assert substring_dedup.digest(docs(spark, odd).limit(0)).count() == 0
    both = {r.doc_id: r.n_removed for r in substring_dedup.digest(docs(spark, ["y" * 60, "y" * 60], [None, 1])).collect()}
    assert both == {None: 0, 1: 60}


def test_substring_dedup_of_hot_grams_and_long_texts(spark, monkeypatch):
    """One line in hundreds of different contexts, split by strings; and texts longer than a segment."""
    r = random.Random(6)
    prose = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    line = prose(45)
    texts = [prose(30) + (line if i % 2 else line[:40] + prose(60)) + prose(r.choice([3, 4, 40])) + line * (i % 3) for i in range(200)]
    texts += [x[:90] for x in texts[:50]]
    ids = [128 * i for i in range(len(texts))]
    hot = []
    found = substring_dedup.hot_grams
    monkeypatch.setattr(substring_dedup, "hot_grams", lambda rows, bound: hot.append(found(rows, bound)) or hot[-1])
    monkeypatch.setattr(substring_dedup, "SEGMENT", 70)
    for bound in (32, substring_dedup.HOT):
        got = defaultdict(list)
        for x in substring_dedup.remove_repeats(docs(spark, texts, ids), bound).withColumn("kept", F.sha2("kept", 256)).collect():
            got[x.doc_id].append((x.n_bytes, x.n_removed, x.n_spans, x.kept))
        assert {i: sorted(x) for i, x in got.items()} == brute_removed(ids, texts)
    assert len(hot[0]) and not len(hot[1])


def test_packing(spark, sf_dir):
    path, ranks = tokenizer_paths()
    odd = [None, "", "a  b\n\n c\u00a0 d ", " lead", "don't I'LL 12 34  \t\n x", "<|endoftext|>", "a <|endoftext|> b", "x  <|endoftext|><|endoftext|>\n y <|endoftext", "é" * 3000, "\n" * 1500, *some_texts(60)]
    frame = docs(spark, odd).select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 5000, "text"))
    rows = packing.pack_documents(frame, path, ranks).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    whole = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in frame.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == whole.keys()
    for i, ids in whole.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for x in by_seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * sum(map(len, whole.values())) + 1024 * 4
    assert packing.pack_documents(frame.limit(0), path, ranks).count() == 0
    slow = {(r.doc_id, r.start): r.ids_crc32 for r in packing.cut_documents(frame, path).collect()}
    assert slow == {(r.doc_id, r.start): r.ids_crc32 for r in rows}


def test_patterns_cover_exactly():
    r = np.random.default_rng(3)
    for lengths, need in (([16, 32, 500, 600], [9, 5, 7, 3]), (list(range(1, 16)) + list(range(16, 1024, 16)), r.integers(0, 4000, 78) + 1)):
        lengths, need = np.array(lengths), np.array(need)
        got = packing.solve_patterns(lengths, need)
        assert (sum(c * u for c, u in got) == need).all() and all(c @ lengths <= 1024 for c, _ in got)
        # A lower bound: the pieces' volume. Pieces over half the capacity cannot share, so some waste is forced.
        assert sum(u for _, u in got) <= -(-int(need @ lengths) // 1024) * 1.02 + 60


def test_media():
    payload = bytes(range(256)) * 3
    wav = media.to_wav(payload)
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", b"\0" * 13), (b"IDAT", zlib.compress(b"x")), (b"IEND", b"")))
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + b"\0" * 9 + b"\x02\x02\x44\x01\x00\x3b"
    gz = zlib.compressobj(wbits=31)
    gz = gz.compress(b"hello") + gz.flush()
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9"
    blob = b"BM noise RIFF" + png + b"PK\x03\x04 no" + wav + gif + gz + jpg + b"\x89PNG\r\n\x1a\nbroken"
    assert [(n, k) for _, n, k in media.sniff(blob)] == [(len(png), "image/png"), (len(wav), "audio/wav"), (len(gif), "image/gif"), (len(gz), "application/gzip"), (len(jpg), "image/jpeg")]
    for a, n, k in media.sniff(blob):
        assert media.sniff(blob[a : a + n])[0] == (0, n, k)
    assert media.wav_samples(wav, 0, len(wav)) == payload
    flac = b"fLaC\x00\x00\x00\x22" + b"\0" * 34 + b"\x84\x00\x00\x02ab" + b"\xff\xf8frames"
    pdf, zipped = b"%PDF-1.4 body startxref 9 %%EOF", b"PK\x03\x04name" + b"PK\x01\x02" + b"\0" * 42 + b"PK\x05\x06" + b"\0" * 8 + struct.pack("<IIH", 46, 8, 0)
    assert media.sniff(b"x" + flac + flac) == [(1, len(flac), "audio/flac"), (1 + len(flac), len(flac), "audio/flac")]
    assert media.sniff(pdf + b"-" + zipped) == [(0, len(pdf), "application/pdf"), (len(pdf) + 1, len(zipped), "application/zip")]
    assert not media.sniff(b"fLaC\x00\x00\x00\x22" + b"\0" * 90) and not media.sniff(b"%PDF-1.4 %%EOF startxref")


@pytest.mark.parametrize("unit", [b"%PDF-1", b"PK\x03\x04", b"GIF89a", b"GIF89a!!!!!!!!!!", b"GIF89a" + b"\0" * 7 + b"!", b"\xff\xd8\xff\xe0\0\x04", b"fLaC\x00\x00\x00\x22", b"RIFFxxxxWAVE", b"BM", b"\x1f\x8b\x08\0"])
def test_media_in_linear_time(unit):
    """Five million bytes of headers that lead nowhere."""
    began = time.time()
    media.sniff(unit * (5_000_000 // len(unit)))
    assert time.time() - began < 60


def brute_feature(payload, media_bytes):
    mean = sum(payload) / len(payload)
    power = sum((x - 128) ** 2 for x in payload) / len(payload)
    turns = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
    shares = [sum(x // 32 == k for x in payload) for k in range(8)]
    return f"audio/wav@0+{media_bytes}|{mean:.6f}|{power**0.5:.6f}|{turns}|{','.join(map(str, shares))}"


def test_media_query(spark):
    texts = ["", None, "é" * 300, "RIFF in a text, BM too", "x" * 576, "y" * 577]
    for r in media.digest(docs(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(padded)).hexdigest() and r.feature == brute_feature(padded, 44 + len(padded))
        assert (r.media_type, r.type_corrected) == ("audio/wav", True)
    assert media.digest(docs(spark, texts).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, bytearray(media.to_wav(b"ab")), "image/png"), (2, None, "text/plain"), (3, bytearray(b""), None)], "id int, b binary, said string")
    got = {r.id: (r.media_type, r.type_corrected, len(r.media)) for r in media.type_media(rows, "b", "said").collect()}
    assert got == {1: ("audio/wav", True, 1), 2: ("text/plain", False, 0), 3: (None, False, 0)}


def test_toxicity(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_toxicity(frame, labels).join(labels, "doc_id").where("held_out").toPandas()
    truth, said = got["toxic"] == 1, got["predicted"] == 1
    assert (truth & said).sum() / truth.sum() > 0.9 and (~truth & said).sum() / (~truth).sum() < 0.02
    assert zlib.crc32(b"12") % 5 == 0 or not frame.limit(1).select(toxicity.held_out(F.lit(12))).first()[0]
    odd = docs(spark, ["", None, "you idiot, moron and worthless scum"], [1, None, 2])
    none = toxicity.score_toxicity(odd, labels.limit(0)).orderBy("doc_id").collect()
    assert [r.predicted for r in none] == [0, 0, 1] and len(none) == 3
    assert toxicity.score_toxicity(odd.limit(0), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_label_model_prefers_accurate_voters():
    r = np.random.default_rng(0)
    y = r.random(3000) < 0.2
    flip = lambda p, n: np.where(r.random(3000) < np.where(y, p, n), 1, 0)
    noise = flip(0.3, 0.3)
    votes = np.column_stack([flip(0.8, 0.02), flip(0.7, 0.05), noise, noise])
    gold = np.where(r.random(3000) < 0.05, ~y, y).astype(int)
    q = toxicity.label_model(votes, gold)
    assert ((q > 0.5) == y).mean() >= (gold == y).mean()


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.com/en/7?x#y", "https://a.b.example.com/en/8", "http://x.net/de/1", "http://m.example.net/de/88", "http://notexample.net/de/8", "s://net/de/", "http://org/es/", "ftp://x://y.com/en/", "http://Ünï.org/es/é\nx", "http://host#f/en/", "http://www.good.example.org/fr/", "http://bad.example.org/es/1"]
    html = [None] * 6 + ['<a href="http://linked.to/x">'] * (len(urls) - 6)
    rows = spark.createDataFrame([(i, u, h, "r", 1.0) for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, rule string, trust double")
    got = {r.page_id: r for r in url_filter.judge_pages(rows).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = brute_host_path(u)
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path) == (host, path) and r.rule == (max(fits)[2] if fits else None)
        if fits:
            assert r.verdict == max(fits)[1]
    assert got[0].verdict == "allow"
    assert url_filter.judge_pages(rows.limit(0)).count() == 0


def brute_scores(edges, seeds, rounds=400):
    trust, bad = {k: 0.15 * v[0] for k, v in seeds.items()}, {k: 0.15 * v[1] for k, v in seeds.items()}
    out, into = defaultdict(float), defaultdict(float)
    for s, d, w in edges:
        out[s] += w
        into[d] += w
    for _ in range(rounds):
        t, q = defaultdict(float), defaultdict(float)
        for k, v in seeds.items():
            t[k] += 0.15 * v[0]
            q[k] += 0.15 * v[1]
        for s, d, w in edges:
            t[d] += 0.85 * trust.get(s, 0) * w / out[s]
            q[s] += 0.85 * bad.get(d, 0) * w / into[d]
        trust, bad = t, q
    return trust, bad


def test_propagation_against_brute_force(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "c", 1.0), ("e", "f", 1.0)]
    edges += [(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)] + [("c", "h0", 0.1)]
    seeds = {"a": (1.0, 0.0), "c": (0.0, 1.0)}
    trust, bad = brute_scores(edges, seeds)
    with Scratch(spark) as scratch:
        got = url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(k, *v) for k, v in seeds.items()], "host string, good double, bad double"), scratch).collect()
    assert {r.host for r in got} >= {"h20", "d"}
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-4 and abs(r.distrust - bad.get(r.host, 0)) < 1e-4


def test_verdicts_of_pages_without_rule(spark):
    """Links with spaces, without protocol and in many copies; the verdict is the fixed point's."""
    pages = [("http://good.net/de/1", '<a href = "//x.io/">'), ("http://good.net/de/1", '<a HREF="https://X.io/a">'), ("http://bad.org/es/1", None), ("http://y.io/", "<a href='http://bad.org/'>"), ("http://x.io/q", ""), ("http://far.io/", "<a href=http://y.io/>")]
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.trust, r.distrust) for r in url_filter.judge_pages(rows).collect()}
    trust, bad = brute_scores([("good.net", "x.io", 2.0), ("y.io", "bad.org", 1.0), ("far.io", "y.io", 1.0)], {"good.net": (1.0, 0.0), "bad.org": (0.0, 1.0)})
    for i, (u, _) in enumerate(pages):
        h = brute_host_path(u)[0]
        assert abs(got[i][1] - trust.get(h, 0)) < 1e-4 and abs(got[i][2] - bad.get(h, 0)) < 1e-4
        assert got[i][0] == ("allow" if "good" in u else "block" if bad.get(h, 0) > trust.get(h, 0) else "allow")
    assert {got[3][0], got[5][0]} == {"block"} and got[4][0] == "allow"
