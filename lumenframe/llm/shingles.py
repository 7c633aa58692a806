"""Word shingles of whole texts as 64-bit hashes, computed with numpy over the bytes of a batch.

A word's hash is a polynomial in an odd base modulo 2^64, taken from prefix sums, so all words of a batch cost one pass;
it is then scrambled. Long words, which could be built to collide there, are hashed one by one. Five scrambled words with five odd factors make a shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
LONG_WORD = 256
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n; kept for up to 1 MB of text."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        both = [np.cumprod(np.full(size, b, dtype=U)) for b in (BASE, pow(BASE, -1, 1 << 64))]
        if size > 1 << 20:
            return both[0][:n], both[1][:n]
        _powers["up"], _powers["down"] = both
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The scrambled hash of each word of the texts, A-Z lower-cased, and the index of its text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    space = SPACE[buf]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    up, down = powers(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((LOWER[buf].astype(U) + U(1)) * up, out=sums[1:])
    out = scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        word = LOWER[buf[starts[k] : ends[k]]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out, np.searchsorted(ends_of_text, starts, side="right")


def shingle_sets(texts: list[str | None], chunk: int = 1 << 19) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending: of five words, or of all its words if it has fewer; without words, none."""
    out: list[np.ndarray] = []
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        size, to = 0, at
        while to < len(raw) and (to == at or size + len(raw[to]) < chunk):
            size += len(raw[to])
            to += 1
        words, text = word_hashes(raw[at:to])
        per = np.bincount(text, minlength=to - at)
        firsts = np.concatenate(([0], np.cumsum(per)))
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            mixed = words[:n] * FACTORS[0]
            for k in range(1, WORDS):
                mixed += words[k : k + n] * FACTORS[k]
            mixed = scramble(mixed)
        for i in range(to - at):
            a, n = firsts[i], per[i]
            if n >= WORDS:
                out.append(np.unique(mixed[a : a + n - WORDS + 1]))
            elif n:
                out.append(scramble(np.array([(words[a : a + n] * FACTORS[:n]).sum(dtype=U) + U(n)], dtype=U)))
            else:
                out.append(np.empty(0, dtype=U))
        at = to
    return out
