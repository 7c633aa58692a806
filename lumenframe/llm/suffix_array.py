"""Suffix arrays by induced sorting, with numpy.

Suffixes are classified as smaller or larger than their right neighbour. The leftmost-smaller (LMS) substrings are sorted
by induction from their first characters, named, and, where names repeat, the string of names is sorted in turn. From
the order of LMS suffixes the others are induced: left to right the larger ones, right to left the smaller ones. Induction
goes bucket by bucket, a whole bucket in one numpy step, so the work is linear and the Python steps are few. The string
of names has a large alphabet, for which bucket steps do not pay; it is sorted by doubling the compared length.
"""

from __future__ import annotations

import numpy as np

from .shingles import U, powers, scramble


class RangeHashes:
    """Hashes of ranges of a string, from prefix sums."""

    def __init__(self, t: np.ndarray) -> None:
        up, self.down = powers(len(t) + 1)
        self.sums = np.zeros(len(t) + 1, dtype=U)
        np.cumsum((t.astype(U) + U(1)) * up[: len(t)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the string is the smallest suffix."""
    n = len(t)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return step[nxt] > 0


def _place(sa: np.ndarray, ptr: np.ndarray, items: np.ndarray, chars: np.ndarray, up: bool) -> None:
    """Append items to the front (or back) of the bucket of their character, in their order."""
    order = np.argsort(chars, kind="stable")
    count = np.bincount(chars, minlength=len(ptr))
    inside = np.arange(len(chars)) - np.repeat(np.cumsum(count) - count, count)
    base = np.repeat(ptr, count)
    sa[base + inside if up else base - 1 - inside] = items[order]
    ptr += count if up else -count


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The suffix array given the LMS suffixes in order (or, from any order of their first characters, sorted LMS substrings)."""
    n, k = len(t), len(edges) - 1
    sa = np.full(n, -1, dtype=np.int32)
    chars = t[lms]
    order = np.argsort(chars, kind="stable")
    seeds = lms[order]
    seed_edges = np.searchsorted(chars[order], np.arange(k + 1))
    heads = edges[:-1].copy()
    if not small[n - 1]:  # the last suffix follows the end of the string, the smallest of all
        sa[heads[t[n - 1]]] = n - 1
        heads[t[n - 1]] += 1
    for c in np.flatnonzero(np.diff(edges)):
        done = edges[c]
        while done < heads[c]:
            chunk = sa[done : heads[c]]
            done = heads[c]
            pred = chunk[chunk > 0] - 1
            pred = pred[~small[pred]]
            if len(pred):
                _place(sa, heads, pred, t[pred], True)
        chunk = seeds[seed_edges[c] : seed_edges[c + 1]]
        pred = chunk[chunk > 0] - 1
        pred = pred[~small[pred]]
        if len(pred):
            _place(sa, heads, pred, t[pred], True)
    tails = edges[1:].copy()
    for c in np.flatnonzero(np.diff(edges))[::-1]:
        done = edges[c + 1]
        while done > tails[c]:
            chunk = sa[tails[c] : done][::-1]
            done = tails[c]
            pred = chunk[chunk > 0] - 1
            pred = pred[small[pred]]
            if len(pred):
                _place(sa, tails, pred, t[pred], False)
        chunk = sa[edges[c] : heads[c]][::-1]
        pred = chunk[chunk > 0] - 1
        pred = pred[small[pred]]
        if len(pred):
            _place(sa, tails, pred, t[pred], False)
    return sa


def _doubling(names: np.ndarray) -> np.ndarray:
    rank, h, n = names.astype(np.int64), 1, len(names)
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key)
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if new[order[-1]] == n - 1:
            return order
        rank, h = new, 2 * h


def suffix_array(t: np.ndarray, alphabet: int = 257) -> np.ndarray:
    """Starts of the suffixes of ``t`` (whole numbers below ``alphabet``) in ascending order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.uint16)  # stable sorts of 16-bit numbers are radix sorts
    small = _smaller(t)
    edges = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=alphabet))))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        rough = _induce(t, small, lms, edges)
        rough = rough[is_lms[rough]]
        index = np.empty(n, dtype=np.int64)
        index[lms] = np.arange(len(lms))
        length = np.diff(np.append(lms, n - 1)) + 1
        held = scramble(RangeHashes(t).of(lms, length) + length.astype(U))
        ordered = held[index[rough]]
        names = np.empty(len(lms), dtype=np.int64)
        names[index[rough]] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        lms = lms[np.argsort(names)] if names.max() == len(lms) - 1 else lms[_doubling(names)]
    return _induce(t, small, lms, edges)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, where: np.ndarray | None = None) -> np.ndarray:
    """Permuted: at i, how much suffix i shares with the one before it in ``sa``, counted up to ``most``, one less than a power of two.

    With ``where``, a mask, only at its places; elsewhere 0.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    hashes, shared = RangeHashes(t), np.zeros(n, dtype=np.int32)
    live = np.flatnonzero(before >= 0 if where is None else where & (before >= 0))
    other, found = before[live].astype(np.int64), np.zeros(len(live), dtype=np.int64)
    step = (most + 1) // 2
    while step:
        a, b = live + found, other + found
        fits = np.maximum(a, b) + step <= n
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        found += step * (fits & (hashes.of(a, step) == hashes.of(b, step)) if step <= n else 0)
        step >>= 1
    shared[live] = found
    return shared
