"""Vectorised hashes of byte strings and word runs, and the places winnowing picks among them."""

from __future__ import annotations

import numpy as np

MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16, 0 if have is None else 2 * len(have))
        with np.errstate(over="ignore"):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            have = _powers[base] = np.multiply.accumulate(steps)
    return have


INVERSE = pow(_BASE, -1, 1 << 64)


class Sums:
    """Prefix sums of byte values times powers: the hash of any slice in constant time.

    h(s) = sum of value(s[i]) * BASE ** i over the slice, mixed, is the same wherever the slice stands.
    """

    def __init__(self, data: np.ndarray, values: np.ndarray | None = None):
        raw = _BYTES[data] if values is None else values  # other values than those of the bytes
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(raw * powers(_BASE, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * powers(INVERSE, len(self.sums))[start])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all slices of length k."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * powers(INVERSE, n)[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the minimum of some window of w of them; ties are all picked.

    What is picked in a run of w hashes depends on those alone, so two texts that share such a run
    share a picked place in it. MAX marks a gap: it is never picked, nor does a window with one pick.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.full(w - 1, MAX), hashes, np.full(w - 1, MAX)])
    low = sliding_min(padded, w).copy()  # window that starts at i - (w - 1), for i in 0 .. n + w - 2
    gaps = np.concatenate([[0], np.cumsum(padded == MAX)])
    low[gaps[w:] > gaps[: len(low)]] = 0
    top = MAX - sliding_min(MAX - low, w)  # for each place, the largest minimum of a window it is in
    return np.flatnonzero((top[:n] == hashes) & (hashes != MAX))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the ASCII white-space words of texts end to end, and the first word of each text."""
    n = len(data)
    ink = np.zeros(n + 2, bool)
    ink[1:-1] = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word runs of each text, and where each text's begin.

    A text of fewer than k words has one, of all its words; a text without words has none.
    """
    starts, ends, first = words_of(data, offsets)
    texts = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    sums = Sums(data, Sums(data).of(starts, ends))
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(texts), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + first[:-1][doc]
    h = sums.of(at, np.minimum(at + k, first[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(texts + 1))
