"""Word shingles of texts as arrays of 64-bit hashes, batch by batch."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words of a text; none for a null one."""
    return hashes((text or "").encode().lower().split())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def windows(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of each ``width``-word window, in order; a shorter text is one window, an empty one has none."""
    n = len(h)
    if n == 0:
        return h
    if n < width:
        whole = np.full(1, n, np.uint64)
        for x in h:
            whole = mix(whole * FACTOR + x)
        return whole
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out *= FACTOR
        out += h[k : n - width + 1 + k]
    return mix(out)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(windows(word_hashes(text), width))


class Minima:
    """Universal hash functions ``a * x + b`` modulo 2^64, and the smallest value of each over a set."""

    #: Shingles that are hashed together, so that they stay in the processor's cache.
    CHUNK = 1 << 14

    def __init__(self, count: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of minima for each set; the sets are not empty."""
        out = np.empty((len(sets), len(self.a)), np.uint64)
        start = 0
        while start < len(sets):
            end, size = start, 0
            while end < len(sets) and (end == start or size + len(sets[end]) <= self.CHUNK):
                size += len(sets[end])
                end += 1
            x = np.concatenate(sets[start:end])
            at = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
            for k in range(len(self.a)):
                out[start:end, k] = np.minimum.reduceat(x * self.a[k] + self.b[k], at)
            start = end
        return out
