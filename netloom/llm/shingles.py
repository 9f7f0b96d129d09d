"""Word shingles as 64-bit hashes, MinHash signatures, exact Jaccard comparison."""

from __future__ import annotations

import numpy as np

#: Words of an n-gram, and the least Jaccard similarity of near-duplicates, as a share of 100.
WIDTH, PERCENT = 5, 75
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BYTE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0xF1357AEA2E62A9C5
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def encoded(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased; no other byte changes."""
    return text.encode("utf-8", "surrogatepass").lower()


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at [\\x20\\x09-\\x0D]+ (what bytes.split splits at)."""
    return encoded(text).split()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of each word: polynomial hashes by differences of one running sum over the bytes."""
    x = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~_BLANK[x]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power(len(x) + 1)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * up[: len(x)], dtype=np.uint64)])
        h = (run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * _MIX[1]
        h ^= h >> np.uint64(31)
        h *= _MIX[2]
    return h, start


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that start at each word."""
    n = len(h) - k + 1
    s = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            s = (s ^ (h[i : i + n] * _MIX[i])) * _MIX[0]
            s ^= s >> np.uint64(29)
    return s


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; with fewer words the whole sequence is one; none without words."""
    h, _ = word_hashes(encoded(text))
    return np.unique(runs(h, min(WIDTH, len(h)))) if len(h) else np.empty(0, np.uint64)


def coefficients(k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash coordinates (31-bit, as int32) of a non-empty set; multiply-shift hashing in slices that bound memory."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2048):
            np.minimum(least, (s[i : i + 2048, None] * a + b).min(0), out=least)
    return (least >> np.uint64(33)).astype(np.int32)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * |x & y| >= percent * |x | y|, both non-empty."""
    n, m = len(x), len(y)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    i = overlap(x, y)
    return 100 * i >= percent * (n + m - i)
