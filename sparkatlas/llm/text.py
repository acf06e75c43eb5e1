"""Vectorised hashing of words and word shingles.

Words are maximal runs of bytes other than the six ASCII white-space bytes; only A-Z is lower-cased.
All hashes are 64-bit and fixed: the same in every process and on every executor.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word."""
    a = np.frombuffer(data, np.uint8)
    inside = np.empty(len(a) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~SPACE[a]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(BYTE[a] * powers(_BASE, len(a)), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(_INVERSE, len(a))[start]
    return mix(h + (end - start).astype(np.uint64) * PLACE[15]), start, end


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out += h[i : len(out) + i] * PLACE[i]
    return mix(out + np.uint64(size))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; with fewer words, the whole sequence as one; none without words."""
    return runs(h, min(k, len(h))) if len(h) else h


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(words(encode(text))[0], k))


def sum_name(s: np.ndarray) -> int:
    """An order-free 64-bit name of a set of hashes."""
    return int(s.sum(dtype=np.uint64).astype(np.int64))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
