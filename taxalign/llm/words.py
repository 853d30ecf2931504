"""Hashes of the words of many texts at once.

A word is a longest run of bytes other than space and tab to carriage return; A-Z are
lower-cased first.  Its hash is a polynomial over its bytes modulo 2**64, taken from one
running sum over a stretch of text, then mixed.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed with one running sum; a stretch ends at white space.
_STRETCH = 1 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts laid end to end, and the text it stands in.

    ``raw`` are the bytes, ``begins`` where each text begins, and the end.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:n]
    last = ~space
    last[:-1] &= space[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + _STRETCH, "right")), at + 1)
        low, high = starts[at], ends[to - 1]
        size = 1 << max(20, int(high - low).bit_length())
        up, down = _powers(size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw[low:high]] + np.uint64(1)) * up[:high - low], dtype=np.uint64)])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    texts = np.searchsorted(begins, starts, "right") - 1
    return mix(hashes), texts
