"""Hashed word shingles of whole texts, computed on the bytes of an Arrow batch at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WIDTH = 5
PRIME = 0x9E3779B97F4A7C15
FACTORS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(FACTORS[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(FACTORS[1])
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(PRIME, -1, 2**64)
    both = []
    for base in (PRIME, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words in `data`; A-Z count as a-z."""
    word = np.empty(len(data) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_SEPARATOR[data], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    size = 1 << max(16, int(len(data) + 1).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start]), start


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; the whole text as one if it has fewer words.

    Documents are parts of `data` between `bounds`; a word never crosses a bound.
    """
    out = []
    for lo, hi in _slices(bounds):
        first = int(bounds[lo])
        # a separator after each document keeps words apart
        part = data[first : int(bounds[hi])]
        cut = bounds[lo : hi + 1] - first
        apart = np.full(len(part) + hi - lo, 0x20, dtype=np.uint8)
        keep = np.ones(len(apart), dtype=bool)
        keep[cut[1:] + np.arange(hi - lo)] = False
        apart[keep] = part
        words, start = word_hashes(apart)
        begin = np.searchsorted(start, cut + np.arange(hi - lo + 1))
        grams = None
        if len(words) >= width:
            n = len(words) - width + 1
            grams = words[:n] * np.uint64(FACTORS[0])
            for j in range(1, width):
                grams += words[j : j + n] * np.uint64(FACTORS[j % 5] + 2 * (j // 5))
            grams = mix(grams)
        for a, b in zip(begin.tolist(), begin[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for j, w in enumerate(words[a:b].tolist()):
                    whole = np.uint64((int(whole) + w * (FACTORS[j % 5] + 2 * (j // 5))) % 2**64)
                out.append(mix(np.array([whole ^ np.uint64(PRIME)])))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _slices(bounds: np.ndarray, size: int = 1 << 21):
    """Ranges of documents of about `size` bytes, at least one document each."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi
