"""Word and shingle hashes of whole texts, and their MinHash signatures."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
SYMBOLS = 64
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20
#: Factors of the words of a shingle by place, and of the hash functions of a signature.
_random = np.random.Generator(np.random.Philox(key=20240))
PLACES = _random.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)
FACTORS = _random.integers(0, 2**64, SYMBOLS, np.uint64) | np.uint64(1)
SHIFTS = _random.integers(0, 2**64, SYMBOLS, np.uint64)
BYTES = _random.integers(0, 2**64, 256, np.uint64)
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK
    while size < n:
        size *= 2
    return _powers(size)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a text, A-Z in lower case; words stand between [\\x20\\x09-\\x0D]."""
    text = text.lower()
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + BLOCK)
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        out.append(_hashes(np.frombuffer(text, np.uint8, end - start, start)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashes(raw: np.ndarray) -> np.ndarray:
    space = np.concatenate([[True], SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    lo, hi = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[: len(raw)])])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words make one shingle, none make none."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    if n < words:
        return mix((w * PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    h = w[: n - words + 1] * PLACES[0]
    for i in range(1, words):
        h += w[i : n - words + 1 + i] * PLACES[i]
    return np.unique(mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value under each of 64 hash functions."""
    low = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * FACTORS + SHIFTS).min(0), out=low)
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
