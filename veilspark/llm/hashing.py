"""Hashes of words and shingles of one text, as numpy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random-looking value for every byte after lower-casing A-Z.
_VALUES = mix(_LOWER.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """One hash for each word, a run of bytes other than blank and tab to carriage return; A-Z as a-z.

    Differences of one running sum give the polynomial hash of every word at once.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(1 << max(16, int(len(data)).bit_length()))
    inside = np.concatenate(([False], ~_BLANK[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * down[start] + length * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words in order; of all words as one run if there are fewer."""
    width = min(n, len(words))
    if not width:
        return words
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_ODD) + words[k : len(words) - width + 1 + k])
    return out


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "replace")), n))


def signature(values: np.ndarray) -> bytes:
    """16 bytes that stand for a set of hashes."""
    if not len(values):
        return b"\0" * 16
    second = mix(values ^ np.uint64(0x165667B19E3779F9))
    sums = np.array([values.sum(dtype=np.uint64), second.sum(dtype=np.uint64)], dtype=np.uint64)
    return mix(sums + np.uint64(len(values))).tobytes()
