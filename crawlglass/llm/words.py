"""Hashes of words and word shingles for many texts at once.

A word is a run of characters other than space and U+0009 to U+000D.  Its hash is a polynomial of its UTF-8 bytes
modulo 2**64, mixed with its length; a shingle folds the hashes of its words in order.  Equal words have equal hashes;
different ones differ but for a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of one stretch of bytes."""
    inside = ~space[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    powers = np.cumprod(np.full(int(sizes.max()), _BASE), dtype=np.uint64)
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix64(np.add.reduceat(values, first) ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), starts


def word_places(
    texts: list[bytes], lower: bool = False, space: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, their first bytes in ``b" ".join(texts)``, and the number of words of each text.

    ``space`` marks the bytes between words; the space character must be one of them.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    found, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while stop < len(data) and not space[data[stop - 1]]:  # a word is not cut
            gap = np.flatnonzero(space[data[stop : stop + CHUNK]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(len(data), stop + CHUNK)
        hashes, starts = _hashes(data[at:stop], space)
        found.append(hashes)
        places.append(starts + at)
        at = stop
    bounds = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate(places)
    return np.concatenate(found), starts, np.diff(np.searchsorted(starts, bounds, side="left"), prepend=0)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    hashes, _, counts = word_places(texts, lower)
    return hashes, counts


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each window of ``size`` words; one for the whole sequence if it is shorter; none without words."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    folded = np.full(n, size, np.uint64)
    for j in range(size):
        folded = mix64(folded * _BASE + hashes[j : j + n])
    return folded


def shingle_sets(texts: list[str], size: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted set of shingles of each text."""
    hashes, counts = word_hashes([t.encode("utf-8") for t in texts], lower)
    ends = np.cumsum(counts)
    return [np.unique(shingles(hashes[e - n : e], size)) for e, n in zip(ends, counts)]
