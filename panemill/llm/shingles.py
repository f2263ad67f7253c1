"""Hashes of the word shingles of whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd factors of the hashes; any would do.
_STEP, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all bits, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z as a-z) of many texts, and how many words each text has.

    ``body`` holds the UTF-8 bytes of all texts, ``at`` where each begins and, last, where they end.
    """
    docs = len(at) - 1
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    word = ~_SPACE[body]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = at[:-1][at[:-1] < len(body)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    place = np.flatnonzero(word)
    of = np.cumsum(first)[place] - 1
    place_in = place - starts[of]
    powers = np.cumprod(np.full(int(place_in.max()) + 1, _STEP, np.uint64))
    terms = _VALUE[_LOWER[body[place]]] * powers[place_in]
    sums = np.add.reduceat(terms, np.searchsorted(place, starts))
    ends = np.searchsorted(starts, at)
    return mixed(sums), np.diff(ends)


def shingle_hashes(body: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (signed) of the shingles of ``words`` words of many texts, and how many each text has.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    h, counts = word_hashes(body, at)
    ends = np.cumsum(counts)
    sums = np.zeros(len(h), np.uint64)
    factor = _SHIFT
    for j in range(words):
        if j < len(h):
            sums[: len(h) - j] += h[j:] * factor
        factor = factor * _SHIFT
    last = np.repeat(ends, counts) - np.arange(len(h)) >= words
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    short = np.flatnonzero((counts > 0) & (counts < words))
    for d in short:  # at most a few words each
        a, b, factor, total = ends[d] - counts[d], ends[d], _SHIFT, np.uint64(counts[d])
        for x in h[a:b]:
            total, factor = total + x * factor, factor * _SHIFT
        sums[a], last[a] = total, True
    return mixed(sums[last]).view(np.int64), shingles


def shingle_sets(body: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    with np.errstate(over="ignore"):
        every, counts = shingle_hashes(body, at, words)
    ends = np.cumsum(counts)
    return [np.unique(every[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
