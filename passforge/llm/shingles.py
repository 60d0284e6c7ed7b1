"""Word shingles of a text as 64-bit hashes, vectorised over the bytes of the text."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_OF_BYTE = _RNG.integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a well-known generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word (lower-cased A-Z, split at ASCII blanks), in text order."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    letters = data[inside]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    h = np.add.reduceat(_OF_BYTE[letters] * powers[place], first)
    return mix(h ^ lengths.astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct shingles of ``words`` words, ascending; the whole sequence as one if it is
    shorter; empty without words."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    k = min(words, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * _STEP + h[i:n - k + 1 + i])
    return np.unique(out)
