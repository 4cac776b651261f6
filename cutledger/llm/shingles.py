"""Sets of hashed word shingles, as numpy arrays, one text at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_TURN = _RNG.integers(1, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_END = np.arange(WORDS + 1, dtype=np.uint64) * _TURN[WORDS :]
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes handled at once; a longer text is cut at white space.
_STEP = 1 << 20
_POWERS = np.cumprod(np.full(1 << 12, _BASE), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _BASE), dtype=np.uint64)
    return _POWERS


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word of the text, in order."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + _STEP)
        while end < len(text) and not _WHITE[text[end]]:
            end += 1
        parts.append(_hashes(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _hashes(data: np.ndarray) -> np.ndarray:
    inside = ~_WHITE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(terms, np.cumsum(lengths) - lengths) ^ lengths.astype(np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles of five words, sorted; of fewer words the whole sequence as one.

    Only A to Z are lower-cased. No words, no shingles.
    """
    words = word_hashes(text.lower())
    n = len(words)
    if not n:
        return words
    width = min(n, WORDS)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _TURN[i]
    return np.unique(mixed(total + _END[width]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets share at least `percent` hundredths of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)
