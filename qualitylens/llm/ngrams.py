"""Hashed word and character n-grams of a batch of texts, in numpy.

All texts of a batch are laid out as one array of code points. A running
polynomial hash gives the hash of any stretch of it by one subtraction, so
words, their prefixes and n-grams cost a few array operations however many
there are. A family of n-grams is an array of buckets in text order with, per
text, the range that belongs to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.random.default_rng(7).integers(1, 2**64 - 1, 1 << 16, dtype=np.uint64)
_K = [np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: (buckets, first of each text, end of each text)
Family = tuple[np.ndarray, np.ndarray, np.ndarray]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class TextBatch:
    """Words and hashes of some texts; null is empty."""

    def __init__(self, texts: list, lower: bool = False):
        texts = [t or "" for t in texts]
        if lower:
            texts = [t.lower() for t in texts]
        self.points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        p = self.points
        self.space = (p == 32) | ((p >= 9) & (p <= 13))
        edge = np.diff(np.concatenate([[True], self.space, [True]]).astype(np.int8))
        self.word_start, self.word_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.word_low = np.searchsorted(self.word_start, self.starts)
        self.word_high = np.searchsorted(self.word_start, self.starts + self.lengths)
        self._running = None

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of stretches of the code points."""
        power, inverse = _power_tables(len(self.points) + 1)
        if self._running is None:
            mixed = _MIX[self.points & np.uint32(0xFFFF)] + self.points
            self._running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[: len(self.points)], dtype=np.uint64)])
        h = (self._running[end] - self._running[start]) * inverse[start]
        return (h ^ h >> np.uint64(31)) * _K[0]

    def words(self) -> np.ndarray:
        return self.stretch(self.word_start, self.word_end)

    def word_family(self, n: int, bits: int, words: np.ndarray | None = None) -> Family:
        """n-grams of n words."""
        h = joined(self.words() if words is None else words, n)
        low = np.minimum(self.word_low, len(h))
        return bucket(h, bits), low, np.maximum(np.minimum(self.word_high - n + 1, len(h)), low)

    def prefix_family(self, length: int, bits: int) -> Family:
        """The first ``length`` code points of words that have as many."""
        has = self.word_end - self.word_start >= length
        start = self.word_start[has]
        upto = np.concatenate([[0], np.cumsum(has)])
        return bucket(self.stretch(start, start + length), bits), upto[self.word_low], upto[self.word_high]

    def char_family(self, n: int, bits: int) -> Family:
        """n-grams of n code points."""
        p = self.points
        m = max(0, len(p) - n + 1)
        h = np.zeros(m, np.uint32)
        for k in range(n):
            h = (h ^ p[k : m + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        low = np.minimum(self.starts, m)
        return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), low, np.maximum(np.minimum(self.starts + self.lengths - n + 1, m), low)

    def repeated_words(self, n: int = 3) -> np.ndarray:
        """Per text the words in windows of n words that it has twice or more."""
        words = self.words()
        doc = np.repeat(np.arange(len(self.starts)), self.word_high - self.word_low)
        h = joined(words, n)
        own = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(own)
        key = h[at] ^ (doc[at].astype(np.uint64) + np.uint64(1)) * _K[1]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marked = np.zeros(len(words), bool)
        for k in range(n):
            marked[at[twice] + k] = True
        upto = np.concatenate([[0], np.cumsum(marked)])
        return upto[self.word_high] - upto[self.word_low]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Per text the number of its code points with a flag."""
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[self.starts + self.lengths] - upto[self.starts]


def joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row."""
    if len(words) < n:
        return words[:0]
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = (h ^ h >> np.uint64(29)) * _K[2] + words[k : len(words) - n + 1 + k] * _K[3]
    return h


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ h >> np.uint64(32)) * _K[1]) >> np.uint64(64 - bits)


def parts(texts: list, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` code points together."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)
