"""Hashed words and word shingles of a text, with numpy.  Helpers of tasks; Spark deals out the texts."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
CACHE_WORDS = 500_000
MULTIPLIER = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that all bits depend on all bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> list:
    return [U64(pow(MULTIPLIER, i + 1, 1 << 64)) for i in range(n)]


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    for i, m in enumerate(powers(size)):
        total += h[i : i + n] * m
    return mix(total)


def shingle_set(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; of fewer words, the whole sequence is one; none without words."""
    if not words:
        return np.empty(0, dtype=U64)
    h = hashes.of(words)
    if len(words) >= size:
        return np.unique(gram_hashes(h, size))
    return mix(gram_hashes(h, len(words)) + U64(len(words)))
