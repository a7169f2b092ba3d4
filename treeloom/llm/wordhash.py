"""Hashes of words and of runs of words, by numpy over whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from treeloom.llm.scratch import worker_cache

#: Distinct words whose hash a worker remembers at most; then it starts anew.
MEMO_WORDS = 250_000
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


class Memo(dict):
    """A word's 64-bit hash, computed at first sight."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashes(words: list[bytes]) -> np.ndarray:
    cache = worker_cache()
    memo = cache.get("words")
    if memo is None:
        memo = cache["words"] = Memo()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of a polynomial hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, width: int, odd: np.uint64 = ODD) -> np.ndarray:
    """A hash of each `width` consecutive words; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= odd
        out += h[j : n + j]
    return mix(out)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive hashes."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for j in range(1, width):
        np.minimum(out, h[j : n + j], out=out)
    return out
