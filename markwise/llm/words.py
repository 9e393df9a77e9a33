"""Words and word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
EMPTY = np.empty(0, np.uint64)


class WordHashes(dict):
    """Hash of a word, remembered for up to ``bound`` words of a task.

    Only memory is bounded: a forgotten word is hashed again, to the same value.
    """

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    A shorter text is one run of all its words; no words, no shingles.
    """
    if not len(words):
        return EMPTY
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for place in range(size):
        runs = mixed(runs + words[place : place + len(runs)])
    return np.unique(runs)


def shingles_of(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The shingle set of a whole text, A-Z lower-cased (null: empty)."""
    return shingle_set(hashes.of(text.lower().split())) if text else EMPTY
