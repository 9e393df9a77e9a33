"""Minimal perfect hashing of 64-bit keys."""

from __future__ import annotations

import numpy as np

from markwise.llm.words import mixed

#: Places per key that is left, on each level.
ROOM = 2.0


class PerfectHash:
    """Numbers n distinct keys from 0 to n - 1, in about four bits a key.

    Each level has a bit per place. A key that is alone at its place on a level
    is settled there; those that collide go on to the next. The number of a key
    is the count of bits before its own, over all levels.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, self.offsets, total = [], [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(np.cumsum(ones) - ones)
            self.offsets.append(total)
            total += int(ones.sum())
        self.size = total

    @staticmethod
    def _places(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return mixed(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) % 2**64)) % np.uint64(width)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct unsigned 64-bit numbers."""
        levels = []
        while len(keys):
            width = -(-int(ROOM * len(keys) + 1) // 64) * 64
            places = cls._places(keys, len(levels), width)
            alone = np.bincount(places.astype(np.int64), minlength=width) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[places]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for a key that is not in the set."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            places = self._places(keys[open_], level, 64 * len(words))
            word, bit = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[hit]] = (self.offsets[level] + self.ranks[level][word] + before)[hit]
            open_ = open_[~hit]
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return head.tobytes() + b"".join(words.tobytes() for words in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        numbers = np.frombuffer(data, "<u8")
        n = int(numbers[0])
        ends = np.cumsum(np.append(n + 1, numbers[1 : n + 1].astype(np.int64)))
        return cls([numbers[a:b] for a, b in zip(ends, ends[1:], strict=False)])
