"""Minimal perfect hashing of distinct keys, a whole array at a time.

Keys are rows of 64-bit lanes. On every level those left are hashed to twice as many places; a key that is
alone at its place stays there, and its slot is the number of such places before it. The others go on to the
next level. Slots are 0 to n - 1. Every lookup is held against the key that is laid out at the slot, so a key that is
not in the table has slot -1.
"""

from __future__ import annotations

import numpy as np

from .rolling import mix

#: Places for each key left.
ROOM = 2
MAX_LEVELS = 200


def lanes(*columns) -> np.ndarray:
    """Equally long integer columns as rows of 64-bit lanes."""
    return np.stack([np.ascontiguousarray(c).astype(np.int64).view(np.uint64) for c in columns], axis=1)


def _places(keys: np.ndarray, level: int, room: int) -> np.ndarray:
    h = np.full(len(keys), 0x9E3779B97F4A7C15 + level * 0x632BE59BD9B4E019 & 2**64 - 1, np.uint64)
    for lane in keys.T:
        h = mix(h ^ lane)
    return (h % np.uint64(room)).astype(np.int64)


class PerfectHash:
    """keys: an (n, k) array of distinct rows; afterwards ``keys`` has them by slot."""

    def __init__(self, keys: np.ndarray):
        slot, left, base = np.empty(len(keys), np.int64), np.arange(len(keys)), 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(left):
            if len(self.levels) == MAX_LEVELS:
                raise ValueError("keys repeat")
            room = ROOM * len(left)
            at = _places(keys[left], len(self.levels), room)
            alone = np.bincount(at, minlength=room) == 1
            rank = np.cumsum(alone) + (base - 1)
            here = alone[at]
            slot[left[here]] = rank[at[here]]
            self.levels.append((alone, rank))
            base += int(here.sum())
            left = left[~here]
        self.keys = np.empty_like(keys)
        self.keys[slot] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 of those that the table doesn't have."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = _places(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[(self.keys[out[found]] != keys[found]).any(axis=1)]] = -1
        return out

    def dump(self) -> bytes:
        """The places of all levels as bits."""
        parts = [np.int64(len(self.levels)).tobytes(), np.array([len(a) for a, _ in self.levels], np.int64).tobytes()]
        return b"".join(parts + [np.packbits(a).tobytes() for a, _ in self.levels])

    @classmethod
    def load(cls, dumped: bytes, keys: np.ndarray) -> PerfectHash:
        """A dumped table; keys as they lie by slot."""
        self, n = cls.__new__(cls), int(np.frombuffer(dumped, np.int64, 1)[0])
        sizes, at, base = np.frombuffer(dumped, np.int64, n, 8), 8 + 8 * n, 0
        self.keys, self.levels = keys, []
        for size in sizes.tolist():
            packed = np.frombuffer(dumped, np.uint8, (size + 7) // 8, at)
            alone = np.unpackbits(packed, count=size).astype(bool)
            self.levels.append((alone, np.cumsum(alone) + (base - 1)))
            base, at = base + int(alone.sum()), at + len(packed)
        return self
