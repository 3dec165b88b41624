"""Minimal perfect hashing of distinct keys, in numpy.

Every level has a bit for each of half again as many places as it has keys; keys that are alone at their place stay there,
the others go on to the next level. The number of set bits before a key's own is its slot: n keys have the slots 0 to n - 1.
A few bits per key are held besides the keys themselves, which tell strangers from members.
"""

from __future__ import annotations

import math

import numpy as np

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MOST_LEVELS = 200


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = np.full(len(keys), level + 1, np.uint64) * _STEP
    for word in keys.T:
        h = (h ^ word) * _MIX
        h ^= h >> np.uint64(32)
    h = (h * _STEP) ^ (h >> np.uint64(29))
    return h % np.uint64(size)


class KeyTable:
    """Slots of distinct keys. A key is a row of one or more unsigned 64-bit words."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64).reshape(len(keys), -1 if len(keys) else 1)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, held = keys, 0
        while len(left):
            if len(self.levels) == MOST_LEVELS:
                raise ValueError(f"{len(left)} keys don't part; are they distinct?")
            size = max(64, math.ceil(1.5 * len(left)))
            at = _places(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little")
            words = np.concatenate([words, np.zeros(-len(words) % 8, np.uint8)]).view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, held + np.cumsum(counts) - counts))
            held += int(counts.sum())
            left = left[~alone[at]]
        self.keys = np.zeros_like(keys)
        self.keys[self._slots(keys)] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every member; any slot, or -1, for others."""
        slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            at = _places(keys[open_], level, size)
            word, bit = words[at >> np.uint64(6)], at & np.uint64(63)
            here = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[open_[here]] = before[at[here] >> np.uint64(6)] + lower[here]
            open_ = open_[~here]
            if not len(open_):
                break
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the key at that slot is another one."""
        keys = np.ascontiguousarray(keys, np.uint64).reshape(len(keys), -1 if len(keys) else 1)
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        slots = self._slots(keys)
        return np.where((self.keys[slots] == keys).all(axis=1), slots, -1)
