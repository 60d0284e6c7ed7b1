"""Places of 64-bit keys in a sorted array, for many keys at once."""

from __future__ import annotations

import numpy as np


class KeyTable:
    """Places of sorted 64-bit keys: most by one look-up in a hashed table, the rest by bisection."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys if len(keys) else np.array([-(1 << 62)], np.int64)
        self.shift = np.uint64(64 - max(4, (8 * len(self.keys)).bit_length()))
        slot = self._slot(self.keys)
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[slot] = np.arange(len(self.keys))
        self.shared = np.bincount(slot, minlength=len(self.table)) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or minus one."""
        slot = self._slot(keys)
        at = self.table[slot]
        at = np.where(self.keys[at] == keys, at, -1)
        again = np.flatnonzero((at < 0) & self.shared[slot])
        if len(again):
            near = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            at[again] = np.where(self.keys[near] == keys[again], near, -1)
        return at
