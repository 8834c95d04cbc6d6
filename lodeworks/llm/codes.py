"""A hash table of 64-bit keys in two arrays: whole arrays of keys are looked up or added at once."""

from __future__ import annotations

import numpy as np


class Codes:
    """Codes of 64-bit keys by open addressing; at most half full. Key 0 stands for none."""

    def __init__(self):
        self.keys, self.codes, self.used = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32), 0

    @classmethod
    def of(cls, keys: np.ndarray) -> Codes:
        """Distinct keys numbered in their order."""
        made = cls()
        made.add(keys, np.arange(len(keys), dtype=np.int32))
        return made

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that aren't there."""
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        mask = np.uint64(len(self.keys) - 1)
        at = (keys & mask).astype(np.int64)
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.codes[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            held = self.keys != 0
            keys, codes = np.concatenate([keys, self.keys[held]]), np.concatenate([codes, self.codes[held]])
            size = 1 << (4 * self.used - 1).bit_length()
            self.keys, self.codes = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several for one place the last one stays
            placed = self.keys[at] == keys
            self.codes[at[placed]] = codes[placed]
            keys, codes, at = keys[~placed], codes[~placed], (at[~placed] + 1) & mask
