"""Growing Bloom filters over 64-bit hashes, in numpy, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np


class GrowingBloom:
    """A chain of equal filters; a new one is added when the last is full.

    Memory is ``bits_per_id`` bits an id whatever the number of ids, and the false positive rate of each filter stays at its
    design value because none is filled beyond ``capacity``.
    """

    def __init__(self, capacity: int = 1 << 17, bits_per_id: int = 16, hashes: int = 6):
        self.capacity, self.hashes = capacity, hashes
        self.size = 1 << max(10, (capacity * bits_per_id - 1).bit_length())
        self.filters: list[np.ndarray] = []
        self.room = 0

    def _positions(self, ids: np.ndarray, i: int) -> np.ndarray:
        low, high = ids & np.uint64(0xFFFFFFFF), (ids >> np.uint64(32)) | np.uint64(1)
        return (low + np.uint64(i) * high) & np.uint64(self.size - 1)

    def add(self, ids: np.ndarray) -> None:
        """Insert unsigned 64-bit ids."""
        while len(ids):
            if not self.room:
                self.filters.append(np.zeros(self.size // 8, np.uint8))
                self.room = self.capacity
            now, ids = ids[: self.room], ids[self.room :]
            self.room -= len(now)
            for i in range(self.hashes):
                at = self._positions(now, i)
                np.bitwise_or.at(self.filters[-1], at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_contain(self, ids: np.ndarray) -> np.ndarray:
        """A mask: False means certainly absent."""
        hit = np.zeros(len(ids), bool)
        for bits in self.filters:
            left = np.flatnonzero(~hit)
            for i in range(self.hashes):
                if not len(left):
                    break
                at = self._positions(ids[left], i)
                left = left[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            hit[left] = True
        return hit
