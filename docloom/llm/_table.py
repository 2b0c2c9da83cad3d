"""Remembered id lists by 64-bit key: sorted keys beside a growing pool."""

from __future__ import annotations

import numpy as np


class IdTable:
    """Lists of ids by key. Beyond ``most`` keys it forgets all of them and starts anew."""

    def __init__(self, most: int):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the (sorted, distinct) ``keys`` that it does not know."""
        if len(self.keys) > self.most:
            self._forget()
        if not len(self.keys):
            return np.arange(len(keys))
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[place] != keys)

    def learn(self, keys: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted new ``keys`` with their ids one after the other in ``flat``."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, begin)
        self.count = np.insert(self.count, place, counts)

    def spell(self, keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``keys[which]`` one after the other, and where each entry begins (and the last ends)."""
        row = np.searchsorted(self.keys, keys)[which]
        counts = self.count[row]
        to = np.zeros(len(row) + 1, np.int64)
        np.cumsum(counts, out=to[1:])
        return self.ids[np.repeat(self.begin[row] - to[:-1], counts) + np.arange(to[-1])], to
