"""A hash table of numbers in numpy arrays."""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64((1 << 64) - 1)


class Lookup:
    """64-bit keys to values: one multiplication, then a step to the next slot while slots collide.

    room: slots for each key, at least; more room means fewer steps for keys that aren't there.
    The largest 64-bit number marks an empty slot and can't be a key.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray | None, kind=np.float32, room: float = 1.5):
        self.room = room
        self.bits = max(4, int(room * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = None if values is None else np.zeros(1 << self.bits, kind)
        if len(keys) and keys.max() == _EMPTY:
            raise ValueError("the mark of empty slots is among the keys")
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            take, first = np.unique(slot[free], return_index=True)
            mine = left[free][first]
            self.keys[take] = keys[mine]
            if values is not None:
                self.values[take] = values[mine]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            # those that met a slot taken before this round, or lost the draw, go one on
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    @property
    def used(self) -> np.ndarray:
        return self.keys != _EMPTY

    def __getstate__(self):
        """Without the empty slots: small to send, filled again where it arrives."""
        used = self.used
        return (self.keys[used], None, None, self.room) if self.values is None else (self.keys[used], self.values[used], self.values.dtype, self.room)

    def __setstate__(self, state):
        self.__init__(*state)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(found, values); values of what isn't found mean nothing."""
        slot = self._slot(keys)
        there = self.keys[slot]
        hit = there == keys
        value = None if self.values is None else self.values[slot]
        left = np.flatnonzero(~hit & (there != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            found = there == keys[left]
            hit[left[found]] = True
            if value is not None:
                value[left[found]] = self.values[slot[found]]
            go = ~found & (there != _EMPTY)
            left, slot = left[go], slot[go]
        return hit, value
