"""Cuckoo filter of 128-bit keys: four 16-bit fingerprints a bucket, insertion and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
LOAD = 0.9
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets_for(keys: int) -> int:
    need = max(1, int(keys / LOAD / SLOTS) + 1)
    return 1 << (need - 1).bit_length()


def key_words(keys: list[bytes]) -> np.ndarray:
    """Keys of 16 bytes as two unsigned integers each."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


class CuckooFilter:
    """Set of fingerprints; may answer yes for an absent key, never no for a present one."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # (buckets, SLOTS) of uint16, 0 is free

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((_buckets_for(keys), SLOTS), dtype=np.uint16))

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @property
    def count(self) -> int:
        return int(np.count_nonzero(self.slots))

    def _places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        marks = (words[:, 1] >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        first = words[:, 0] & mask
        return marks, first, first ^ self._jump(marks, mask)

    @staticmethod
    def _jump(marks: np.ndarray, mask: np.uint64) -> np.ndarray:
        return ((marks.astype(np.uint64) * _MIX) >> np.uint64(32)) & mask

    def contains(self, words: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(words)
        here = (self.slots[first] == marks[:, None]).any(axis=1)
        return here | (self.slots[second] == marks[:, None]).any(axis=1)

    def insert(self, words: np.ndarray) -> bool:
        """Adds keys, each at most once over the filter's life; False when it is too full."""
        marks, first, second = self._places(words)
        mask = np.uint64(len(self.slots) - 1)
        turn = 0
        for mark, a, b in zip(marks.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = mark
                    break
            else:
                bucket = b
                for _ in range(KICKS):
                    turn = (turn + 1) % SLOTS
                    mark, self.slots[bucket, turn] = int(self.slots[bucket, turn]), mark
                    bucket ^= int(self._jump(np.array([mark], np.uint16), mask)[0])
                    free = np.flatnonzero(self.slots[bucket] == 0)
                    if len(free):
                        self.slots[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, words: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        marks, first, second = self._places(words)
        for mark, a, b in zip(marks.tolist(), first.tolist(), second.tolist()):
            for bucket in (a, b):
                held = np.flatnonzero(self.slots[bucket] == mark)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break


def filter_of(keys: list[bytes]) -> CuckooFilter:
    """A filter of distinct keys, doubled until all of them fit."""
    size = len(keys)
    while True:
        made = CuckooFilter.sized(size)
        if not keys or made.insert(key_words(keys)):
            return made
        size = 2 * size + SLOTS
