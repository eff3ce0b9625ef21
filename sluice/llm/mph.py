"""Minimal perfect hashing by cascaded bit arrays over 64-bit key hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
#: Bits of a level for each key that reaches it.
GAMMA = 2
#: Distinct 64-bit hashes part after a few dozen levels at the latest.
MOST_LEVELS = 200


def key_hash(key: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(key, seed)


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64(_STEP * (level + 1) & _MASK)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
        return x ^ (x >> np.uint64(32))


class MinimalPerfectHash:
    """Maps n distinct 64-bit hashes one to one onto 0..n-1 from about 2 * GAMMA bits a key.

    A key is settled at the first level where it has a bit to itself; its slot is the number of set bits before it.
    Keys outside the set get an arbitrary slot or -1: callers keep a key or a fingerprint in each slot to tell.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        """sizes: bits of each level; bits: of all levels one after the other, as booleans."""
        self.sizes, self.bits = sizes, bits
        self.n = int(bits.sum())
        self.starts = np.cumsum([0, *sizes])[:-1].tolist()
        self._slot = np.where(bits, np.cumsum(bits) - 1, -1).astype(np.int64)
        self._list: list[int] | None = None
        self._levels = [(size, start, _STEP * (level + 1) & _MASK) for level, (size, start) in enumerate(zip(sizes, self.starts, strict=True))]

    @classmethod
    def build(cls, hashes: np.ndarray) -> MinimalPerfectHash:
        """Raises ValueError where two hashes are equal. No keys: a function without slots."""
        left, sizes, levels = np.asarray(hashes, np.uint64), [], [np.zeros(0, bool)]
        if len(np.unique(left)) != len(left):
            raise ValueError("two keys have the same hash")
        while len(left):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("the keys don't part")
            size = max(64, GAMMA * len(left))
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels))

    def slot(self, h: int) -> int:
        if self._list is None:
            self._list = self._slot.tolist()
        slots = self._list
        for size, start, salt in self._levels:
            x = h ^ salt
            x = (x ^ (x >> 32)) * _MIX & _MASK
            at = slots[start + (x ^ (x >> 32)) % size]
            if at >= 0:
                return at
        return -1

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        hashes = np.asarray(hashes, np.uint64)
        found, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts, strict=True)):
            at = self._slot[start + (_mixed(hashes[left], level) % np.uint64(size)).astype(np.int64)]
            found[left] = at
            left = left[at < 0]
        return found
