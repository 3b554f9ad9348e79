"""A minimal perfect hash over 64-bit keys, in numpy, with stored fingerprints.

Levels of bit arrays: a key takes a bit of the first level where no other key falls on its place; the rest go on to the next.
Its slot is the number of set bits before it, so n keys fill slots 0..n-1, and a lookup touches one place a level (1.3 on
average). Keys that still collide after the last level, which only equal 64-bit hashes can bring about, are refused.
"""

from __future__ import annotations

import numpy as np

from .common import mix

LEVELS = 40
_SEED = 0x9E3779B97F4A7C15


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64(_SEED * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum([-(-s // 64) for s in sizes])]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct 64-bit hashes."""
        sizes, parts, left = [], [], np.asarray(keys, np.uint64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, 2 * len(left))
            at = _place(left, level, size)
            times = np.bincount(at, minlength=size)
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[: len(times)] = times == 1
            sizes.append(size)
            parts.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[times[at] != 1]
        if len(left):
            raise ValueError(f"{len(left)} keys have equal hashes")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was not built in, any slot or -1."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = _place(keys[todo], level, size)
            word = self.starts[level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[found]] = (self.ranks[word] + np.bitwise_count(below))[found]
            todo = todo[~found]
            if not len(todo):
                break
        return out
