"""Minimal perfect hashing of 64-bit keys with a fingerprint array, in numpy.

Keys are thrown into a table of bits level by level; a key that meets no other at a level has its bit
there, the rest go on. The rank of a key's bit among all bits is its slot, where its fingerprint lies.
An index holds about 4 bits for the slots and 32 for the fingerprint of each key, and no key.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
FINGERPRINT_BITS = 32
_MAX_LEVELS = 64
_MIX_A, _MIX_B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64), another for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + _STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return x ^ (x >> np.uint64(31))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000) >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.uint32)


class PerfectIndex:
    """Answers for a set of distinct keys. A key of the set always hits; another hits by mistake with
    probability 2 ** -FINGERPRINT_BITS at most."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        self.ranks, before = [], 0
        for _, words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(counts) - counts)
            before += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectIndex:
        levels, left = [], np.asarray(keys, np.int64)
        for level in range(_MAX_LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[:size] = alone
            levels.append((size, np.packbits(bits, bitorder="little").view(np.uint64)))
            left = left[~alone[at]]
        else:
            raise ValueError("keys aren't distinct")
        index = cls(levels, np.zeros(len(keys), np.uint32))
        index.fingerprints[index.slots(keys)] = _fingerprints(np.asarray(keys, np.int64))
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it has none at any level."""
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, words) in enumerate(self.levels):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[level][at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots = self.slots(keys)
        hit = slots >= 0
        hit[hit] = self.fingerprints[slots[hit]] == _fingerprints(np.asarray(keys, np.int64)[hit])
        return hit

    def to_bytes(self) -> bytes:
        head = struct.pack("<q", len(self.levels)) + b"".join(struct.pack("<qq", size, len(words)) for size, words in self.levels)
        return head + b"".join(words.tobytes() for _, words in self.levels) + self.fingerprints.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectIndex:
        (n,) = struct.unpack_from("<q", blob)
        sizes = [struct.unpack_from("<qq", blob, 8 + 16 * i) for i in range(n)]
        at, levels = 8 + 16 * n, []
        for size, words in sizes:
            levels.append((size, np.frombuffer(blob, np.uint64, words, at)))
            at += 8 * words
        return cls(levels, np.frombuffer(blob, np.uint32, offset=at))
