"""A minimal perfect hash over 64-bit keys, with a fingerprint and a count per key, in flat arrays.

Keys are tried on bit levels: on each, a key that alone hits a place sets its bit, the others go on to the next level. A
key's index is the number of bits set before its own. Building and probing are vectorised.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2, 64
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser, another one for each level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """`bits`: all levels' places, packed; `starts`: the first place of each level; `ranks`: bits set before each byte block."""

    BLOCK = 64

    def __init__(self, starts: np.ndarray, bits: np.ndarray):
        self.starts, self.bits = starts, bits
        ones = np.bitwise_count(bits).astype(np.uint32)
        self.ranks = np.concatenate(([0], np.cumsum(ones.reshape(-1, self.BLOCK).sum(axis=1)))).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys. After the last level nothing may be left; with 64 levels the odds against are astronomic."""
        starts, levels = [0], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = np.uint64(max(64, GAMMA * len(keys)))
            at = (mixed(keys, level) % size).astype(np.int64)
            hit = np.bincount(at, minlength=int(size))
            levels.append(hit == 1)
            keys = keys[hit[at] != 1]
            starts.append(starts[-1] + int(size))
        if len(keys):
            raise ValueError("equal keys")
        places = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
        bits = np.packbits(places, bitorder="little")
        return cls(np.array(starts, dtype=np.int64), np.pad(bits, (0, -len(bits) % cls.BLOCK)))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The keys' indexes; -1 for those that hit no bit. Keys outside the set may get the index of another."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level in range(len(self.starts) - 1):
            if not len(left):
                break
            size = np.uint64(self.starts[level + 1] - self.starts[level])
            at = (mixed(keys[left], level) % size).astype(np.int64) + self.starts[level]
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            place = at[hit]
            block = (place >> 3) // self.BLOCK
            rank = self.ranks[block].astype(np.int64)
            # Bits set within the block, up to the place.
            rows = self.bits.reshape(-1, self.BLOCK)[block]
            whole = np.arange(self.BLOCK) < ((place >> 3) % self.BLOCK)[:, None]
            rank += (np.bitwise_count(rows) * whole).sum(axis=1, dtype=np.int64)
            last = self.bits[place >> 3] & ((np.uint16(1) << (place & 7).astype(np.uint16)) - np.uint16(1)).astype(np.uint8)
            out[left[hit]] = rank + np.bitwise_count(last)
            left = left[~hit]
        return out


class CountedKeys:
    """One shard: 64-bit keys with a 64-bit fingerprint and a count each, probed by both numbers."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hashed, self.prints, self.counts = hashed, prints, counts

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> CountedKeys:
        hashed = PerfectHash.build(keys)
        at = hashed.index(keys)
        p, n = np.empty_like(prints), np.empty(len(keys), dtype=np.uint32)
        p[at], n[at] = prints, np.minimum(counts, 0xFFFFFFFF)
        return cls(hashed, p, n)

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The counts of the keys, 0 for those not in the shard."""
        if not len(self.prints):
            return np.zeros(len(keys), dtype=np.uint32)
        at = self.hashed.index(keys)
        safe = np.maximum(at, 0)
        return np.where((at >= 0) & (self.prints[safe] == prints), self.counts[safe], 0)

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.hashed.starts.tobytes(), self.hashed.bits.tobytes(), self.prints.tobytes(), self.counts.tobytes()

    @classmethod
    def unpacked(cls, starts: bytes, bits: bytes, prints: bytes, counts: bytes) -> CountedKeys:
        return cls(PerfectHash(np.frombuffer(starts, np.int64), np.frombuffer(bits, np.uint8)),
                   np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32))
