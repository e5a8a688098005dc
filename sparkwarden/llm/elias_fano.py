"""Elias-Fano: a non-decreasing sequence of n numbers below u in about n (2 + log2(u / n)) bits, with access by index.

The low bits of every number are packed; the high bits are counted in unary, so number i ends at the i-th set bit. The
place of every 256th set bit is kept in 32 bits, which is all that access needs: there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
HEAD = struct.Struct("<QBIII")


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Of non-decreasing numbers from 0 on."""
        v = values.astype(np.uint64)
        n = len(v)
        width = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        places = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[places] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"), places[::STEP].astype(np.uint32))

    def packed(self) -> bytes:
        return HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.marks)) + self.marks.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpacked(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence stored at a place, and the place after it."""
        n, width, low, high, marks = HEAD.unpack_from(data, at)
        at += HEAD.size
        m = np.frombuffer(data, np.uint32, marks, at)
        lows = np.frombuffer(data, np.uint8, low, at + 4 * marks)
        highs = np.frombuffer(data, np.uint8, high, at + 4 * marks + low)
        return cls(n, width, lows, highs, m), at + 4 * marks + low + high

    def select(self, i: int) -> int:
        """Number i: from the nearest mark on, whole bytes are counted until the one with its bit."""
        place, left = int(self.marks[i // STEP]), i % STEP
        byte, bits = place >> 3, int(self.high[place >> 3]) >> (place & 7) << (place & 7)
        while left >= bits.bit_count():
            left -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        upper = byte * 8 + (bits & -bits).bit_length() - 1 - i
        first = i * self.low_bits
        window = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little") >> (first & 7)
        return upper << self.low_bits | window & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits) | low).astype(np.int64)
