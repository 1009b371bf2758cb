"""Elias-Fano coding of non-decreasing integers with a sampled select structure.

n values below a universe u take about 2 + log2(u / n) bits each: the low bits are packed, the
high bits are written in unary as one bit vector. ``select(i)`` starts at the nearest sampled one
bit and reads at most ``SAMPLE`` ones further, so a single value costs a bounded number of bytes and no table
of 64-bit offsets exists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 64
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass(frozen=True)
class EliasFano:
    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes  # little-endian unsigned 32-bit bit positions of every SAMPLE-th one

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = b""
        if low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def decode(self) -> np.ndarray:
        """All values."""
        if self.n == 0:
            return np.empty(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        v = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.low_bits, bitorder="little")
            weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
            v |= (bits.reshape(self.n, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        return v

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int.from_bytes(self.samples[i // SAMPLE * 4:i // SAMPLE * 4 + 4], "little")
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while left >= _POPCOUNT[word]:
            left -= int(_POPCOUNT[word])
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        window = int.from_bytes(self.low[first // 8:-(-last // 8)], "little") >> (first % 8)
        return (one - i) << self.low_bits | window & ((1 << self.low_bits) - 1)

    def size_bits(self) -> int:
        return 8 * (len(self.low) + len(self.high) + len(self.samples))
