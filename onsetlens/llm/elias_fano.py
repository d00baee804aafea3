"""Elias-Fano code of an ascending sequence of whole numbers, with select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64  # every so many-th one bit of the upper part has its position kept
_HEAD = "<qqbq"  # n, base, width, bytes of the low part


class EliasFano:
    """n values over a universe u in about n * (2 + log2(u / n)) bits.

    The low bits of each value stand side by side; the high parts are written in unary, value i
    as a one at position high(i) + i.  ``select`` finds that position from the nearest sample.
    """

    def __init__(self, n: int, base: int, width: int, low: bytes, high: bytes):
        self.n, self.base, self.width, self.low, self.high = n, base, width, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        if not len(values):
            return cls(0, 0, 0, b"", b"")
        base = int(values[0])
        gaps = (values - base).view(np.uint64)  # right also where the span passes 2^63
        width = max(0, int(gaps[-1]) // len(values)).bit_length()
        low = b""
        if width:
            bits = (gaps[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (gaps >> np.uint64(width)).astype(np.int64) + np.arange(len(values))
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(len(values), base, width, low, np.packbits(unary, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        return struct.pack(_HEAD, self.n, self.base, self.width, len(self.low)) + self.low + self.high

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, width, size = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        return cls(n, base, width, data[at : at + size], data[at + size :])

    def _low_part(self, i: int) -> int:
        first = i * self.width
        word = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8], "little")
        return (word >> (first % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value number i without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        if self._samples is None:
            counts = np.cumsum(np.bitwise_count(np.frombuffer(self.high, np.uint8)), dtype=np.int64)
            wanted = np.arange(0, self.n, SAMPLE) + 1
            self._samples = np.searchsorted(counts, wanted)  # byte that holds the sampled one
            self._before = counts[self._samples] - np.bitwise_count(np.frombuffer(self.high, np.uint8)[self._samples])
        byte, seen = int(self._samples[i // SAMPLE]), int(self._before[i // SAMPLE])
        while True:
            here = self.high[byte].bit_count()
            if seen + here > i:
                break
            seen, byte = seen + here, byte + 1
        bits = self.high[byte]
        for _ in range(i - seen):
            bits &= bits - 1
        position = byte * 8 + (bits & -bits).bit_length() - 1
        return self.base + (((position - i) << self.width) | self._low_part(i))

    def values(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        gaps = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
            gaps |= (bits.reshape(self.n, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return gaps.view(np.int64) + self.base
