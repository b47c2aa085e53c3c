"""Elias-Fano codes of non-decreasing integers: near-minimal space, constant-time ``select``.

The low ``l = floor(log2(u / n))`` bits of each value are stored as they are; the high parts are the
gaps between ones of a bit vector. ``select`` finds the i-th one from a sample of every 256th one's
place, kept in 32 bits, and a scan of a few words.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        """``values``: non-decreasing and not negative."""
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        places = (np.arange(bits, dtype=np.uint64))[None, :]
        low = np.packbits(((v[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)  # at most 3 n
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        return cls(n, bits, low, np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _select1(self, i: int) -> int:
        """Place of the i-th one."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:])
            if left < len(ones):
                return byte * 8 + skip + int(ones[left])
            left -= len(ones)
            byte, skip = byte + 64, 0

    def select(self, i: int) -> int:
        """The i-th value."""
        value = self._select1(i) - i
        first = i * self.low_bits
        part = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 :][: self.low_bits]
        return (value << self.low_bits) | int(sum(int(b) << k for k, b in enumerate(part)))

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``: each from the word of the bit vector that its sample and a count of ones lead to."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        words = np.frombuffer(self.high.tobytes() + bytes(-len(self.high) % 8 + 8), "<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        start = self.samples[i // SAMPLE].astype(np.int64) // 64  # no one of that place stands before its sample
        at = np.maximum(start, np.searchsorted(before, i, "right") - 1)
        left, word, place = i - before[at], words[at], at * 64
        for width in (32, 16, 8, 4, 2, 1):  # halve the word until one bit is left
            half = word & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(half).astype(np.int64)
            up = left >= ones
            left, place = left - np.where(up, ones, 0), place + np.where(up, width, 0)
            word = np.where(up, word >> np.uint64(width), half)
        value = (place - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.concatenate([self.low, np.zeros(9, np.uint8)])
            bit = i * self.low_bits
            part = np.zeros(len(i), np.uint64)
            for k in range(8):
                part |= low[bit // 8 + k].astype(np.uint64) << np.uint64(8 * k)
            part >>= (bit % 8).astype(np.uint64)
            if self.low_bits > 57:
                over = (bit % 8).astype(np.uint64)
                part |= np.where(over > 0, low[bit // 8 + 8].astype(np.uint64) << ((np.uint64(64) - over) % np.uint64(64)), np.uint64(0))
            value |= part & np.uint64((1 << self.low_bits) - 1)
        return value

    def decode(self) -> np.ndarray:
        """All values."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high.astype(np.int64) << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int = 0) -> tuple["EliasFano", int]:
        """The code that starts at ``at``, and where it ends."""
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c
