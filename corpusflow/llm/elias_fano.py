"""Elias-Fano coding of non-decreasing integers, with a select structure.

``n`` values up to ``u`` take about ``n * (2 + log2(u / n))`` bits: the low bits are packed, the high
parts are written in unary.  Value ``i`` needs the position of the ``i``-th one bit; every
``SAMPLE``-th position is kept as 32 bits, and the few words after it are counted.  No table of
64-bit offsets is made to look a value up.
"""
from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
HEAD = struct.Struct("<QQBxxxIII")  # n, base, low bits, words of the low part, bytes of the high part, samples


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, any int64 range; the smallest becomes the base."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if not n:
        return HEAD.pack(0, 0, 0, 0, 0, 0)
    base = int(values[0])
    rest = (values - base).astype(np.uint64)
    top = int(rest[-1])
    low = max(0, (top // n).bit_length() - 1)
    words = _pack_low(rest, low)
    ones = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(ones[-1]) + 64) // 64 * 64, np.uint8)
    if len(bits) >= 2 ** 32:
        raise ValueError("a part this long has to be split")
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little")
    samples = ones[::SAMPLE].astype("<u4")
    return HEAD.pack(n, base & (2 ** 64 - 1), low, len(words), len(high), len(samples)) + words.tobytes() + high.tobytes() + samples.tobytes()


def _pack_low(rest: np.ndarray, low: int) -> np.ndarray:
    words = np.zeros((len(rest) * low + 127) // 64, "<u8")
    if low:
        part = rest & np.uint64((1 << low) - 1)
        at = np.arange(len(rest), dtype=np.uint64) * np.uint64(low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, part << shift)
        spill = shift + np.uint64(low) > 64
        np.bitwise_or.at(words, word[spill] + 1, part[spill] >> (np.uint64(64) - shift[spill]))
    return words


class Sequence:
    """Reads an encoded sequence from a buffer; ``size`` is its length in bytes."""

    def __init__(self, buffer, start: int = 0):
        self.n, base, self.low, words, high, samples = HEAD.unpack_from(buffer, start)
        self.base = base - 2 ** 64 if base >= 2 ** 63 else base
        at = start + HEAD.size
        self.words = np.frombuffer(buffer, "<u8", words, at)
        self.high = np.frombuffer(buffer, "<u8", high // 8, at + 8 * words)
        self.samples = np.frombuffer(buffer, "<u4", samples, at + 8 * words + high)
        self.size = HEAD.size + 8 * words + high + 4 * samples

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Position of the ``i``-th one bit of the high part, from 0."""
        start = int(self.samples[i // SAMPLE])
        missing = i % SAMPLE
        word = start // 64
        bits = int(self.high[word]) >> (start % 64) << (start % 64)
        while (count := bits.bit_count()) <= missing:
            missing -= count
            word += 1
            bits = int(self.high[word])
        for _ in range(missing):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = (self.select(i) - i) << self.low
        if self.low:
            word, shift = divmod(i * self.low, 64)
            both = int(self.words[word]) | int(self.words[word + 1]) << 64
            value |= both >> shift & ((1 << self.low) - 1)
        return self.base + value

    def run(self, first: int, stop: int) -> np.ndarray:
        """Values ``first`` to before ``stop``: select finds the ends, the words between them are scanned."""
        if not 0 <= first <= stop <= self.n:
            raise IndexError((first, stop))
        if first == stop:
            return np.empty(0, np.int64)
        begin, end = self.select(first), self.select(stop - 1)
        words = self.high[begin // 64:end // 64 + 1].view(np.uint8)
        ones = np.flatnonzero(np.unpackbits(words, bitorder="little")) + begin // 64 * 64
        ones = ones[np.searchsorted(ones, begin):][:stop - first]
        index = np.arange(first, stop)
        value = (ones - index) << self.low
        if self.low:
            at = index.astype(np.uint64) * np.uint64(self.low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = self.words[word] >> shift
            spill = shift + np.uint64(self.low) > 64
            part[spill] |= self.words[word[spill] + 1] << (np.uint64(64) - shift[spill])
            value |= (part & np.uint64((1 << self.low) - 1)).astype(np.int64)
        return value + self.base

    def all(self) -> np.ndarray:
        """Every value."""
        return self.run(0, self.n)
