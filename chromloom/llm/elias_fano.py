"""Monotone sequences in Elias-Fano form, queried for many values at once (numpy; the arrays may be memory-mapped)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: For each byte and k: the place of its k-th set bit.
PLACES = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """values of `width` bits, end to end in 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, U64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U64)
        v = values.astype(U64)
        np.bitwise_or.at(out, word, v << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U64(64) - shift[over]))
    return out


def unpack_bits(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U64)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(U64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return (low | high) & U64(2**width - 1)


class EliasFano:
    """Each value's low bits stand in `low`; its high part is a unary gap in `high`, with counts of ones before each word in `ones`."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        places = (values >> width) + np.arange(n)
        bits = np.zeros((((int(places[-1]) if n else 0) + (top >> width) - (int(values[-1]) >> width if n else 0) + 2) // 64 + 1) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, width, pack_bits(values & (2**width - 1), width), high, ones)

    def _select(self, k: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the k-th set bit of `high` (flip: unset bit), from 0."""
        directory = self.zeros if flip else self.ones
        word = np.searchsorted(directory, k, side="right") - 1
        rest = (k - directory[word].astype(np.int64)).astype(np.int64)
        v = self.high[word]
        if flip:
            v = ~v
        place = np.zeros(len(k), np.int64)
        for half in (32, 16, 8):
            count = np.bitwise_count(v & U64(2**half - 1)).astype(np.int64)
            up = rest >= count
            rest = rest - np.where(up, count, 0)
            v = np.where(up, v >> U64(half), v & U64(2**half - 1))
            place += np.where(up, half, 0)
        return word * 64 + place + PLACES[v.astype(np.int64) & 255, rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, False) - i) << self.width) | unpack_bits(self.low, i, self.width).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first index whose value is x, or -1. The sequence must increase strictly around x."""
        x = np.asarray(x, np.int64)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        part = x >> self.width
        ask = np.flatnonzero(part < int(self.zeros[-1]))
        part = part[ask]
        first = np.where(part > 0, self._select(np.maximum(part - 1, 0), True) - (part - 1), 0)
        last = self._select(part, True) - part  # one past the values with this high part
        want = (x[ask] & (2**self.width - 1)).astype(U64)
        lo, hi = np.minimum(first, self.n), np.minimum(last, self.n)
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            less = unpack_bits(self.low, mid, self.width) < want[going]
            lo[going] = np.where(less, mid + 1, lo[going])
            hi[going] = np.where(less, hi[going], mid)
            going = going[lo[going] < hi[going]]
        there = np.flatnonzero(lo < np.minimum(last, self.n))
        there = there[unpack_bits(self.low, lo[there], self.width) == want[there]]
        out[ask[there]] = lo[there]
        return out
