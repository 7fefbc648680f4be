"""Elias-Fano sequences in flat buffers, read in place, searched many values at a time."""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
#: Place of the n-th zero of a byte.
_ZERO_AT = np.array([([i for i in range(8) if not b >> i & 1] + [0] * 8)[:8] for b in range(256)], dtype=np.int64)


class EliasFano:
    """A rising sequence of n whole numbers under 2**62: the low bits of each are packed
    one after the other; the high parts are written in unary, value by value, so that a
    zero ends each high part's bucket. A directory counts the zeros before each word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n, most = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (most // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, dtype=np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = v & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (v >> np.uint64(bits)).astype(np.int64)
        marks = np.zeros((n + (most >> bits) + 1 + 63) // 64 * 64, dtype=np.uint8)
        marks[top + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        counts = 64 - marks.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        return cls(n, bits, low, high, np.concatenate(([0], np.cumsum(counts))).astype(np.int64)[:-1])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        found = self.low[word] >> shift
        over = shift > 0
        found[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return found & np.uint64((1 << self.bits) - 1)

    def _bucket_end(self, top: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most top."""
        word = np.searchsorted(self.zeros, top, side="right") - 1
        left = top - self.zeros[word]
        octets = self.high[word].reshape(-1, 1).view(np.uint8)
        free = np.cumsum(8 - _ONES[octets], axis=1)
        octet = (free <= left[:, None]).sum(axis=1)
        row = np.arange(len(top))
        before = np.where(octet > 0, free[row, octet - 1], 0)
        return word * 64 + octet * 8 + _ZERO_AT[octets[row, octet], left - before] - top

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: its bucket by the directory, the low bits by halving."""
        out = np.full(len(values), -1, dtype=np.int64)
        top = values.astype(np.int64) >> self.bits
        last = int(self.zeros[-1]) + int(64 - _ONES[self.high[-1:].view(np.uint8)].sum()) - 1 if self.n else -1
        at = np.flatnonzero((values >= 0) & (top < last))
        if not len(at):
            return out
        top = top[at]
        end, start = self._bucket_end(top), np.zeros(len(at), dtype=np.int64)
        start[top > 0] = self._bucket_end(top[top > 0] - 1)
        want, stop = values[at].astype(np.uint64) & np.uint64((1 << self.bits) - 1), end.copy()
        busy = np.flatnonzero(start < stop)
        while len(busy):
            middle = (start[busy] + stop[busy]) // 2
            less = self._low(middle) < want[busy]
            start[busy[less]], stop[busy[~less]] = middle[less] + 1, middle[~less]
            busy = busy[start[busy] < stop[busy]]
        inside = np.flatnonzero(start < end)
        same = inside[self._low(start[inside]) == want[inside]]
        out[at[same]] = start[same]
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The i-th values (whole sequence decoded once per call for many, by word for few)."""
        marks = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return ((marks[i] - i).astype(np.int64) << self.bits) | self._low(i).astype(np.int64)

    def values(self) -> np.ndarray:
        return self[np.arange(self.n)]

    def written(self) -> list[bytes]:
        return [np.array([self.n, self.bits, len(self.low), len(self.high)], dtype=np.int64).tobytes(), self.low.tobytes(), self.high.tobytes(), self.zeros.tobytes()]

    @classmethod
    def read(cls, buffer: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high = np.frombuffer(buffer, dtype=np.int64, count=4, offset=at).tolist()
        at += 32
        parts = []
        for kind, count in ((np.uint64, low), (np.uint64, high), (np.int64, high)):
            parts.append(np.frombuffer(buffer, dtype=kind, count=count, offset=at))
            at += 8 * count
        return cls(n, bits, *parts), at
