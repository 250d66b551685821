"""Elias-Fano coded monotone sequences over plain byte buffers, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _SELECT[byte, k]: place of the k-th set bit of a byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _k] = _i

U = np.uint64


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, side by side, in 64-bit words (one word to spare)."""
    if not bits or not len(values):
        return np.zeros(1, np.uint64)
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    v = values.astype(np.uint64) & U((1 << bits) - 1)
    np.bitwise_or.at(out, word, v << shift)
    over = shift + U(bits) > 64
    np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, a popcount directory for select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks
        self.zeros = np.arange(len(ranks), dtype=np.int64) * 64 - ranks
        self.bytes = high.view(np.uint8)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        ones = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(universe) >> low_bits) + n + 2
        high = np.zeros(size // 64 + 2, np.uint64)
        np.bitwise_or.at(high, ones >> 6, U(1) << (ones & 63).astype(np.uint64))
        counts = _POP[high.view(np.uint8)].reshape(-1, 8).sum(axis=1)
        return cls(n, low_bits, _pack(values, low_bits), high, np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.ranks)], np.int64), self.low, self.high, self.ranks]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Places of the k-th set (or clear) bits."""
        word = np.searchsorted(self.ranks if ones else self.zeros, k, side="right") - 1
        left = (k - (self.ranks if ones else self.zeros)[word]).astype(np.int64)
        place = word * 64
        byte = word * 8
        todo = np.arange(len(k))
        while len(todo):
            b = self.bytes[byte[todo]]
            have = _POP[b if ones else b ^ 0xFF]
            more = left[todo] >= have
            go = todo[more]
            left[go] -= have[more]
            byte[go] += 1
            place[go] += 8
            todo = go
        b = self.bytes[byte]
        return place + _SELECT[b if ones else b ^ 0xFF, left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        v = self.low[word] >> shift
        spill = shift + U(self.low_bits) > 64
        v[spill] |= self.low[word[spill] + 1] << (U(64) - shift[spill])
        return v & U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << U(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the least i with value(i) >= x; n where there is none."""
        x = np.asarray(x, np.uint64)
        high, low = (x >> U(self.low_bits)).astype(np.int64), x & U((1 << self.low_bits) - 1)
        lo = np.zeros(len(x), np.int64)
        some = high > 0
        lo[some] = self._select(high[some] - 1, False) - (high[some] - 1)
        hi = self._select(high, False) - high
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # inside the bucket of equal high bits
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        return lo


def dump(arrays: list[np.ndarray]) -> bytes:
    """Arrays after one another, each at a multiple of 8 bytes, behind a table of kinds and lengths."""
    head = [len(arrays)]
    body = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        head += [ord(a.dtype.char), a.dtype.itemsize, len(a)]
        body.append(raw + b"\0" * (-len(raw) % 8))
    return np.array(head, np.int64).tobytes() + b"".join(body)


def load(buffer) -> list[np.ndarray]:
    """The arrays of ``dump`` as views of the buffer; nothing is copied."""
    n = int(np.frombuffer(buffer, np.int64, 1)[0])
    head = np.frombuffer(buffer, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for code, size, length in head.tolist():
        out.append(np.frombuffer(buffer, np.dtype(chr(code)), length, at))
        at += size * length + -(size * length) % 8
    return out


def read(arrays: list[np.ndarray]) -> EliasFano:
    meta = arrays.pop(0)
    return EliasFano(int(meta[0]), int(meta[1]), arrays.pop(0), arrays.pop(0), arrays.pop(0))
