"""Texts of an Arrow column as flat numpy arrays: words, lines and their 64-bit hashes, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Powers are made of two tables, of the low bits of an exponent and of the others, so what stays in memory is small.
_LOW = 16
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _series(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return powers_at(base, np.arange(n))


def powers_at(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**e modulo 2**64 for each exponent."""
    most = int(exponents.max(initial=0)) >> _LOW
    low, high = _tables.get(base, (None, np.zeros(0, np.uint64)))
    if low is None or len(high) <= most:
        low = _series(base, 1 << _LOW)
        high = _series(pow(base, 1 << _LOW, 1 << 64), max(16, 1 << most.bit_length()))
        _tables[base] = low, high
    return low[exponents & ((1 << _LOW) - 1)] * high[exponents >> _LOW]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as doubles in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class Texts:
    """Bytes of many texts side by side; a null text counts as empty."""

    def __init__(self, col: pa.Array, lower: bool = False):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = pc.fill_null(col, "") if col.null_count else col
        if pa.types.is_large_string(col.type):
            col = col.cast(pa.string())
        n = len(col)
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int32, n + 1 + col.offset)[col.offset :] if offs is not None and n else np.zeros(n + 1, np.int32)
        first, last = int(offs[0]), int(offs[-1])
        raw = np.frombuffer(data, np.uint8, last)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        self.n = n
        self.offsets = (offs - first).astype(np.int64)
        self.bytes = LOWER[raw] if lower else raw
        self._prefix: np.ndarray | None = None

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def breaks(self) -> np.ndarray:
        """True at the first byte of each text that has bytes."""
        out = np.zeros(len(self.bytes) + 1, bool)
        out[self.offsets] = True
        return out

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._prefix is None:
            terms = powers(_R, len(self.bytes))
            terms *= self.bytes.astype(np.uint64) + U(1)
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        p = self._prefix
        return mix((p[ends] - p[starts]) * powers_at(_RINV, starts))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words (runs of anything but ASCII white space) and the text each is in."""
        solid = ~SPACE[self.bytes]
        brk = self.breaks()
        prev = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
        starts = np.flatnonzero(solid & (~prev | brk[:-1]))
        ends = np.flatnonzero(solid & (~after | brk[1:])) + 1
        return starts, ends, self.doc_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the ``\\n``-split lines of texts that have bytes, and their text."""
        newline = np.flatnonzero(self.bytes == 10)
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        starts = np.sort(np.concatenate([filled, newline + 1]))
        starts = starts[starts <= len(self.bytes)]
        # a line that starts where a text ends is that text's last, empty line: it has no word, so leave it out
        starts = np.unique(starts[starts < len(self.bytes)]) if len(self.bytes) else starts[:0]
        ends = np.minimum(np.concatenate([starts[1:], [len(self.bytes)]]), len(self.bytes)) if len(starts) else starts
        ends = np.where((ends > starts) & (self.bytes[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(starts) else ends
        return starts, ends, self.doc_of(starts)


def ngram_hash(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` items that stay within one text, and a mask of the positions where one starts."""
    size = len(h)
    ok = np.zeros(size, bool)
    if size < n:
        return np.zeros(size, np.uint64), ok
    m = size - n + 1
    ok[:m] = doc[:m] == doc[n - 1 :]
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = acc * U(_R) + h[k : k + m]
    out = np.zeros(size, np.uint64)
    out[:m] = mix(acc)
    return out, ok
