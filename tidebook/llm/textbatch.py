"""Vectorised words and hashes over Arrow text columns.

All functions work on a chunk: a byte array with row offsets. A chunk holds
about ``CHUNK`` bytes (one row may be longer), so the arrays a task keeps stay
small whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
ROWS = 1024
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64


def chunks(column: pa.Array, size: int = CHUNK, rows: int = ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) per chunk; a null counts as empty."""
    for base in range(0, len(column), rows):
        # Small slices, so that the copy without nulls and with 64-bit offsets stays small.
        part = pc.fill_null(column.slice(base, rows).cast(pa.large_string()), "")
        _, offs, data = part.buffers()
        n = len(part)
        offsets = np.frombuffer(offs, np.int64, n + 1, part.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
            yield base + row, base + end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-space bytes within a row), and
    the index of the first word of each row, with the total at the end."""
    table = np.ones(256, bool)
    table[list(SPACE)] = False
    inside = table[data]
    first = inside.copy()
    last = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[cut] = inside[cut]
        cut = cut[cut > 0] - 1
        last[cut] = inside[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), applied in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHasher:
    """64-bit hash of each word by prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
        self.power = self.inverse = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, CHUNK + 1)
            self.power = self._powers(self.BASE, size)
            self.inverse = self._powers(pow(self.BASE, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, _U)
        factors[0] = 1
        return np.cumprod(factors)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.table[data] * self.power[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles; a row of
    fewer words has its whole sequence as one, a row without words has none."""
    factor = [pow(0xA0761D6478BD642F, j + 1, 1 << 64) | 1 for j in range(size)]
    out = []
    if len(words) >= size:
        windows = words[: len(words) - size + 1] * _U(factor[0])
        for j in range(1, size):
            windows = windows + words[j : len(words) - size + 1 + j] * _U(factor[j])
        windows = mix(windows)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            h = np.sort(windows[lo : hi - size + 1])
            keep = np.empty(len(h), bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h if keep.all() else h[keep])
        elif hi > lo:
            v = _U(hi - lo)
            with np.errstate(over="ignore"):
                for j, w in enumerate(words[lo:hi]):
                    v = v * _U(0x2545F4914F6CDD1D) + w * _U(factor[j])
            out.append(mix(np.array([v], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array: small numbers leave whole planes of zeros, which block compression removes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def unpack(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()
