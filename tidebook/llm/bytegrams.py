"""Packed byte n-grams and back-off tables over them.

A position's key packs its byte and the ``order - 1`` bytes before it; bytes
before the text's start are zero. Shorter n-grams are the key's low bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidebook.llm.textbatch import chunks

_U = np.uint64


def position_keys(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Key of every byte of the chunk."""
    lengths = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(lengths) + 1) * (order - 1), lengths)
    padded = np.zeros(len(data) + len(lengths) * (order - 1), np.uint8)
    padded[at] = data
    keys = np.zeros(len(data), _U)
    for j in range(order - 1, -1, -1):
        keys = (keys << _U(8)) | padded[at - j]
    return keys


def low(keys: np.ndarray, size: int) -> np.ndarray:
    return keys & _U((1 << (8 * size)) - 1)


class HashIndex:
    """Row numbers of distinct keys, by open addressing in one array."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        pending, slot, step = np.arange(len(keys), dtype=np.int32), self._slot(keys), 0
        while len(pending):
            at = (slot + step) & self.mask
            free = self.table[at] == -1
            self.table[at[free]] = pending[free]
            left = self.table[at] != pending
            pending, slot = pending[left], slot[left]
            step += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        step = 1
        while len(open_):
            row = self.table[(slot[open_] + step) & self.mask]
            out[open_] = row
            open_ = open_[(row >= 0) & (self.keys[row] != keys[open_])]
            step += 1
        return out


class BackoffTable:
    """Values of n-grams with back-off, for one or several models side by side.

    ``grams[k]`` holds (keys, values) of k-grams; ``contexts[k]`` holds (keys,
    weights) of contexts of k bytes. A k-gram that is absent gets its context's
    weight (0 if absent) plus the value of its last k - 1 bytes. One-byte grams
    are complete. Values are logarithms, columns are models.
    """

    def __init__(self, unigrams: np.ndarray):
        self.unigrams = unigrams
        self.grams: dict[int, tuple[HashIndex, np.ndarray]] = {}
        self.contexts: dict[int, tuple[HashIndex, np.ndarray]] = {}

    def add(self, size: int, keys: np.ndarray, values: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> None:
        self.grams[size] = HashIndex(keys), values.astype(np.float32)
        self.contexts[size - 1] = HashIndex(contexts), weights.astype(np.float32)

    def plain(self) -> tuple:
        """The table as arrays only, for a broadcast that workers read without this package."""
        parts = [{k: (i.keys, i.table, i.shift, i.mask, v) for k, (i, v) in part.items()} for part in (self.grams, self.contexts)]
        return self.unigrams, *parts

    @classmethod
    def restore(cls, plain: tuple) -> BackoffTable:
        out = cls(plain[0])
        for part, into in ((plain[1], out.grams), (plain[2], out.contexts)):
            for k, (keys, table, shift, mask, values) in part.items():
                index = HashIndex.__new__(HashIndex)
                index.keys, index.table, index.shift, index.mask = keys, table, shift, mask
                into[k] = index, values
        return out

    def values(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Value of the last ``size`` bytes of each key, one column per model."""
        if size == 1:
            return self.unigrams[low(keys, 1).astype(np.int64)]
        short = low(keys, size)
        index, table = self.grams[size]
        row = index.find(short)
        out = table[row]
        gap = np.flatnonzero(row < 0)
        if len(gap):
            index, weights = self.contexts[size - 1]
            ctx = index.find(short[gap] >> _U(8))
            fall = weights[ctx]
            fall[ctx < 0] = 0
            out[gap] = fall + self.values(short[gap], size - 1)
        return out


def gram_counter(order: int, group: str | None = None, limit: int = 1 << 18, table: np.ndarray | None = None):
    """A mapInArrow function: (group, gram, n) of the text column, combined per task
    and emitted whenever about ``limit`` distinct grams are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            order_ = np.argsort(keys)
            keys = keys[order_]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(counts[order_], first)

        def emit() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, counts = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["grp", "gram", "n"])
            held.clear()

        for batch in batches:
            names = np.array(batch.column(group).to_pylist(), object) if group else None
            for lo, hi, data, offsets in chunks(batch.column("text")):
                keys = position_keys(data if table is None else table[data], offsets, order)
                which = np.repeat(names[lo:hi], np.diff(offsets)) if group else None
                for name in sorted(set(names[lo:hi].tolist())) if group else [None]:
                    part = keys[which == name] if group else keys
                    if len(part):
                        uniq, n = np.unique(part, return_counts=True)
                        held.setdefault(name, []).append((uniq, n.astype(np.int64)))
                        size += len(uniq)
                if size > 4 * limit:
                    for name in held:
                        held[name] = [merge(held[name])]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > limit:
                        yield from emit()
                        size = 0
        yield from emit()

    return run, "grp string, gram long, n long"
