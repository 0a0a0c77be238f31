"""Token counts of whole texts under a byte-level BPE vocabulary, without encoding them.

Tasks hold a batch of pre-tokens as one ragged numpy array: all symbols in a
row, with the start of each sequence. In every round each sequence finds the
lowest merge rank among its pairs and merges all its occurrences at once (left
to right where they overlap); sequences without a merge left are taken out and
their surviving symbols counted. A merge only makes pairs of higher rank, so
this ends where merging one pair at a time would. A round costs one pass over
the unfinished symbols and there are at most as many rounds as the longest
sequence has merges; sequences beyond ``LONG`` symbols keep linked positions
per rank instead, so that a round touches only the pairs it changes.

Texts are cut into pre-tokens by the vocabulary's pattern. Each worker keeps
the counts of at most ``KEPT`` short pre-tokens it has seen. Long texts are
read in parts, cut before a space that follows other text, where no pre-token
reaches across. Strings of added tokens inside a text count as one token each
and end the pre-tokens beside them, as the tokenizer does by default.

The vocabulary is a tokenizers file of fixed size, read once on the driver and
broadcast; its path is a parameter, so that workers need no file.

A null text has no bytes and no tokens, as an empty one. Repeated rows, null
ids and ties get a row each. An empty table gives no rows. Columns other than
doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of the byte-level vocabulary; white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

PART = 1 << 20
LONG = 2048
KEPT = 1 << 19
SHORT = 64
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(free)) for b in range(256)]


def vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE tokenizers file; other kinds of file are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter = spec["model"], spec["pre_tokenizer"] or {}
    plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    added = spec.get("added_tokens") or []
    if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec["normalizer"] or not plain:
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path}: added tokens that take white space or whole words are not supported")
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    keys = left << 32 | right
    order = np.argsort(keys)
    return {
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "made": np.array([ids[a + b] for a, b in pairs], np.int32),
        "bytes": np.array([ids[c] for c in byte_symbols()], np.int32),
        "added": sorted((t["content"] for t in added), key=len, reverse=True),
    }


class PairMerger:
    """Counts the symbols that are left of byte sequences after all merges."""

    def __init__(self, vocab: dict) -> None:
        self.keys, self.ranks, self.made, self.bytes = (vocab[k] for k in ("keys", "ranks", "made", "bytes"))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    @staticmethod
    def _every_other(linked: np.ndarray) -> np.ndarray:
        """Of runs of places where each is linked to the one before, the first, third, ... of each run."""
        at = np.arange(len(linked))
        return (at - np.maximum.accumulate(np.where(linked, 0, at))) % 2 == 0

    def counts(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._long(self.bytes[np.frombuffer(words[i], np.uint8)])
        ids = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        if len(ids):
            data = b"".join(words if len(ids) == len(words) else [words[i] for i in ids.tolist()])
            self._ragged(self.bytes[np.frombuffer(data, np.uint8)], sizes[ids], ids, out)
        return out

    def _ragged(self, symbols: np.ndarray, sizes: np.ndarray, ids: np.ndarray, out: np.ndarray) -> None:
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[starts[1:] - 1] = _NONE  # no pair reaches into the next sequence
            best = np.minimum.reduceat(rank, starts)
            live = best != _NONE
            out[ids[~live]] = sizes[~live]
            sequence = np.repeat(np.arange(len(ids)), sizes)
            hits = np.flatnonzero((rank == best[sequence]) & (rank != _NONE))
            linked = np.zeros(len(hits), bool)
            linked[1:] = hits[1:] == hits[:-1] + 1
            hits = hits[self._every_other(linked)]
            symbols[hits] = self.made[rank[hits]]
            keep = live[sequence]
            keep[hits + 1] = False
            merged = np.bincount(sequence[hits], minlength=len(ids))
            symbols, sizes, ids = symbols[keep], (sizes - merged)[live], ids[live]

    def _long(self, symbols: np.ndarray) -> int:
        """The same rounds for one long sequence, over the positions of the rank in hand only."""
        n = left = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, _NONE, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(places: np.ndarray) -> None:
            places = places[rank[places] != _NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            values, first = np.unique(rank[places], return_index=True)
            for r, group in zip(values.tolist(), np.split(places, first[1:]), strict=True) if len(values) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(group)

        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            hits = np.unique(np.concatenate(waiting.pop(r)))
            hits = hits[rank[hits] == r]
            linked = np.zeros(len(hits), bool)
            linked[1:] = after[hits[:-1]] == hits[1:]
            hits = hits[self._every_other(linked)]
            gone = after[hits]
            symbols[hits], rank[gone] = self.made[r], _NONE
            after[hits] = after[gone]
            has_next = after[hits] < n
            before[after[hits][has_next]] = hits[has_next]
            left -= len(hits)
            changed = np.unique(np.concatenate([hits, before[hits][before[hits] >= 0]]))
            inner = after[changed] < n
            rank[changed] = _NONE
            rank[changed[inner]] = self._rank(symbols[changed[inner]], symbols[after[changed[inner]]])
            note(changed)
        return left


class TokenCounter:
    """Token counts of texts; remembers short pre-tokens."""

    def __init__(self, vocab: dict) -> None:
        self.merger = PairMerger(vocab)
        self.cut = regex.compile(PATTERN).findall
        self.added = regex.compile("|".join(regex.escape(t) for t in vocab["added"])) if vocab["added"] else None
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> Iterator[str]:
        """Stretches of about ``PART`` characters that no pre-token reaches across."""
        at = 0
        while len(text) - at > PART:
            end = at + PART
            # A space after something that is not white space begins a pre-token.
            while (end := text.find(" ", end)) > 0 and text[end - 1].isspace():
                end += 1
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def __call__(self, texts: list[str]) -> list[int]:
        counts, cells = [0] * len(texts), []
        for i, text in enumerate(texts):
            pieces = [text]
            if self.added is not None and (found := self.added.split(text))[1:]:
                counts[i] += len(found) - 1
                pieces = found
            for piece in pieces:
                for part in self.parts(piece):
                    cells.append((i, self.cut(part)))
                    if len(part) > PART // 4:
                        self._add(cells, counts)
        self._add(cells, counts)
        return counts

    def _add(self, cells: list[tuple[int, list[str]]], counts: list[int]) -> None:
        new = list(set().union(*(tokens for _, tokens in cells)).difference(self.known))
        if new:
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
                new = list(set().union(*(tokens for _, tokens in cells)))
            self.known.update(zip(new, self.merger.counts([t.encode() for t in new]).tolist(), strict=True))
        known = self.known.__getitem__
        for i, tokens in cells:
            counts[i] += sum(map(known, tokens))
        for t in new:
            if len(t) > SHORT:
                del self.known[t]
        cells.clear()


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of about ``PART`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        base = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, base + PART, "right")))
        yield texts.slice(row, end - row)
        row = end


def token_counts(docs: DataFrame, path: str, max_tokens: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens = [n for part in _slices(texts) for n in counter([t or "" for t in part.to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > max_tokens)
