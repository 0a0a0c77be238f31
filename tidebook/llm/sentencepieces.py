"""SentencePiece encoding and decoding.

The piece ids are those of the vocabulary's own method:

* A BPE model (:class:`MergeEncoder`): an Aho-Corasick automaton over the pieces
  reads the text once and reports every piece in it. Of all neighbours that
  together are a piece, those of the highest score, the leftmost first, become
  one, until no neighbours are a piece. Scores are merge ranks here, whose sum
  means nothing.
* A unigram model (:class:`Encoder`): the segmentation of largest total score, by
  Viterbi over the matches of the same automaton, each of which relaxes the best
  score at its end from the best score at its start. A character without a piece
  of its own costs ``UNKNOWN`` less than the worst piece.

A character without a piece becomes its UTF-8 bytes. The ids equal those of
SentencePiece for a model that keeps all characters and puts a space first;
other models are refused.

Where no piece can cross a cut, the pieces of a text are the pieces of its
parts put together. This is checked on the vocabulary: no piece holds a
space mark after another character, and line feeds stand in no longer piece.
Parts between such cuts are mostly words, and repeat: each chunk of about ``CHUNK``
bytes is cut in bulk, its distinct parts are searched together, ``BLOCK`` at a
time (those of more than ``SHORT`` characters one by one), and their ids are laid
out for all rows.

Decoding joins pieces and bytes, so it restores the text exactly. A literal
space mark (U+2581) in a text is encoded as bytes for that reason, where
SentencePiece makes it a space.

The vocabulary file is read by the driver at the path given and sent to the
tasks as a list of pieces, whose size the file fixes. Null text has null
pieces, empty text has none. Rows may repeat; other columns are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.llm.textbatch import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MARK_BYTES = MARK.encode()
UNKNOWN = 10.0
SHORT = 64
BLOCK = 1 << 14
CHUNK = 4 << 20
NEVER = (1 << 31) - 1


def vocabulary(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, byte) by id; byte is -1 for text pieces and -2 for control ones."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: int(sp.id_to_piece(i)[1:-1], 16) if sp.is_byte(i) else -2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else -1
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def merges(path: str = MODEL) -> bool:
    """Whether the model is a BPE one; an error for one whose ids this module does not give."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind, norm = model.trainer_spec.model_type, model.normalizer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
    if not plain or kind not in (1, 2) or any(p.type in (4, 5) for p in model.pieces):
        raise ValueError(f"{path}: only unigram and BPE models without normalisation, user-defined or unused pieces are read")
    return kind == 2


class Encoder:
    """Piece ids of the rows of a chunk (bytes with row offsets)."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.byte_ids = np.zeros(256, np.int32)
        texts = {i: p for i, (p, _, byte) in enumerate(pieces) if byte == -1 and p}
        for i, (_, _, byte) in enumerate(pieces):
            if byte >= 0:
                self.byte_ids[byte] = i
        for i, piece in texts.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.size = np.array([len(p) for p, _, _ in pieces], np.int64)
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = min([0.0, *(pieces[i][1] for i in texts)]) - UNKNOWN
        self.at_spaces = not any(MARK in p.lstrip(MARK) for p in texts.values())
        self.at_newlines = not any("\n" in p and len(p) > 1 for p in texts.values())
        self.apart = not any("\0" in p for p in texts.values())

    def _bytes_of(self, char: str) -> bytes:
        return char.encode("utf-8", "surrogateescape")

    def search(self, part: str) -> np.ndarray:
        """Single-pass Viterbi over one part of any length."""
        n = len(part)
        score = [float("-inf")] * (n + 1)
        back = [(0, 0)] * (n + 1)
        score[0] = 0.0
        at, sizes, scores = 0, self.size, self.score
        for end, i in self.automaton.iter(part):
            while at <= end:  # any character may become bytes
                score[at + 1], back[at + 1] = score[at] + self.unknown, (1, -1)
                at += 1
            size = int(sizes[i])
            s = score[end + 1 - size] + float(scores[i])
            if s > score[end + 1]:
                score[end + 1], back[end + 1] = s, (size, i)
        for k in range(at + 1, n + 1):
            score[k], back[k] = score[k - 1] + self.unknown, (1, -1)
        out: list[int] = []
        while n:
            size, i = back[n]
            out.extend([i] if i >= 0 else self.byte_ids[list(self._bytes_of(part[n - 1]))].tolist()[::-1])
            n -= size
        return np.array(out[::-1], np.int32)

    def search_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same search over many short parts, none empty, at once: ids of all, and their number per part.

        The automaton reads the parts in one pass, with a character between
        them that no piece has. Its matches are edges between text positions;
        those that end at the same depth of their parts are relaxed together.
        """
        text = "\0".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths + 1) - lengths - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        piece = found[:, 1]
        end = found[:, 0] + 1
        # Any character may become bytes; such an edge comes first among equals.
        plain = np.ones(len(text), bool)
        plain[(starts + lengths)[:-1]] = False
        plain = np.flatnonzero(plain) + 1
        end, piece = np.append(plain, end), np.append(np.full(len(plain), -1), piece)
        size = np.where(piece < 0, 1, self.size[piece])
        gain = np.where(piece < 0, self.unknown, self.score[piece])
        order = np.argsort(end, kind="stable")
        depth = (end - starts[np.searchsorted(starts, end - 1, "right") - 1]).astype(np.uint16)
        order = order[np.argsort(depth[order], kind="stable")]
        end, piece, size, gain, depth = end[order], piece[order], size[order], gain[order], depth[order]
        score = np.full(len(text) + 1, -np.inf)
        score[starts] = 0.0
        back = np.zeros(len(text) + 1, np.int64)
        new = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(end))))
        level = np.flatnonzero(np.append(True, depth[1:] != depth[:-1]))
        for a, b in zip(level, np.append(level[1:], len(end)), strict=True):
            total = score[end[a:b] - size[a:b]] + gain[a:b]
            g = group[a:b] - group[a]
            most = np.maximum.reduceat(total, new[group[a] : group[b - 1] + 1] - a)
            top = np.flatnonzero(total == most[g])
            top = top[np.append(True, g[top][1:] != g[top][:-1])] + a
            score[end[top]] = most
            back[end[top]] = top
        path = np.zeros(len(text) + 1, bool)
        at = starts + lengths
        first = starts
        while len(at):
            path[at] = True
            at = at - size[back[at]]
            more = at > first
            at, first = at[more], first[more]
        at = np.flatnonzero(path)
        return self._spelled(text, at, piece[back[at]].astype(np.int32), starts)

    def _spelled(self, text: str, at: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with bytes in place of -1, and their number per part, given the ends of all pieces."""
        width = np.ones(len(at), np.int64)
        raw = np.flatnonzero(ids < 0)
        if len(raw):
            spelled = [self._bytes_of(text[i - 1]) for i in at[raw]]
            width[raw] = [len(x) for x in spelled]
            ids = np.repeat(ids, width)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(np.searchsorted(starts, at - 1, "right") - 1, weights=width, minlength=len(starts)).astype(np.int64)

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sorted starts of the parts, given those of the rows."""
        cut = np.zeros(len(data), bool)
        cut[starts] = True
        if self.at_spaces:
            space = data == 0x20
            cut[1:] |= space[1:] & ~space[:-1]
            if self.at_newlines:
                line = data == 0x0A
                cut |= line
                cut[1:] |= line[:-1]
        # A literal space mark is a part of its own.
        mark = np.flatnonzero((data[:-2] == MARK_BYTES[0]) & (data[1:-1] == MARK_BYTES[1]) & (data[2:] == MARK_BYTES[2]))
        cut[mark] = True
        cut[mark[mark + 3 < len(data)] + 3] = True
        return np.flatnonzero(cut)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the row offsets into them. ``data`` has the leading space of each row."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        at = self.cuts(data, offsets[:-1][offsets[:-1] < offsets[1:]])
        ends = np.append(at, len(data))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        codes = parts.indices.to_numpy()
        texts = [MARK_BYTES if p == MARK_BYTES else p.decode("utf-8", "surrogateescape").replace(" ", MARK) for p in parts.dictionary.to_pylist()]
        lone = np.array([not self.apart or len(t) > SHORT or t == MARK_BYTES for t in texts])
        sizes = np.zeros(len(texts), np.int64)
        found = []
        short = np.flatnonzero(~lone)
        for lo in range(0, len(short), BLOCK):
            ids, sizes[short[lo : lo + BLOCK]] = self.search_all([texts[i] for i in short[lo : lo + BLOCK]])
            found.append(ids)
        for i in np.flatnonzero(lone):
            found.append(self.byte_ids[list(MARK_BYTES)] if texts[i] == MARK_BYTES else self.search(texts[i]))
            sizes[i] = len(found[-1])
        first = np.zeros(len(texts), np.int64)
        laid = np.append(short, np.flatnonzero(lone))
        first[laid] = np.cumsum(sizes[laid]) - sizes[laid]
        each = sizes[codes]
        done = np.cumsum(each)
        ids = np.concatenate(found)[np.repeat(first[codes] - (done - each), each) + np.arange(done[-1])]
        return ids, np.append(0, done)[np.searchsorted(at, offsets)]


class MergeEncoder(Encoder):
    """The same rows by the merge order of a BPE model."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        super().__init__(pieces)
        normal = np.array([byte == -1 and bool(p) for p, _, byte in pieces])
        self.most = int(self.size[normal].max(initial=1))
        # A place for -1 (no piece) at the end.
        self.rank = np.full(len(pieces) + 1, NEVER, np.int32)
        self.rank[:-1][normal] = np.unique(-self.score[normal], return_inverse=True)[1]
        self.of = {pieces[i][0]: (int(self.rank[i]), int(i)) for i in np.flatnonzero(normal)}

    def search(self, part: str) -> np.ndarray:
        """Merges of one part of any length, by a heap of neighbours."""
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (NEVER, -1)
        heap = [(r, a, a + 1, a + 2) for a in range(n - 1) if (r := self.of.get(part[a : a + 2], none)[0]) < NEVER]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if after[a] != b or after[b] != c:
                continue
            after[a], after[b] = c, -1
            p = before[a]
            if p >= 0 and (r := self.of.get(part[p:c], none)[0]) < NEVER:
                heapq.heappush(heap, (r, p, a, c))
            if c < n:
                before[c] = a
                if (r := self.of.get(part[a : after[c]], none)[0]) < NEVER:
                    heapq.heappush(heap, (r, a, c, after[c]))
        out: list[int] = []
        a = 0
        while a < n:
            i = self.of.get(part[a : after[a]], none)[1]
            out.extend([i] if i >= 0 else self.byte_ids[list(self._bytes_of(part[a]))].tolist())
            a = after[a]
        return np.array(out, np.int32)

    def search_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same merges over many short parts at once: each round makes the next merge of every part that has one."""
        text = "\0".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths + 1) - lengths - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        size = self.size[found[:, 1]]
        ids = np.full((len(text) + 1, self.most + 1), -1, np.int32)  # by start and size
        ids[found[:, 0] + 1 - size, size] = found[:, 1]
        part = np.repeat(np.arange(len(parts)), lengths)
        lo = np.arange(len(part)) + part
        hi = lo + 1

        def ranks(at: np.ndarray) -> np.ndarray:
            """Rank of the merge of each symbol with the one after it."""
            right = np.minimum(at + 1, len(lo) - 1)
            span = hi[right] - lo[at]
            fits = (at < right) & (part[at] == part[right]) & (span <= self.most)
            return np.where(fits, self.rank[ids[lo[at], np.minimum(span, self.most)]], NEVER)

        rank = ranks(np.arange(len(lo)))
        done = []
        while len(lo):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            many = np.diff(np.append(first, len(part)))
            low = np.repeat(np.minimum.reduceat(rank, first), many)
            over = low == NEVER
            hit = np.flatnonzero((rank == low) & ~over)
            hit = hit[np.append(True, part[hit][1:] != part[hit][:-1])] if len(hit) else hit
            hi[hit] = hi[hit + 1]
            done.append((lo[over], hi[over]))
            keep = ~over
            keep[hit + 1] = False
            hit = np.cumsum(keep)[hit] - 1
            lo, hi, part, rank = lo[keep], hi[keep], part[keep], rank[keep]
            new = np.append(hit, hit[hit > 0] - 1)
            rank[new] = ranks(new)
        lo, hi = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        return self._spelled(text, hi, ids[lo, hi - lo], starts)


class Decoder:
    """Bytes of piece ids."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.table = pa.array([bytes([b]) if b >= 0 else b"" if b == -2 else p.replace(MARK, " ").encode() for p, _, b in pieces], pa.large_binary())

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, each with its leading space, and the row offsets into them."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
        out = self.table.take(pa.array(ids))
        _, ends, data = out.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)
        return np.frombuffer(data, np.uint8, ends[-1]), ends[offsets]


def _lead(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a space before each that is not empty."""
    sizes = np.diff(offsets)
    moved = np.cumsum(sizes > 0)
    out = np.full(len(data) + int(moved[-1]), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(moved, sizes)] = data
    return out, offsets + np.append(0, moved)


def _with(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in columns] + [T.StructField(n, kind) for n, kind in columns.items()])


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", into: str = "pieces", check: str | None = None) -> DataFrame:
    """``docs`` with an array of piece ids and, if ``check`` names a column, whether they decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = MergeEncoder if merges(path) else Encoder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, to_bytes = kind(shared.value), Decoder(shared.value)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(text), CHUNK, CHUNK >> 10):
                part = batch.slice(lo, hi - lo)
                data, offsets = _lead(data, offsets)
                ids, ends = to_ids(data, offsets)
                null = np.append(part.column(text).is_null().to_numpy(zero_copy_only=False), False)
                rows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=null), pa.array(ids))
                cols = {n: part.column(n) for n in part.schema.names if n not in (into, check)} | {into: rows}
                if check:
                    back, where = to_bytes(ids, ends)
                    same = np.diff(where) == np.diff(offsets)
                    if not (same.all() and np.array_equal(back, data)):
                        same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(where[:-1], where[1:], offsets[:-1], offsets[1:], strict=True)])
                    cols[check] = pa.array(same)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, _with(docs, **{into: T.ArrayType(T.IntegerType())}, **({check: T.BooleanType()} if check else {})))


def decode(rows: DataFrame, path: str = MODEL, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of piece ids."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = Decoder(shared.value)
        for batch in batches:
            texts = []
            for x in batch.column(pieces):
                data = to_bytes(x.values.to_numpy(), np.array([0, len(x)]))[0] if x.is_valid else None
                texts.append(None if data is None else data[1:].tobytes().decode("utf-8", "replace"))
            cols = {n: batch.column(n) for n in batch.schema.names if n != into} | {into: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return rows.mapInArrow(run, _with(rows, **{into: T.StringType()}))


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` with ``pieces`` and ``restored``: whether decoding gives the text back (null text: true)."""
    # One pass: a chain of two Python steps would hold two workers a task.
    return encode(docs, path, check="restored")
