"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct word shingles, each a 64-bit hash. Sets are
ordered rare tokens first, then frequent ones, each class by hash. Two sets of
Jaccard similarity t or more share a token of their prefixes of
n - ceil(t n) + 1 tokens. If a shared prefix token is rare, the single-token
index finds the pair. Otherwise both prefixes have run out of rare tokens; they
are then extended by m tokens, share m + 1 frequent tokens there, and two of
these fall into one of m sub-classes, so an index of two-token combinations
inside sub-classes finds the pair. Candidates are verified on whole sets.

* Rare is a measured property: fewer than ``frequent`` documents hold the
  token. If more than ``max_frequent`` tokens reach that count, the limit is
  doubled until they fit, so the broadcast list has a fixed size. The class of
  a token changes cost, never the result.
* Rare lists have fewer than ``frequent`` sets, so all their pairs are checked.
  Lists of combinations may be long: each set is first compared with four
  pivots of a few of its lists, and these links are merged. A list that still
  holds two components goes to the home of its smallest digest, where lists of
  one group of copies meet, so a set travels there once and not once a list. A
  home compares its sets inside a task and returns the links that join two of
  its components, at most one fewer than it has sets, never its pairs. A home
  of more than HOME_BYTES is dealt into tiles of two blocks each, which cover
  all its pairs. Every such list has a home, so no link between components is
  lost.
* Inside a task a parity bitmap, whose Hamming distance never exceeds the
  symmetric difference, rejects pairs before whole sets are compared.
* Exact copies (equal sets) are one node. Nodes are 64-bit digests of the set;
  among N distinct sets about N^2 / 2^65 pairs share a digest by chance (20 at
  27 billion documents).
* Large groups of tokens travel as byte planes in binary cells, one per task
  and hash range, so that Spark moves few rows.

Null or blank text: empty set, linked with nothing. Repeated rows are equal
sets. A null doc_id takes part in links but never names a component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import components
from tidebook.llm.keys import text_key
from tidebook.llm.textbatch import WordHasher, chunks, lower_ascii, mix, pack, shingle_hashes, unpack, word_bounds
from tidebook.session import cut_lineage

_U = np.uint64
FLUSH = 1 << 19
BITS = 26
TILE_BYTES = 16 << 20
PIVOTS = 4
SIZE = (1 << 31) - 1
#: What a task compares at once: bytes of tokens and SET_BYTES a set, which bounds its number of sets too.
HOME_BYTES = 16 << 20
SET_BYTES = 2048
#: Sets whose distances to all others are taken at once.
ROWS = 256


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Batch, row and sorted distinct shingle hashes of every row."""
    hasher = WordHasher()
    for batch in batches:
        for row, _, data, offsets in chunks(batch.column("text")):
            starts, ends, bounds = word_bounds(data, offsets)
            words = hasher(lower_ascii(data), starts, ends)
            for i, h in enumerate(shingle_hashes(words, bounds, size)):
                yield batch, row + i, h


def _digest(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _distinct_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Non-empty sets with their digests, equal ones of a task once (while remembered)."""
    seen: set[int] = set()
    for _, _, h in _sets(batches, size):
        if len(h):
            fp = _digest(h)
            if fp not in seen:
                if len(seen) >= FLUSH:
                    seen.clear()
                seen.add(fp)
                yield fp, h


def members(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, n, fp) per row of ``docs(doc_id, text, key)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, fps = [], [], []
        last = None
        for batch, row, h in _sets(batches, size):
            if last is not None and batch is not last:
                yield pa.RecordBatch.from_arrays([last.column("doc_id"), last.column("key"), pa.array(ns, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "key", "n", "fp"])
                ns, fps = [], []
            last = batch
            ns.append(len(h))
            fps.append(_digest(h) if len(h) else 0)
        if last is not None:
            yield pa.RecordBatch.from_arrays([last.column("doc_id"), last.column("key"), pa.array(ns, pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "key", "n", "fp"])

    return docs.mapInArrow(run, "doc_id long, key long, n long, fp long")


def frequent_tokens(docs: DataFrame, size: int, limit: int, most: int, parts: int) -> np.ndarray:
    """Sorted short keys (range and 32 more bits) of the tokens that at least
    ``limit`` documents hold, or a doubled limit that leaves at most ``most``."""
    shift = 32 - int(math.log2(parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) >> _U(shift), return_counts=True)
            cuts = np.searchsorted(keys >> _U(32), np.arange(parts + 1, dtype=_U))
            rows = [(p, pack(np.diff((keys[a:b] & _U(0xFFFFFFFF)).astype(np.uint32), prepend=np.uint32(0))), pack(n[a:b].astype(np.uint32)))
                    for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "keys", "counts"])

        held, n = [], 0
        for _, h in _distinct_sets(batches, size):
            held.append(h)
            n += len(h)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    def total(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(unpack(x, np.uint32), dtype=np.uint32) for x in table["keys"].to_pylist()])
        counts = np.concatenate([unpack(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = np.add.reduceat(counts[order], first)
        keep = sums >= limit
        part = table["part"][0].as_py()
        return pa.table({"key": (keys[first][keep].astype(np.int64) + (part << 32)), "df": sums[keep]})

    heavy = cut_lineage(docs.select("text").mapInArrow(count, "part int, keys binary, counts binary").groupBy("part").applyInArrow(total, "key long, df long"), "frequent")
    levels = {r[0]: r[1] for r in heavy.groupBy(F.floor(F.log2(F.col("df") / F.lit(limit))).cast("int")).count().collect()}
    level = 0
    while sum(n for k, n in levels.items() if k >= level) > most:
        level += 1
    keys = heavy.where(F.col("df") >= F.lit(limit << level)).select("key").toPandas()["key"].to_numpy()
    return np.sort(keys.astype(_U))


class _Prefix:
    """Prefix of a set, rare tokens first."""

    def __init__(self, percent: int, frequent: np.ndarray, parts: int):
        self.percent, self.frequent, self.shift = percent, frequent, _U(32 - int(math.log2(parts)))

    def split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rare tokens and frequent tokens (each by hash) and the base prefix's length."""
        base = len(h) - (self.percent * len(h) + 99) // 100 + 1
        if not len(self.frequent):
            return h, h[:0], base
        short = h >> self.shift
        at = np.minimum(np.searchsorted(self.frequent, short), len(self.frequent) - 1)
        hit = self.frequent[at] == short
        return h[~hit], h[hit], base

    def combinations(self, h: np.ndarray) -> np.ndarray:
        """Signatures of two frequent tokens of a sub-class, if the base prefix holds frequent tokens.

        The number of sub-classes follows the size, in powers of two; a set is
        indexed for its own power and for those that similar sets can have. The
        lowest six bits of a signature tell the power.
        """
        rare, freq, base = self.split(h)
        n, p = len(h), self.percent
        if len(rare) >= base or n < 2:
            return h[:0]
        out = []
        for bucket in sorted({int(math.log2(x)) for x in ((p * n + 99) // 100, n, 100 * n // p)}):
            m = max(1, (1 << bucket) // 8)
            part = freq[: max(0, base + m - len(rare))]
            sub = (mix(part ^ _U(bucket + 1)) % _U(m)).astype(np.int64)
            order = np.argsort(sub, kind="stable")
            part, sub = part[order], sub[order]
            cuts = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    x = part[a:b]
                    out.append((mix(x[i] * _U(0x8CB92BA72F3D8DD7) + x[j] * _U(0xAAAAAAAAAAAAAAAB)) & ~_U(63)) | _U(bucket))
        return np.concatenate(out) if out else h[:0]


def rare_pairs(docs: DataFrame, size: int, prefix: _Prefix, parts: int) -> DataFrame:
    """(a, b, na, nb, common) digests and sizes of sets that share rare prefix tokens, if these can be enough.

    A pair's overlap is at most its common prefix tokens plus the longer of the
    two suffixes, which rejects most pairs that only share a passage. A set with
    frequent tokens in its base prefix (marked in the top bit of its size) is
    not counted that way.
    """
    percent, bits = prefix.percent, int(math.log2(parts))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
            sig = mix(np.concatenate([x[0] for x in held]) ^ _U(0x5851F42D4C957F2D))
            reps = [len(x[0]) for x in held]
            order = np.argsort(sig)
            sig = sig[order]
            fp = np.repeat(np.array([x[1] for x in held], np.int64), reps)[order]
            n = np.repeat(np.array([x[2] for x in held], np.uint32), reps)[order]
            low = ((sig >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.searchsorted(sig >> _U(64 - bits), np.arange(parts + 1, dtype=_U))
            at = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            cells = [
                pa.array([pack(np.diff(low[a:b], prepend=np.uint32(0))) for _, a, b in at], pa.binary()),
                pa.array([fp[a:b].tobytes() for _, a, b in at], pa.binary()),
                pa.array([pack(n[a:b]) for _, a, b in at], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in at], pa.int32()), *cells], ["part", "lows", "fps", "ns"])

        held, total = [], 0
        for fp, h in _distinct_sets(batches, size):
            rare, _, base = prefix.split(h)
            if len(rare):
                held.append((rare[:base], fp, len(h) | (len(rare) < base) << 31))
                total += min(base, len(rare))
                if total >= FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    def pair(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.cumsum(unpack(x, np.uint32), dtype=np.uint32) for x in table["lows"].to_pylist()])
        fp = np.concatenate([np.frombuffer(x, np.int64) for x in table["fps"].to_pylist()])
        n = np.concatenate([unpack(x, np.uint32) for x in table["ns"].to_pylist()]).astype(np.int64)
        order = np.lexsort((fp, low))
        low, fp, n = low[order], fp[order], n[order]
        new = np.r_[True, (low[1:] != low[:-1]) | (fp[1:] != fp[:-1])]
        low, fp, n = low[new], fp[new], n[new]
        found = []
        gap = 1
        while gap < len(low):
            i = np.flatnonzero(low[gap:] == low[:-gap])
            if not len(i):
                break
            x, y = n[i] & SIZE, n[i + gap] & SIZE
            i = i[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
            found.append(np.stack([fp[i], fp[i + gap], n[i], n[i + gap]], 1))
            gap += 1
        rows, common = np.unique(np.concatenate(found), axis=0, return_counts=True) if found else (np.zeros((0, 4), np.int64), np.zeros(0, np.int64))
        return pa.table({"a": rows[:, 0], "b": rows[:, 1], "na": rows[:, 2], "nb": rows[:, 3], "common": common.astype(np.int64)})

    posted = docs.select("text").mapInArrow(post, "part int, lows binary, fps binary, ns binary")
    return posted.groupBy("part").applyInArrow(pair, "a long, b long, na long, nb long, common long").groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common")).where(
        f"greatest(na, nb) > {SIZE} or {100 + percent} * (common + (greatest(na, nb) * {percent} + 99) div 100 - 1) >= {percent} * (na + nb)")


def combination_lists(docs: DataFrame, size: int, prefix: _Prefix) -> DataFrame:
    """(sig, fp, n, lead) per signature of two frequent tokens, and a row with the set's tokens (sig null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, h in _distinct_sets(batches, size):
            sig = np.unique(prefix.combinations(h)).view(np.int64)
            if len(sig):
                k = len(sig) + 1
                lead = np.zeros(k, bool)
                lead[np.argsort(sig.view(_U))[:PIVOTS]] = True
                none = np.r_[np.zeros(k - 1, bool), True]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[sig, 0], pa.int64(), mask=none), pa.array(np.full(k, fp)), pa.array(np.full(k, len(h), np.int64)), pa.array(lead),
                    pa.array([None] * (k - 1) + [h.tobytes()], pa.binary())], ["sig", "fp", "n", "lead", "tokens"])

    return docs.select("text").mapInArrow(run, "sig long, fp long, n long, lead boolean, tokens binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int(np.count_nonzero(y[at] == x))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _joining_links(roots: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of ``sets``, as places; where there are two blocks, only pairs across them are compared."""
    label = np.unique(roots, return_inverse=True)[1]
    if label.max() == 0:
        return []
    n = np.array([len(h) for h in sets])
    order = np.argsort(n, kind="stable")
    n, label, blocks, count = n[order], label[order], blocks[order], len(order)
    across = blocks.min() != blocks.max()
    width = 512
    while width < min(8 * int(np.median(n)), (8 << 20) // count):
        width *= 2
    signs = np.empty((count, width), np.float32)
    for row, i in enumerate(order):
        odd = np.bincount((mix(sets[i] ^ _U(0x9FB21C651E98DF25)) & _U(width - 1)).astype(np.int64), minlength=width) & 1
        signs[row] = 1 - 2 * odd
    out = []
    for a in range(0, count, ROWS):
        b = min(a + ROWS, count)
        end = int(np.searchsorted(n, 100 * n[b - 1] // percent, "right"))
        apart = (width - signs[a:b] @ signs[a:end].T) / 2
        # Jaccard >= t needs a symmetric difference of at most (1 - t) / (1 + t) of both sizes.
        near = (100 + percent) * apart <= (100 - percent) * (n[a:b, None] + n[None, a:end])
        near &= (label[a:b, None] != label[None, a:end]) & np.triu(np.ones((b - a, end - a), bool), 1)
        if across:
            near &= blocks[a:b, None] != blocks[None, a:end]
        x, y = np.nonzero(near)
        closest = np.argsort(apart[x, y], kind="stable")
        for i, j in zip((x[closest] + a).tolist(), (y[closest] + a).tolist(), strict=True):
            if label[i] != label[j] and _similar(sets[order[i]], sets[order[j]], percent):
                out.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return out


def joining_links(lists: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components of ``roots(node, root)`` whose sets share a list of ``lists(sig, fp)``; ``sets(fp, n, tokens)``.

    The links of a home join all of its sets that its pairs can join.
    """
    spark = lists.sparkSession
    rows = lists.select("sig", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("sig", "fp", F.coalesce("root", "fp").alias("root"))
    homes = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("fp").alias("home")).where("lo <> hi").select("sig", "home")
    guests = cut_lineage(rows.join(homes, "sig").select("home", "fp", "root").distinct(), "homes").join(sets, "fp")
    weight = F.col("n") * 8 + SET_BYTES
    sized = cut_lineage(guests.groupBy("home").agg(F.sum(weight).alias("w")), "sizes")
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sized.agg(F.sum("w")).first()[0] or 0) // HOME_BYTES)
    large = sized.where(F.col("w") > HOME_BYTES).select("home", F.ceil(F.col("w") * 2 / HOME_BYTES).cast("int").alias("blocks"))
    dealt = guests.join(large, "home", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("blocks")), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    dealt = dealt.select("home", "fp", "root", "tokens", "blocks", "block", other.alias("other"))
    tile = F.xxhash64("home", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(F.when(F.col("blocks").isNull(), F.pmod(tile, F.lit(units))).otherwise(tile).alias("unit"), tile.alias("tile"), "fp", "root", "block", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        tile, fp = table["tile"].to_numpy(), table["fp"].to_numpy()
        root, block, tokens = table["root"].to_numpy(), table["block"].to_numpy(), table["tokens"].combine_chunks()
        order = np.argsort(tile, kind="stable")
        found = []
        for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            held = [np.frombuffer(tokens[int(i)].as_buffer(), _U) for i in part]
            found += [(fp[part[i]], fp[part[j]]) for i, j in _joining_links(root[part], block[part], held, percent)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("unit").applyInArrow(compare, "a long, b long")


def _needed(docs: DataFrame, fps: DataFrame, reps: DataFrame) -> np.ndarray:
    """A bitmap of 2**BITS bits over hashed ids of the documents whose sets are needed."""
    pos = F.pmod(F.xxhash64("rep"), F.lit(1 << BITS))
    words = fps.join(reps, "fp").select(pos.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity.

    Pairs are gathered by the smallest neighbour of their first set, so that a
    group's sets travel together; a group of more than TILE_BYTES is dealt into
    tiles by two hashes, so that no task holds an unbounded group.
    """
    spark = docs.sparkSession
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    label = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("a"), F.least("x", "y").alias("key"))
    keyed = pairs.join(label, "a")
    large = keyed.groupBy("key").agg(F.ceil(F.sqrt(F.sum("w") * 8 / F.lit(TILE_BYTES))).cast("int").alias("blocks")).where("blocks > 1")
    total = pairs.agg(F.sum("w")).first()[0] or 0
    units = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, total * 8 // TILE_BYTES)
    blk = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.col("blocks"))
    unit = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("key"), F.lit(units))).otherwise(F.xxhash64("key", blk("a"), blk("b")))
    dealt = cut_lineage(keyed.join(large, "key", "left").select(unit.alias("unit"), "a", "b"), "tiles")
    ends = dealt.select("unit", F.col("a").alias("fp")).union(dealt.select("unit", "b")).distinct()
    bitmap = spark.sparkContext.broadcast(_needed(docs, ends.select("fp").distinct(), reps))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column("pos").to_numpy()
                keep = (words[p >> 6] >> (p & 63)) & 1
                if keep.any():
                    yield batch.filter(pa.array(keep.astype(bool)))

        for batch, row, h in _sets(wanted(), size):
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array([_digest(h)], pa.int64()), batch.column("doc_id").slice(row, 1), pa.array([h.tobytes()], pa.binary())], ["fp", "rep", "tokens"])

    pos = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS)).alias("pos")
    found = docs.select("doc_id", "text", pos).mapInArrow(scan, "fp long, rep long, tokens binary")
    sets = ends.join(reps, "fp").join(found.withColumnRenamed("rep", "doc_id").withColumnRenamed("fp", "fp2"), F.expr("fp = fp2 and rep <=> doc_id")).select(F.col("unit").alias("tile"), "fp", "tokens")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right["fp"].to_pylist(), (np.frombuffer(x, _U) for x in right["tokens"].to_pylist()), strict=True))
        keep = np.zeros(len(left), bool)
        for i, (a, b) in enumerate(zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True)):
            keep[i] = _similar(held[a], held[b], percent)
        return left.select(["a", "b"]).filter(pa.array(keep))

    return dealt.groupBy("unit").cogroup(sets.groupBy("tile")).applyInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, frequent: int = 24, max_frequent: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs(doc_id, text)``; sets of similarity percent/100 or more are linked."""
    return linked_rows(docs, size, percent, frequent, max_frequent).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, size: int = 5, percent: int = 75, frequent: int = 24, max_frequent: int = 1 << 20) -> DataFrame:
    """(doc_id, key, n_shingles, root, component_id) per row; root is the same for all rows of a component, also without ids, and null for an empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size_of = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(5, math.ceil(math.log2(max(1, size_of / 6 / (1 << 20)))))
    mem = cut_lineage(members(docs.withColumn("key", text_key(F.col("text"))), size), "members")
    reps = mem.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    prefix = _Prefix(percent, frequent_tokens(docs, size, frequent, max_frequent, parts), parts)
    combos = cut_lineage(combination_lists(docs, size, prefix), "combos")
    lists = cut_lineage(combos.where("sig is not null").select("sig", "fp", "n", "lead").distinct(), "lists")

    flip = F.lit(0x5DEECE66D1234567)
    pivots = lists.where("lead").groupBy("sig").agg(F.min("fp").alias("p0"), F.max("fp").alias("p1"), F.min(F.col("fp").bitwiseXOR(flip)).bitwiseXOR(flip).alias("p2"), F.max(F.col("fp").bitwiseXOR(flip)).bitwiseXOR(flip).alias("p3"))
    star = lists.where("lead").join(pivots.where("p0 <> p1"), "sig").select("fp", F.col("n") * 2, F.explode(F.array_distinct(F.array("p0", "p1", "p2", "p3"))).alias("p")).where("fp <> p")
    star = star.toDF("fp", "w", "p").select(F.least("fp", "p").alias("a"), F.greatest("fp", "p").alias("b"), "w")
    rare = rare_pairs(docs, size, prefix, parts).select("a", "b", F.expr(f"(na & {SIZE}) + (nb & {SIZE})").alias("w"))
    pairs = rare.union(star).groupBy("a", "b").agg(F.max("w").alias("w"))
    edges = cut_lineage(verify(cut_lineage(pairs, "pairs"), docs, reps, size, percent), "edges")
    roots = cut_lineage(components(edges), "roots")

    sets = combos.where("sig is null").select("fp", "n", "tokens").dropDuplicates(["fp"])
    more = cut_lineage(joining_links(lists, sets, roots, percent), "edges")
    if not more.isEmpty():
        roots = cut_lineage(components(edges.union(more)), "roots")

    named = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "root", "component_id")
    linked = mem.join(by_fp, "fp", "left")
    return linked.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).alias("root"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
