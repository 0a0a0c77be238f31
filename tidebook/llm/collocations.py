"""Phrases whose words occur together more often than apart, per language.

A-Z is lower-cased; texts are cut into pieces at ``. , ; : ! ?`` and line
ends, pieces into words at spaces and tabs. Everything is per lang (null:
``und``). With n word occurrences, a phrase of 2 to 5 words found a times (at
least ``min_count``) and a cut into a first part found l times and a rest found
r times, the cut scores floor(1000 * a * n / (l * r)); a phrase has the score
of its lowest cut. A phrase is dropped if a longer candidate holds it and is
found as often (in ``absorb`` per cent of its places).

Only the longest windows are counted: the word at each position and the lead
columns with the four after it, padded where the piece ends. ROLLUP over the
counted windows sums them by successively shorter prefixes, which are the
counts of all shorter phrases and, for the empty prefix, n; no shorter n-gram
is ever exploded.

Before that, windows are cut where their prefix is found less than
``min_count`` times: no candidate, nor a part of one, reaches further, so the
counts that matter stay exact. For this, windows are dealt to tasks by range
and sorted, so that equal prefixes are neighbours and a hot one spreads over
tasks; the sums are taken within an Arrow batch, and prefixes that reach its
first or last row are left alone, since more of them may lie outside.

In the sort, up to ``coded`` frequent words of at most ``CODED_BYTES`` bytes
are short codes and all others are spelled. Codes and range bounds come from a
sample of documents; they decide the size and the place of rows, not the
result. They are all that is broadcast, and have this bound whatever the
corpus. A piece longer than ``PART`` bytes takes memory in its task in
proportion.

Scores are integers; products are exact to 38 digits and overflow is an error.
The ranking keeps the best of each salted share before it ranks a language.

A null text has no words. Texts of separators only add nothing. Repeated rows
count as often as they occur. Rows without an id count too; ids are not read.
Ties in score end with the phrase in UTF-8 byte order. An empty table, or one
without a phrase found often enough, gives no rows. Columns other than lang and
text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.textbatch import chunks, lower_ascii
from tidebook.session import cut_lineage

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
LONGEST = 5
PART = 4 << 20
CODED = 1 << 17
CODED_BYTES = 256
HEAD = 32
SAMPLE = 4096
#: Languages up to which their totals are broadcast.
FEW = 4096

_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_ENDS, _GAPS = _flags(PIECE_ENDS), _flags(PIECE_ENDS + BLANKS)


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The chunk, or stretches of a single long row that end with a piece: (bytes, offsets)."""
    if len(offsets) > 2 or len(data) <= 2 * PART:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(at + PART, len(data))
        while end < len(data):
            stop = np.flatnonzero(_ENDS[data[end : end + PART]])
            if len(stop):
                end += int(stop[0]) + 1
                break
            end = min(end + PART, len(data))
        yield data[at:end], np.array([0, end - at])
        at = end


class Words:
    """The words of a stretch of texts: ``key`` numbers the distinct (lang, word) pairs at each word, ``unit`` its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: list[str]) -> None:
        data = lower_ascii(data)
        inside = ~_GAPS[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[starts] = inside[starts]
        at = np.flatnonzero(first)
        self.size = len(at)
        if not self.size:
            return
        row = np.searchsorted(offsets, at, "right") - 1
        self.unit = np.cumsum(_ENDS[data], dtype=np.int64)[at] + row
        letters = np.cumsum(inside, dtype=np.int64)
        bounds = np.append(letters[at] - 1, letters[-1])
        words = pa.LargeStringArray.from_buffers(self.size, pa.py_buffer(bounds), pa.py_buffer(data[inside])).dictionary_encode()
        vocabulary = words.dictionary
        lang = langs[row].astype(np.int64)
        keys, self.key = np.unique(lang * len(vocabulary) + words.indices.to_numpy(), return_inverse=True)
        lang, code = keys // len(vocabulary), keys % len(vocabulary)
        self.words = vocabulary.take(pa.array(code))
        self.lang = pa.array(names, pa.string()).take(pa.array(lang))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, numbers = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for row, end, data, offsets in chunks(batch.column(1), PART, 1 << 14):
            for part, bounds in _parts(data, offsets):
                words = Words(part, bounds, numbers[row:end], names)
                if words.size:
                    yield words


def code_of(rank: np.ndarray) -> list[str]:
    """Short words without a blank or ``=``: the rank in digits from the printable letters, the lowest first."""
    letters = [chr(c) for c in range(33, 127) if chr(c) != "="]
    out = []
    for r in rank.tolist():
        word = letters[r % len(letters)]
        while r := r // len(letters):
            word += letters[r % len(letters)]
        out.append(word)
    return out


def sampled(docs: DataFrame) -> DataFrame:
    """About ``SAMPLE`` documents at most, for codes and range bounds."""
    rows = docs.count()
    return docs if rows <= SAMPLE else docs.sample(SAMPLE / rows, seed=7)


def code_words(docs: DataFrame, coded: int) -> pa.Array:
    """The most frequent words of ``docs`` by distinct stretch of texts, at most ``coded`` of at most ``CODED_BYTES`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _stretches(batches):
            yield pa.RecordBatch.from_arrays([w.words.cast(pa.string()), pa.array(np.bincount(w.key, minlength=len(w.words)).astype(np.int64))], ["word", "n"])

    words = docs.mapInArrow(count, "word string, n bigint").where(F.octet_length("word") <= CODED_BYTES)
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(coded).select("word").toArrow()
    return top.column("word").combine_chunks().cast(pa.string())


def _heads(texts: pa.Array) -> np.ndarray:
    """The first ``HEAD`` bytes of each string, for comparison with the bounds."""
    _, offs, data = texts.cast(pa.large_string()).buffers()
    starts = np.frombuffer(offs, np.int64, len(texts) + 1, 0)
    raw = np.append(np.frombuffer(data, np.uint8, starts[-1]) if starts[-1] else np.zeros(0, np.uint8), np.zeros(HEAD, np.uint8))
    cells = raw[starts[:-1, None] + np.arange(HEAD)]
    cells[np.arange(HEAD) >= np.diff(starts)[:, None]] = 0
    return np.ascontiguousarray(cells).view(f"S{HEAD}").ravel()


def range_bounds(sample: DataFrame, parts: int) -> np.ndarray:
    """Heads that cut the windows of ``sample(win)`` into ``parts`` shares; at most 64 a share reach the driver."""
    got = sample.select("win").orderBy(F.rand(7)).limit(64 * parts).toArrow().column("win").combine_chunks()
    heads = np.sort(_heads(got))
    return np.unique(heads[np.arange(1, parts) * len(heads) // parts]) if len(heads) else heads


def _lang_tag(lang: str) -> str:
    return "=" + lang.replace("%", "%25").replace(" ", "%20")


def _lang_of(tag: str) -> str:
    return tag[1:].replace("%20", " ").replace("%25", "%")


def windows(docs: DataFrame, known: Broadcast, bounds: Broadcast | None = None) -> DataFrame:
    """(win, n, part): the longest windows of each stretch of texts with their counts.

    ``win`` holds a tag of the lang and up to five words, each followed by a
    blank. ``part`` is the share of ``bounds`` it falls in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = pa.array(code_of(np.arange(len(known.value))), pa.string())
        for w in _stretches(batches):
            words = w.words.cast(pa.string())
            spelled = pc.binary_join_element_wise("=", words, "")
            words = pc.coalesce(codes.take(pc.index_in(words, known.value)), spelled)
            # lead columns: the word i places on, null as padding where the piece ends
            leads = [words.take(pa.array(w.key))]
            for i in range(1, min(LONGEST, w.size)):
                leads.append(pa.concat_arrays([words.take(pa.array(w.key[i:], mask=w.unit[i:] != w.unit[:-i])), pa.nulls(i, pa.string())]))
            tags = pc.dictionary_encode(w.lang)
            tags = pa.array([_lang_tag(x) for x in tags.dictionary.to_pylist()]).take(tags.indices).take(pa.array(w.key))
            found = pc.value_counts(pc.binary_join_element_wise(tags, *leads, "", " ", null_handling="skip"))
            texts = found.field("values")
            part = np.searchsorted(bounds.value, _heads(texts), "right") if bounds else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([texts, found.field("counts"), pa.array(part.astype(np.int32))], ["win", "n", "part"])

    return docs.mapInArrow(cut, "win string, n bigint, part int")


def cut_windows(in_order: DataFrame, min_count: int, known: Broadcast) -> DataFrame:
    """(lang, w1..w5, n) from ``windows`` in order: each cut to the longest prefix that may be frequent."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = dict(zip(code_of(np.arange(len(known.value))), known.value.to_pylist(), strict=True))
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            cells = pc.split_pattern(pc.utf8_rtrim(batch.column(0), " "), " ")
            sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False)
            flat = cells.flatten().dictionary_encode()
            table = np.full((len(n), LONGEST + 1), -1, np.int64)
            table[np.arange(LONGEST + 1) < sizes[:, None]] = flat.indices.to_numpy()
            changed = np.ones((len(n), LONGEST + 1), bool)
            changed[1:] = np.logical_or.accumulate(table[1:] != table[:-1], axis=1)
            depth, group = np.zeros(len(n), np.int64), np.cumsum(changed[:, 0]) - 1
            for k in range(1, LONGEST + 1):
                run = np.cumsum(changed[:, k]) - 1
                total = np.add.reduceat(n, np.flatnonzero(changed[:, k]))
                total[[0, -1]] = min_count  # may go on in the next batch or task
                deeper = (total[run] >= min_count) & (sizes > k) & (depth == k - 1)
                depth[deeper], group[deeper] = k, run[deeper]
            # Rows cut to the same prefix become one.
            _, first, row = np.unique(depth * len(n) + group, return_index=True, return_inverse=True)
            count = np.zeros(len(first), np.int64)
            np.add.at(count, row, n)
            depth, kept = depth[first], table[first]
            kept[np.arange(LONGEST + 1) > depth[:, None]] = -1
            used, place = np.unique(kept, return_inverse=True)
            place = place.reshape(kept.shape)
            texts = flat.dictionary.take(pa.array(used, mask=used < 0)).to_pylist()
            words = pa.array([None if t is None else decoded.get(t, t[1:]) for t in texts], pa.string())
            langs = pa.array([_lang_of(t) if t and t.startswith("=") else None for t in texts], pa.string())
            columns = [words.take(pa.array(place[:, k])) for k in range(1, LONGEST + 1)]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(place[:, 0])), *columns, pa.array(count)], ["lang", *_WORDS, "n"])

    schema = "lang string, " + ", ".join(f"{c} string" for c in _WORDS) + ", n bigint"
    return in_order.mapInArrow(cut, schema).groupBy("lang", *_WORDS).agg(F.sum("n").alias("n"))


def phrase_counts(counted: DataFrame, min_count: int) -> DataFrame:
    """(lang, k, words, phrase, f): phrases of 1 to 5 words found often enough, and the words of the lang as k = 0."""
    rolled = counted.rollup("lang", *_WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # g has a one for every column summed over, the last column lowest.
    k = F.lit(LONGEST) - F.log2(F.col("g") + 1).cast("int")
    words = F.filter(F.array(*_WORDS), lambda w: w.isNotNull())
    rows = rolled.where(F.col("g") < 2 ** (LONGEST + 1) - 1).select("lang", k.alias("k"), words.alias("words"), "f")
    rows = rows.where((F.size("words") == F.col("k")) & ((F.col("k") == 0) | (F.col("f") >= min_count)))
    return rows.select("lang", "k", "words", F.array_join("words", " ").alias("phrase"), "f")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, min_count: int = 100, top: int | None = 2000, absorb: int = 100, coded: int = CODED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best ``top`` phrases of each lang of ``docs(lang, text)`` (all with None)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = sampled(docs)
    known = spark.sparkContext.broadcast(code_words(few, coded))
    bounds = spark.sparkContext.broadcast(range_bounds(windows(few, known), parts))
    in_order = windows(docs, known, bounds).repartitionById(parts, "part").sortWithinPartitions("win").select("win", "n")
    counted = cut_lineage(cut_windows(in_order, min_count, known), "windows")
    counts = cut_lineage(phrase_counts(counted, min_count), "phrases")

    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    if totals.count() <= FEW:
        totals = F.broadcast(totals)
    known_parts = counts.where("k > 0").select("lang", F.col("phrase").alias("part"), "f")
    phrases = counts.where("k > 1").withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "phrase", "words", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    cuts = cuts.join(known_parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known_parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    cuts = cuts.withColumn("over", (_wide("a") * _wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", _wide("l") * _wide("r"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("best"))

    # A candidate holds a phrase and is found as often only if one that is longer by one word does.
    longer = phrases.where("k > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(F.slice("words", F.lit(1), F.col("k") - 1), F.slice("words", F.lit(2), F.col("k") - 1))).alias("held"))
    longer = longer.groupBy("lang", F.array_join("held", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    rows = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    rows = rows.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        rows = rows.withColumn("_salt", salt).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
        rows = rows.where(F.col("_place") <= top).drop("_salt", "_place")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return rows.select("lang", F.lit(None).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
with pieces as (select coalesce(lang, 'und') as lang, row_number() over () as id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as s from documents),
w as (select lang, regexp_extract_all(s, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::hugeint as n from w group by 1),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*)::hugeint as f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k) group by all),
candidates as (select lang, k, phrase, string_split(phrase, ' ') as p, f as a from grams where k > 1 and f >= 100),
cuts as (select lang, phrase, k, a, j, array_to_string(p[1 : j], ' ') as first, array_to_string(p[j + 1 : k], ' ') as rest from (select *, unnest(range(1, k)) as j from candidates)),
scores as (select c.lang, c.phrase, c.a, x.f as l, y.f as r, n, (1000 * c.a * n) // (x.f * y.f) as score, row_number() over (partition by c.lang, c.phrase order by (1000 * c.a * n) // (x.f * y.f), j) as place
  from cuts c join grams x on x.lang = c.lang and x.phrase = first join grams y on y.lang = c.lang and y.phrase = rest join totals t on t.lang = c.lang),
inner_ as (select lang, array_to_string(p[i : i + m - 1], ' ') as phrase, max(a) as longer from (select lang, p, a, m, unnest(range(1, k - m + 2)) as i from candidates, (select unnest([2, 3, 4]) as m) where m < k) group by all),
kept as (select s.* from scores s left join inner_ using (lang, phrase) where place = 1 and (longer is null or 100 * longer < 100 * s.a)),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from placed where rank <= 2000
"""
