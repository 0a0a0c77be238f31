"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
characters. A window is ``width`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window.

1. The benchmark's terms are counted over all documents (map-side combined).
2. Each window picks its rarest terms as anchors (two where it can), each with
   its offset in the window.
3. The index stores the positions of anchor terms, one posting list per term
   and document, as a table in the shared folder. Frequent words are in it only
   if some window has nothing rarer.
4. A posting moved back by its anchor's offset proposes a window start; a start
   that all anchors of the window propose is a candidate.
5. Candidates are compared word by word with the document, which gives exact
   phrases; what is hit is the union of their spans.

Terms and windows are broadcast only while the benchmark has at most
``max_broadcast`` words; beyond that, the same joins shuffle.

Null texts have no words. Rows may repeat or lack an id: rows are keyed by id
and text digest, and a repeated row gets the same result. An empty benchmark
hits nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.keys import ascii_lower, attach, text_key
from tidebook.session import cut_lineage

_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ANCHORS = 2


def words_of(text: Column) -> Column:
    """Array of words; at most the first and last cells of a split are empty, and these go."""
    cells = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS)
    return F.filter(cells, lambda w: w != "")


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, item_id, words): every window of every item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    cut = items.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("words"))
    cut = cut.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return cut.select(F.xxhash64(F.array_join("words", " ")).alias("window"), "words", "items")


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_broadcast: int = 1 << 20) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    windows = cut_lineage(windows_of(benchmark.select("item_id", "text"), width), "windows")
    small = (windows.agg(F.sum(F.size("words"))).first()[0] or 0) <= max_broadcast
    terms = windows.select(F.explode("words").alias("term")).distinct()

    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    counts = tokens.join(_small(terms, small), "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts, "terms")
    # Anchors: the rarest terms of a window, each at its first place there.
    ranked = windows.select("window", F.posexplode("words").alias("offset", "term")).groupBy("window", "term").agg(F.min("offset").alias("offset"))
    ranked = ranked.join(_small(counts, small), "term", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("terms"))
    ranked = ranked.where(F.col("terms")[0]["n"] > 0).select("window", F.slice("terms", 1, ANCHORS).alias("terms"))
    anchors = cut_lineage(ranked.select("window", F.size("terms").alias("needed"), F.explode("terms").alias("t")).select("window", "needed", "t.term", "t.offset"), "anchors")

    wanted = anchors.select("term").distinct()
    placed = docs.select("doc_id", "key", F.posexplode(words_of(F.col("text"))).alias("pos", "term")).join(_small(wanted, small), "term")
    index = cut_lineage(placed.groupBy("term", "doc_id", "key").agg(F.collect_set("pos").alias("positions")), "postings")
    proposed = index.join(_small(anchors, small), "term").select("doc_id", "key", "window", "needed", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start")).where("start >= 0")
    agreed = proposed.groupBy("doc_id", "key", "window", "start").agg(F.count("*").alias("n"), F.max("needed").alias("needed")).where("n = needed")
    agreed = agreed.join(_small(windows, small), "window")
    found = cut_lineage(agreed.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "words", "items")).alias("places")), "candidates")

    sized = docs.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    checked = docs.join(found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "places"), F.expr("doc_id <=> _id and key = _key"))
    checked = checked.dropDuplicates(["doc_id", "key"]).select("doc_id", "key", words_of(F.col("text")).alias("w"), "places")
    checked = checked.select("doc_id", "key", F.filter("places", lambda p: F.slice(F.col("w"), p["start"] + 1, F.size(p["words"])) == p["words"]).alias("places"))
    spans = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + F.size(p["words"]) - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: p["items"]))))
    hits = checked.where(F.size("places") > 0).select("doc_id", "key", F.size(spans).cast("long").alias("n_hit"), items.alias("items"))
    return attach(sized, hits).select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


ORACLE = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[s : s + 9], ' ') as phrase from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n)),
hit as (select doc_id, s, dw.n, item_id from dw join bw on dw.n = bw.n and dw.phrase = bw.phrase),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""
