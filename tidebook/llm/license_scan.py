"""Licence scans: canonical digests of entire texts, hash-joined to known licences.

Canonical form: lines with a copyright notice go, letters are lower-cased,
equivalent spellings are unified, and every run of other characters than
letters and digits becomes one space. The SHA-256 of this form is joined to the
digests of known texts. Three units are looked up: the document's entire text;
each of its lines that mentions a licence, as an entire text of its own
(notices such as "Released under the MIT License."); and blocks inside a longer
text, however its lines are wrapped: where the first ``HEAD`` words of a known
text occur, as many words as that text has, as an entire text of their own.

A line is a copyright notice if it begins with a copyright sign, or with the
word and no word from ``BODY`` after it, as body lines of licences have.

Null or blank text, and text of copyright lines only, has the digest of the
empty text and no licence. Rows may repeat or lack an id: lines are looked up
per id and text digest. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.keys import attach, text_key
from tidebook.llm.license_texts import KNOWN, SPELLINGS


HEAD = 6
#: Words after "copyright" that make a line part of a licence's body.
BODY = "notices? holders? owners? laws? licen[sc]es? statements? interests? protection and or in on to the is".split()
_NOTICE = "^\\W*(?:\\(c\\)|©|copyright\\b(?!\\W+(?:" + "|".join(BODY) + ")\\b))"


def canonical(text: Column) -> Column:
    marked = F.lower(text)
    notice = F.contains(marked, F.lit("copyright")) | F.contains(marked, F.lit("(c)")) | F.contains(marked, F.lit("©"))
    is_notice = lambda x: F.regexp_like(x, F.lit(_NOTICE))
    kept = F.when(notice, F.array_join(F.filter(F.split(marked, "\n"), lambda x: ~is_notice(x)), "\n")).otherwise(marked)
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    for ours, theirs in SPELLINGS:
        plain = F.replace(plain, F.lit(theirs), F.lit(ours))
    return F.trim(plain)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license, head, n_words) of the known texts, through the same canonical form."""
    rows = spark.createDataFrame(known, "license string, body string").select("license", canonical(F.col("body")).alias("c"))
    words = F.split("c", " ")
    return rows.select(F.sha2("c", 256).alias("digest"), "license", F.array_join(F.slice(words, 1, HEAD), " ").alias("head"), F.size(words).alias("n_words")).dropDuplicates(["digest"])


def blocks(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, key, license) of known texts of at least ``HEAD`` words anywhere in ``docs(doc_id, text, key)``."""
    known = known.where(F.col("n_words") >= HEAD).select("digest", "license", "head", "n_words")
    # The beginnings of the known texts, a fixed table, are literals: only places that match leave the row.
    heads = [r["head"] for r in known.select("head").distinct().collect()]
    words = docs.where(F.regexp_like("text", F.lit("(?i)licen[sc]e|permission|redistribut|warrant"))).select("doc_id", "key", F.split(canonical(F.col("text")), " ").alias("w"))
    places = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - HEAD)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i + 1, F.lit(HEAD)), " ").alias("head")))
    found = words.select("doc_id", "key", "w", F.explode(F.filter(places, lambda p: p["head"].isin(heads))).alias("p")).select("doc_id", "key", "w", "p.at", "p.head").join(known, "head")
    return found.where(F.sha2(F.array_join(F.slice("w", F.col("at") + 1, F.col("n_words")), " "), 256) == F.col("digest")).select("doc_id", "key", "license")


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notices) per row: the whole text's digest and licence, and the ids of licence lines and blocks, sorted and comma-joined."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))
    whole = docs.select("doc_id", "key", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit("(?i)licen[sc]e")))
    units = docs.where(F.regexp_like("text", F.lit("(?i)licen[sc]e"))).select("doc_id", "key", F.explode(F.array_distinct(lines)).alias("line"))
    hits = units.select("doc_id", "key", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(known.select("digest", "license"), "digest").select("doc_id", "key", "license")
    hits = hits.unionByName(blocks(docs, known))
    notices = hits.groupBy("doc_id", "key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    found = attach(whole.join(known.select("digest", "license"), "digest", "left"), notices)
    return found.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
