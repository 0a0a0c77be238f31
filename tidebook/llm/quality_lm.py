"""Quality classifier: interpolated modified Kneser-Ney over bytes.

Trusted text (documents labelled of good quality) trains an n-gram model of
``order`` bytes. All its counts come from Spark aggregations over all trusted
documents but a held-out quarter: tasks combine their n-grams first, then one
group-by sums them. Continuation counts of each shorter order are a group-by of
the next longer one; discounts D1, D2, D3+ follow from the counts of counts of
each order; joins on the context and on the shorter n-gram give every n-gram's
interpolated probability and every context's back-off weight.

The tables are split into shards by the two bytes before the scored one, so
that a position finds all its n-grams and contexts in one shard. A shard has at
most ``shard_rows`` rows (one byte pair's rows are never split), is broadcast,
and adds its positions' code lengths to the documents' sums. The number of
passes is the model's size over ``shard_rows``; byte n-grams saturate, so it
stays small.

Perplexity per byte is pulled towards the language's median as if
``prior_bytes`` more bytes of that code length had been read, since a few words
say little. The threshold of a language is the median log perplexity of its
held-out trusted documents plus ``deviations`` robust deviations (scaled median
absolute ones), so single odd documents do not move it. Its deviation is
averaged with that over all languages as if ``prior_docs`` more documents had
shown the latter; a language without held-out documents uses all of them.

Repeated words are easy to predict once, so a second measure finds them: the
effective number of a text's n-grams, n^2 over the sum of their squared counts.
It does not fall with length. A text is rejected if it is below ``spread`` times
the least of its length, ``spread_bytes`` and the median of held-out trusted
documents, so that text as uniform as the trusted one stays.

Null and empty texts have no perplexity and are rejected. Rows may repeat or
lack an id (such rows are never trusted). Without trusted text nothing but
empty text is rejected. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.bytegrams import BackoffTable, gram_counter, position_keys
from tidebook.llm.keys import attach, text_key
from tidebook.llm.textbatch import chunks
from tidebook.session import cut_lineage

_U = np.uint64
#: Fixed value: standard deviations per median absolute deviation of a normal law.
MAD = 1.4826


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, held): ids labelled good, and whether they are held out for thresholds."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("held")).distinct()


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(size, gram, value, context, weight): log2 probability of every n-gram of 1 to ``order`` bytes with
    its context's log2 back-off weight, from ``counts(gram, n)`` of the longest ones."""
    levels = {order: counts.select("gram", F.col("n").alias("c"))}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")).agg(F.count("*").alias("c"))
    spectrum = None
    for k, level in levels.items():
        part = level.where("c <= 4").groupBy("c").count().select(F.lit(k).alias("size"), "c", "count")
        spectrum = part if spectrum is None else spectrum.union(part)
    seen = {(r["size"], r["c"]): r["count"] for r in spectrum.collect()}
    shorter = None
    out = None
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (seen.get((k, c), 0) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d1, d2, d3 = (min(c - 0.05, max(0.05, c - (c + 1) * y * b / a)) if a else c / 2 for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = levels[k].select("gram", "c", F.shiftright("gram", 8).alias("context"), discount.alias("d"))
        context = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("given"))
        rows = rows.join(context, "context").select("gram", "context", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), (F.col("given") / F.col("total")).alias("gamma"))
        if k == 1:
            rows = rows.withColumn("p", F.col("own") + F.col("gamma") / 256)
        else:
            rows = rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(shorter, "tail").withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        rows = cut_lineage(rows.select("gram", "context", "gamma", "p"), f"kn{k}")
        shorter = rows.select(F.col("gram").alias("tail"), F.col("p").alias("q"))
        part = rows.select(F.lit(k).alias("size"), "gram", F.log2("p").alias("value"), "context", F.log2("gamma").alias("weight"))
        out = part if out is None else out.union(part)
    return out


def shards(model: DataFrame, order: int, shard_rows: int) -> tuple[np.ndarray, int]:
    """The shard of each pair of bytes before the scored one, and the number of shards."""
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    sizes = model.where("size > 2").groupBy(pair.cast("int").alias("pair")).count().toArrow()
    rows = np.zeros(1 << 16, np.int64)
    rows[sizes.column(0).to_numpy()] = sizes.column(1).to_numpy()
    shard = np.zeros(1 << 16, np.int16)
    at = held = 0
    for pair_ in np.flatnonzero(rows):
        if held and held + rows[pair_] > shard_rows:
            at, held = at + 1, 0
        held += rows[pair_]
        shard[pair_] = at
    return shard, at + 1


def _table(model: DataFrame, order: int) -> BackoffTable:
    """Back-off table of one shard's rows; only keys and 32-bit values come to the driver, one level at a time."""

    def arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = rows.toArrow()
        return got.column(0).to_numpy().astype(_U), got.column(1).to_numpy()

    uni = np.full((256, 1), -8.0, np.float32)
    keys, values = arrays(model.where("size = 1").select("gram", F.col("value").cast("float")))
    # A byte that trusted text never has gets the share that is left for unseen ones.
    uni[:] = (model.where("size = 1").agg(F.max("weight")).first()[0] or 0.0) - 8
    uni[keys.astype(np.int64), 0] = values
    table = BackoffTable(uni)
    for k in range(2, order + 1):
        level = model.where(F.col("size") == k)
        keys, values = arrays(level.select("gram", F.col("value").cast("float")))
        contexts, weights = arrays(level.groupBy("context").agg(F.max("weight").cast("float")))
        table.add(k, keys, values[:, None], contexts, weights[:, None])
    return table


def squared_counts(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the squared counts of each row's keys, of which those of a row stand together."""
    out = np.zeros(rows)
    for r, part in zip(row[np.flatnonzero(np.diff(row, prepend=-1))], np.split(keys, np.flatnonzero(np.diff(row)) + 1), strict=True) if len(keys) else ():
        part = np.sort(part)
        runs = np.diff(np.flatnonzero(np.append(True, part[1:] != part[:-1])), append=len(part)).astype(float)
        out[r] = runs @ runs
    return out


def code_lengths(docs: DataFrame, model: DataFrame, order: int, shard_rows: int) -> DataFrame:
    """(doc_id, key, bits, n, squares) of ``docs(doc_id, key, text)``, one row per key; squares sums the squared counts of its n-grams."""
    shard, count = shards(model, order, shard_rows)
    spark = docs.sparkSession
    of_pair = spark.sparkContext.broadcast(shard)
    out, tables = None, []
    for s in range(count):
        pairs = spark.createDataFrame([(int(p),) for p in np.flatnonzero(shard == s)], "pair int") if count > 1 else None
        part = model.withColumn("pair", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).cast("int"))
        part = part if pairs is None else part.where("size <= 2").unionByName(part.where("size > 2").join(pairs, "pair", "left_semi"))
        shared = spark.sparkContext.broadcast(_table(part, order).plain())
        tables.append(shared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, s=s) -> Iterator[pa.RecordBatch]:
            table, where = BackoffTable.restore(shared.value), of_pair.value
            for batch in batches:
                bits, sizes, squares = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for lo, hi, data, offsets in chunks(batch.column("text")):
                    keys = position_keys(data, offsets, order)
                    row = np.repeat(np.arange(hi - lo), np.diff(offsets))
                    if count > 1:
                        mine = where[((keys >> _U(8)) & _U(0xFFFF)).astype(np.int64)] == s
                        keys, row = keys[mine], row[mine]
                    bits[lo:hi] = np.bincount(row, weights=-table.values(keys, order)[:, 0], minlength=hi - lo)
                    sizes[lo:hi] = np.bincount(row, minlength=hi - lo)
                    squares[lo:hi] = squared_counts(keys, row, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(bits), pa.array(sizes), pa.array(squares)], ["doc_id", "key", "bits", "n", "squares"])

        scored = docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, bits double, n long, squares double")
        out = scored if out is None else out.union(scored)
    out = cut_lineage(out.groupBy("doc_id", "key").agg(F.sum("bits").alias("bits"), F.sum("n").alias("n"), F.sum("squares").alias("squares")), "lengths")
    for shared in tables:  # workers let go of tables that are no longer read
        shared.unpersist()
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, order: int = 5, deviations: float = 4.0, prior_docs: int = 100, prior_bytes: int = 128, spread: float = 1 / 3, spread_bytes: int = 256, shard_rows: int = 1 << 21) -> DataFrame:
    """(doc_id, key, lang, n_bytes, perplexity, threshold, kept) per row of ``docs(doc_id, text, lang)``."""
    docs = docs.select("doc_id", "text", "lang", text_key(F.col("text")).alias("key"))
    ids = trusted_ids(labels)
    run, schema = gram_counter(order)
    # Labels grow with the documents, so the join shuffles by id at every size instead of turning from a broadcast to a shuffle as they grow.
    text = docs.select("doc_id", "text").join(ids.where("not held").select("doc_id").hint("merge"), "doc_id", "left_semi").select("text")
    counts = cut_lineage(text.mapInArrow(run, schema).groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    if counts.isEmpty():
        rows = docs.select("doc_id", "key", "lang", F.octet_length("text").cast("long").alias("n_bytes"))
        return rows.select("*", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (F.coalesce("n_bytes", F.lit(0)) > 0).alias("kept"))
    model = cut_lineage(kneser_ney(counts, order), "model")
    lengths = code_lengths(docs, model, order, shard_rows)
    rows = attach(docs.select("doc_id", "key", "lang"), lengths)
    rows = cut_lineage(rows.select("doc_id", "key", F.coalesce("lang", F.lit("")).alias("lang_"), "lang", "bits", F.coalesce("n", F.lit(0)).alias("n"), "squares"), "scored")
    full = rows.where("n > 0")
    middle = full.groupBy("lang_").agg(F.percentile_approx(F.col("bits") / F.col("n"), 0.5, 1000).alias("middle"))
    rows = attach(rows, middle, ("lang_",))
    rows = rows.withColumn("perplexity", F.when(F.col("n") > 0, F.pow(F.lit(2.0), (F.col("bits") + prior_bytes * F.col("middle")) / (F.col("n") + prior_bytes))))
    held = rows.where("n > 0").join(ids.where("held").select("doc_id"), "doc_id", "left_semi")
    held = held.select("lang_", F.log2("perplexity").alias("x"), (F.col("n") * F.col("n") / F.col("squares")).alias("grams"))
    by_lang = held.groupBy("lang_").agg(F.percentile_approx("x", 0.5, 10000).alias("own"), F.count("*").alias("docs"))
    away = attach(held, by_lang, ("lang_",)).select("lang_", "x", F.abs(F.col("x") - F.col("own")).alias("away"))
    by_lang = attach(by_lang, away.groupBy("lang_").agg(F.percentile_approx("away", 0.5, 10000).alias("away")), ("lang_",))
    middle_x, middle_away = away.agg(F.percentile_approx("x", 0.5, 10000), F.percentile_approx("away", 0.5, 10000)).first()
    middle_grams = held.agg(F.percentile_approx("grams", 0.5, 10000)).first()[0]
    overall = lambda v: F.lit(v).cast("double")
    seen = F.coalesce("docs", F.lit(0))
    deviation = (seen * F.coalesce("away", F.lit(0.0)) + prior_docs * overall(middle_away)) / (seen + prior_docs)
    rows = attach(rows, by_lang, ("lang_",)).withColumn("threshold", F.pow(F.lit(2.0), F.coalesce("own", overall(middle_x)) + deviations * MAD * deviation))
    spread_out = F.col("n") * F.col("n") >= spread * F.least("n", F.lit(spread_bytes), overall(middle_grams)) * F.col("squares")
    kept = (F.col("n") > 0) & spread_out & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return rows.select("doc_id", "key", "lang", F.col("n").alias("n_bytes"), "perplexity", "threshold", kept.alias("kept"))
