"""Language identification by prediction by partial matching (PPM).

Per language, a tree of byte contexts of up to ``order`` bytes holds symbol
counts. A symbol seen in the longest known context costs -log2 c / (n + d)
bits, where n counts the context's symbols and d its different ones; an unseen
one pays the escape -log2 d / (n + d) and is looked up in the context one byte
shorter, down to single bytes and a uniform byte (escape method C, without
exclusions). The statistics are frozen after training, so a text's code length
under each language is an exact sum over its bytes; the shortest code wins. The
score is the posterior of the winner under equal priors.

Training reads a bounded sample: the rows whose hashed id falls under a limit
that leaves about ``sample`` documents of each language. Every text is scored
whole; ASCII letters are lower-cased. Trees are flattened to tables of at most
``order + 1``-byte grams, so the broadcast is bounded by the sample.

Null text, and text without a letter, is ``und`` with score 0, as is any text
when no labelled row exists. Ties go to the first language by name. Rows may
repeat; rows without an id are never trained on and are not held out. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.bytegrams import BackoffTable, gram_counter, low, position_keys
from tidebook.llm.textbatch import chunks, lower_ascii

_U = np.uint64


def flatten(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> BackoffTable:
    """Code lengths of all grams that some language has seen, for every language."""
    langs = list(counts)

    def level(lang: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, n = counts[lang]
        short = low(keys, size)
        keys, inv = np.unique(short, return_inverse=True)
        c = np.bincount(inv, weights=n, minlength=len(keys))
        ctx, at, d = np.unique(keys >> _U(8), return_inverse=True, return_counts=True)
        total = np.bincount(at, weights=c, minlength=len(ctx))
        return keys, -np.log2(c / (total + d)[at]), ctx, -np.log2(d / (total + d)), at

    uni = np.zeros((256, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        keys, cost, _, escape, _ = level(lang, 1)
        uni[:, j] = escape[0] + 8
        uni[keys.astype(np.int64), j] = cost
    table = BackoffTable(uni)
    for size in range(2, order + 2):
        parts = [level(lang, size) for lang in langs]
        keys = np.unique(np.concatenate([p[0] for p in parts]))
        ctxs = np.unique(np.concatenate([p[2] for p in parts]))
        escapes = np.zeros((len(ctxs), len(langs)))
        values = table.values(keys, size - 1).astype(np.float64)
        for j, (k, cost, ctx, escape, _) in enumerate(parts):
            escapes[np.searchsorted(ctxs, ctx), j] = escape
            values[:, j] += escapes[np.searchsorted(ctxs, keys >> _U(8)), j]
            values[np.searchsorted(keys, k), j] = cost
        table.add(size, keys, values, ctxs, escapes)
    return table


def train(docs: DataFrame, order: int = 4, sample: int = 5000) -> tuple[list[str], BackoffTable] | None:
    """Languages and their tables from ``docs(doc_id, text, lang)``."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return None
    share = F.lit(1.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, sample / r["count"])).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))
    run, schema = gram_counter(order + 1, "lang", table=lower_ascii(np.arange(256, dtype=np.uint8)))
    rows = picked.select("lang", "text").mapInArrow(run, schema).groupBy("grp", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: (part["gram"].to_numpy().astype(_U), part["n"].to_numpy(np.float64)) for lang, part in rows.groupby("grp", sort=True)}
    return (list(counts), flatten(counts, order)) if counts else None


def identify(docs: DataFrame, model: tuple[list[str], BackoffTable] | None, order: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, lang_pred, score, bits_per_byte); repeated rows stay repeated."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].plain()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value[0], BackoffTable.restore(shared.value[1])
        names = np.array([*langs, "und"], object)
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(langs)))
            sizes = np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in chunks(batch.column("text")):
                sizes[lo:hi] = np.diff(offsets)
                full = np.flatnonzero(sizes[lo:hi])
                if len(full):
                    values = table.values(position_keys(lower_ascii(data), offsets, order + 1), order + 1)
                    for j in range(len(langs)):
                        bits[lo + full, j] = np.add.reduceat(values[:, j], offsets[full], dtype=np.float64)
            best = bits.argmin(1)
            odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(letters, best, len(langs))
            each = np.where(sizes > 0, bits[np.arange(len(best)), best] / np.maximum(sizes, 1), np.nan)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[pred], pa.string()), pa.array(np.where(letters, 1 / odds, 0.0)), pa.array(each, from_pandas=True)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    letters = F.coalesce(F.regexp_like("text", F.lit("\\p{L}")), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
