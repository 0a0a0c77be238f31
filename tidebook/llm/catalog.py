"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import collocations, decontaminate, language_id, merkle_manifest, pii, sentencepieces, token_counts, toxicity, url_filter
from tidebook.llm.decontaminate import contamination
from tidebook.llm.jaccard_join import jaccard_components
from tidebook.llm.license_scan import known_digests, license_scan
from tidebook.llm.quality_lm import quality_scores
from tidebook.llm.quality_rules import quality_rules
from tidebook.llm.url_filter import rule_table, url_verdicts
from tidebook.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES["op8_jaccard_join"] = op8_jaccard_join


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("key")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), rule_table(spark))


QUERIES |= {"op6_decontamination": op6_decontamination, "op9_url_filter": op9_url_filter}
ORACLES |= {"op6_decontamination": decontaminate.ORACLE, "op9_url_filter": url_filter.ORACLE}


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), known_digests(spark))


QUERIES |= {"op3_quality_rules": op3_quality_rules, "op4_license_scan": op4_license_scan}


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(pii.candidates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "spans")
    spans = pii.all_spans(pii.fit(rows))
    counts = [_kind_count(k) for k in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("pii_base")), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def _kind_count(kind: str) -> Column:
    return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


QUERIES |= {"op5_pii": op5_pii}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang").where(language_id.remainder("doc_id", 4) != 2))
    rows = language_id.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(language_id.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


QUERIES |= {"op1_language_id": op1_language_id}


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("key")


QUERIES |= {"op2_quality_lm": op2_quality_lm}


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(language_id.remainder("doc_id", 5) == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    return toxicity.toxicity(docs, toxicity.train(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepieces.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "restored")


QUERIES |= {"op7_toxicity": op7_toxicity, "op10_sentencepiece": op10_sentencepiece}


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle_manifest.verified(merkle_manifest.manifest(docs, merkle_manifest.lowered_thirds()))


QUERIES |= {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES |= {"op11_merkle_manifest": merkle_manifest.ORACLE}


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES |= {"op12_token_counts": op12_token_counts, "op13_collocations": op13_collocations}
ORACLES |= {"op13_collocations": collocations.ORACLE}
