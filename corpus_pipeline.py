"""Training-corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and judges all rows that its predecessor
kept. Rows may repeat or lack a doc_id. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import pii, sentencepieces
from tidebook.llm.decontaminate import contamination
from tidebook.llm.jaccard_join import linked_rows
from tidebook.llm.keys import text_key
from tidebook.llm.quality_lm import quality_scores
from tidebook.session import cut_lineage


def _keep(docs: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (semi) or without (anti) a row in ``verdicts(doc_id, key)``."""
    other = verdicts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    return docs.join(other, docs.doc_id.eqNullSafe(F.col("_id")) & (text_key(docs.text) == F.col("_key")), f"left_{how}")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text stays below their language's threshold."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(docs, scores.where("not kept"), "anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id.

    Rows are told apart by id and text, so an id may stand for several
    documents. Of rows with that id the smallest text stays; rows without an id
    come after all others. A text without shingles stays once per id.
    """
    rows = cut_lineage(linked_rows(docs), "linked")
    linked = rows.where("root is not null")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    least = linked.groupBy("root").agg(F.min(order).alias("least")).select(F.col("root").alias("_root"), F.col("least.doc_id").alias("_id"))
    best = linked.join(least, F.expr("root = _root and doc_id <=> _id")).select("root", "doc_id", "key").distinct()
    best = cut_lineage(best, "best")
    # Texts are compared only where several rows of the least id are left.
    ties = best.join(best.groupBy("root").count().where("count > 1").select("root"), "root", "left_semi")
    texts = ties.join(docs.select(F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"), "text"), F.expr("doc_id <=> _id and key = _key"))
    first = texts.groupBy("root").agg(F.min(F.struct("text", "doc_id", "key")).alias("r")).select("root", "r.doc_id", "r.key")
    kept = best.join(ties.select("root").distinct(), "root", "left_anti").unionByName(first).select("doc_id", "key")
    kept = cut_lineage(kept.unionByName(rows.where("root is null").select("doc_id", "key").distinct()), "kept")
    repeated = rows.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    named = _keep(docs, kept, "semi")
    once = _keep(named, repeated, "anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = _keep(named, repeated, "semi").groupBy("doc_id", text_key(F.col("text"))).agg(F.min(F.struct("text", *others)).alias("r"))
    return once.unionByName(again.select("doc_id", "r.*").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep(docs, found.where("contaminated"), "anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; n_chars follows."""
    rows = pii.candidates(docs)
    spans = pii.all_spans(pii.fit(pii.candidates(docs.select("doc_id", "text"))))
    rows = rows.withColumn("text", pii.masked(F.col("text"), spans))
    return rows.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, and whether these decode to the text."""
    rows = sentencepieces.round_trip(docs)
    return rows.withColumn("n_pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece", pieces),
]

#: The quality model and the piece search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
