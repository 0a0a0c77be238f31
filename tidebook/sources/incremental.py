"""Incremental reads, gap plans, retention, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def watermarks(table: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.max(date).alias("watermark"))


def newer_than_watermark(incoming: DataFrame, loaded: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Incoming rows past each key's loaded maximum; unknown keys pass whole."""
    j = incoming.join(watermarks(loaded, keys, date), list(keys), "left")
    return j.where(F.col("watermark").isNull() | (F.col(date) > F.col("watermark"))).drop("watermark")


def gap_plan(lo: Column, hi: Column, loaded: DataFrame, staged: DataFrame, spark: SparkSession, date: str = "date") -> DataFrame:
    """Every weekday in [lo, hi] with what it still needs."""
    days = spark.range(1).select(F.explode(F.sequence(lo, hi)).alias(date)).where(F.weekday(date) < 5)
    a = loaded.select(date).distinct().withColumn("_l", F.lit(1))
    b = staged.select(date).distinct().withColumn("_s", F.lit(1))
    j = days.join(a, date, "left").join(b, date, "left")
    return j.select(date, F.when(F.col("_l") == 1, "loaded").when(F.col("_s") == 1, "staged").otherwise("fetch").alias("status"))


def retain(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col(ts) >= F.date_sub(as_of, days))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    """Parquet sink. Rows are clustered by partition value first, so a task
    writes few files; adaptive execution splits clusters that grow too large."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``."""
    df.hint("rebalance", *[F.col(c) for c in partition_by]).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Report export. Parallel part files; the caller bounds the report."""
    df.write.mode("overwrite").option("header", True).csv(path)
