"""Trading calendar: a dense index over trading days turns date arithmetic
into equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar(bounds: DataFrame, holidays: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Every day in [lo, hi] with ``is_trading`` and the trading-day index.

    ``bounds`` is one row; the result is bounded by the number of days, which
    is why a single-partition window is acceptable here.
    """
    days = bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi))).alias("day"))
    h = holidays.select(F.col("holiday_date").alias("day")).distinct().withColumn("_h", F.lit(1))
    d = days.join(h, "day", "left")
    trading = (F.weekday("day") < 5) & F.col("_h").isNull()
    w = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("is_trading", F.when(trading, 1).otherwise(0))
    d = d.withColumn("trading_index", F.sum("is_trading").over(w))
    after = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(1, W.unboundedFollowing)
    before = W.partitionBy(F.lit(0)).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    tday = F.when(F.col("is_trading") == 1, F.col("day"))
    return d.select(
        "day", "is_trading", "trading_index",
        F.first(tday, ignorenulls=True).over(after).alias("next_trading"),
        F.last(tday, ignorenulls=True).over(before).alias("prev_trading"),
    )


def trading_days_between(df: DataFrame, cal: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Trading days in [start, end], both ends included."""
    a = cal.select(F.col("day").alias(start), (F.col("trading_index") - F.col("is_trading")).alias("_lo"))
    b = cal.select(F.col("day").alias(end), F.col("trading_index").alias("_hi"))
    j = df.join(a, start, "left").join(b, end, "left")
    return j.withColumn(out, F.col("_hi") - F.col("_lo")).drop("_lo", "_hi").select(*df.columns, out)


def week_of_month(d: str) -> Column:
    return (F.floor((F.dayofmonth(d) - 1) / 7) + 1).cast("int")


def weekend_triplets(trading_days: DataFrame, expiries: DataFrame, expiry: str = "expiry") -> DataFrame:
    """(Friday, Monday, expiry): Monday of the day before expiry's week, both
    days present in the calendar. One row per expiry, all equi joins."""
    monday = F.trunc(F.date_sub(F.col(expiry), 1), "week")
    t = expiries.select(expiry).distinct().withColumn("monday", monday).withColumn("friday", F.date_sub("monday", 3))
    days = trading_days.select(F.col("date").alias("_d")).distinct()
    t = t.join(days, F.col("friday") == F.col("_d"), "left_semi")
    return t.join(days, F.col("monday") == F.col("_d"), "left_semi").select("friday", "monday", expiry)
