"""Freshness, staleness, run status and readiness checks. ``as_of`` is always
a parameter, never the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.exprs import flag


def freshness(df: DataFrame, group: str, date: str, as_of: Column, max_age: int) -> DataFrame:
    """Latest date per group and whether it is within ``max_age`` days."""
    g = df.groupBy(F.col(group).cast("string").alias("label")).agg(F.max(date).cast("date").alias("last_date"))
    age = F.datediff(as_of, "last_date")
    return g.select("label", "last_date", age.alias("days_stale"), flag(age > max_age).alias("stale"))


def traffic_light(age: Column, ok_days: int = 1, warn_days: int = 4) -> Column:
    return F.when(age.isNull(), "no data").when(age <= ok_days, "green").when(age <= warn_days, "yellow").otherwise("red")


def lag_behind_market(df: DataFrame, threshold: int, date: str = "date", inclusive: bool = False) -> DataFrame:
    """Symbols whose last date trails their market's last date. The market
    maximum comes from the per-symbol aggregate, so the big table is read once."""
    s = df.groupBy("market", "symbol").agg(F.max(date).alias("last_date"))
    m = s.groupBy("market").agg(F.max("last_date").alias("market_max"))
    j = s.join(m, "market").withColumn("days_behind", F.datediff("market_max", "last_date"))
    return j.where(F.col("days_behind") >= threshold if inclusive else F.col("days_behind") > threshold)


def latest_status(runs: DataFrame, run_date: Column) -> DataFrame:
    day = runs.where(F.col("run_date") == run_date)
    return day.groupBy("service").agg(F.max_by("status", "version").alias("status"), F.max("started_at").alias("started_at"))


def run_issues(runs: DataFrame, expected: DataFrame, now: Column, grace_minutes: int = 30) -> DataFrame:
    """Failed runs, and services past their deadline without a run today.
    ``expected`` lists (service, hhmm)."""
    st = latest_status(runs, F.to_date(now))
    j = expected.join(st, "service", "left")
    minutes = F.substring("hhmm", 1, 2).cast("int") * 60 + F.substring("hhmm", 4, 2).cast("int") + grace_minutes
    late = F.hour(now) * 60 + F.minute(now) >= minutes
    issue = F.when(F.col("status") == "failed", "failed").when(F.col("status").isNull() & late, "missing")
    return j.select("service", issue.alias("issue")).where("issue is not null")


def recurring_failures(runs: DataFrame, as_of: Column, window_days: int, minimum: int) -> DataFrame:
    d = runs.where((F.col("status") == "failed") & F.col("run_date").between(F.date_sub(as_of, window_days), as_of))
    return d.groupBy("service").agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= minimum)


def readiness(checks: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """One row per check: name, ok flag, detail. Each check is a frame with an
    aggregate ok expression and an aggregate detail expression."""
    rows = [df.agg(ok.alias("ok"), detail.cast("string").alias("detail")).select(F.lit(n).alias("check_name"), flag(F.col("ok")).alias("ok"), "detail")
            for n, (df, ok, detail) in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def upstream_ready(runs: DataFrame, services: list[str], as_of: Column, days: int = 3) -> DataFrame:
    """Per service: the latest run in the window succeeded and wrote rows."""
    d = runs.where(F.col("run_date").between(F.date_sub(as_of, days), as_of) & F.col("service").isin(services))
    last = d.groupBy("service").agg(F.max_by(F.struct("status", "rows_written"), F.struct("started_at", "version")).alias("_l"))
    want = runs.sparkSession.createDataFrame([(s,) for s in services], "service string")
    j = want.join(last, "service", "left")
    return j.select("service", F.col("_l.status").alias("status"), flag((F.col("_l.status") == "success") & (F.col("_l.rows_written") > 0)).alias("ready"))


def with_duration(runs: DataFrame) -> DataFrame:
    return runs.withColumn("duration_s", F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))
