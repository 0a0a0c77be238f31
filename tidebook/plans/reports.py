"""Report queries over closed trades and daily tables. Daily aggregates come
first, so later windows run over days, not trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.exprs import flag
from tidebook.functions.market import itemised_cost
from tidebook.operators.stats import top_n


def daily_pnl(trades: DataFrame) -> DataFrame:
    """P&L per day and symbol with the cumulative curve per symbol."""
    d = trades.groupBy("symbol", "exit_date").agg(F.sum("pnl_pts").alias("pnl"), F.count(F.lit(1)).alias("trades"))
    w = W.partitionBy("symbol").orderBy("exit_date").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("cum_pnl", F.sum("pnl").over(w))
    return d.withColumn("drawdown", F.max("cum_pnl").over(w) - F.col("cum_pnl"))


def by_days_to_expiry(trades: DataFrame) -> DataFrame:
    dte = F.datediff("expiry", "entry_date")
    return trades.groupBy(dte.alias("dte"), "symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl_pts") > 0).alias("wins"), F.avg("pnl_pts").alias("avg_pnl"))


def pivot_dte(perf: DataFrame, symbols: list) -> DataFrame:
    return perf.groupBy("dte").pivot("symbol", symbols).agg(F.first("avg_pnl"))


def net_by_period(trades: DataFrame, as_of: Column) -> DataFrame:
    """Net P&L after cost for today, the last 7 days, the month and all time.
    Each period is a conditional aggregate; trades are not multiplied."""
    gross = F.col("pnl_pts") * F.col("lot_size") * F.col("lots")
    cost = itemised_cost(F.col("entry_premium"), F.lit(0.0), F.col("lot_size"), F.col("lots"), F.lit(False))["total_cost"]
    d = trades.select("exit_date", gross.alias("gross"), cost.alias("cost"))
    day = F.col("exit_date")
    periods = {"today": day == as_of, "week": day > F.date_sub(as_of, 7), "month": day >= F.trunc(as_of, "MM"), "all": F.lit(True)}
    aggs = []
    for p, cond in periods.items():
        aggs += [F.count_if(cond).alias(f"{p}_n"), F.sum(F.when(cond, F.col("gross"))).alias(f"{p}_g"), F.sum(F.when(cond, F.col("cost"))).alias(f"{p}_c")]
    g = d.agg(*aggs)
    z = F.lit(0.0)
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"{p}_n").alias("trades"), F.coalesce(f"{p}_g", z).alias("gross"),
                              F.coalesce(f"{p}_c", z).alias("cost")) for p in periods])
    return g.select(F.explode(rows).alias("r")).select("r.*").withColumn("net", F.col("gross") - F.col("cost"))


def breakdown(trades: DataFrame, by: str) -> DataFrame:
    return trades.groupBy(F.lit(by).alias("dimension"), F.col(by).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("trades"), (F.avg(flag(F.col("pnl_pts") > 0)) * 100).alias("win_rate"), F.sum("pnl_pts").alias("pnl"))


def regime_split(trades: DataFrame, bench: DataFrame, edge: float = 0.03) -> DataFrame:
    """Trades by the 20-row benchmark return on their entry day."""
    w = W.partitionBy(F.lit(0)).orderBy("date")
    r = bench.select(F.col("date").alias("entry_date"), (F.col("close") / F.lag("close", 20).over(w) - 1).alias("ret20"))
    j = trades.join(r, "entry_date", "left")
    return j.groupBy("symbol").agg(
        F.count_if(F.col("ret20") > edge).alias("bull"), F.count_if(F.col("ret20") < -edge).alias("bear"),
        F.count_if(F.col("ret20").between(-edge, edge)).alias("sideways"))


def drift_table(perf: DataFrame, windows=(30, 60, 90)) -> DataFrame:
    """Latest correlation per window as columns, widest baseline, any drift."""
    aggs = [F.max_by("correlation", F.when(F.col("window_days") == n, F.col("computed_at"))).alias(f"corr_{n}d") for n in windows]
    aggs.append(F.max_by("baseline_corr", F.when(F.col("window_days") == max(windows), F.col("computed_at"))).alias("baseline"))
    return perf.groupBy("feature_name", "symbol").agg(*aggs, F.max("drift_detected").alias("drifted"))


def rolling_win_rate(trades: DataFrame, days: int = 10) -> DataFrame:
    """Rolling wins over rolling trades, over the last ``days`` trading days."""
    d = trades.groupBy("symbol", "exit_date").agg(F.count_if(F.col("pnl_pts") >= 0).alias("wins"), F.count(F.lit(1)).alias("total"))
    w = W.partitionBy("symbol").orderBy("exit_date").rowsBetween(-(days - 1), 0)
    return d.withColumn("rolling_wr", F.sum("wins").over(w) / F.sum("total").over(w))


def stage_counts(trades: DataFrame, holdout: Column, live: Column) -> DataFrame:
    """Trades per symbol before the hold-out, inside it, and live."""
    d = F.col("exit_date")
    return trades.groupBy("symbol").agg(
        F.count_if(d < holdout).alias("backtest"), F.count_if((d >= holdout) & (d < live)).alias("holdout"), F.count_if(d >= live).alias("live"),
        F.months_between(F.max("exit_date"), F.min("exit_date")).alias("months"))


def top_attributions(attr: DataFrame, n: int = 10) -> DataFrame:
    return top_n(attr, ["trade_id"], [F.abs("attribution").desc(), F.col("feature_name")], n)


def run_history(runs: DataFrame) -> DataFrame:
    """Latest run per service with its duration and totals."""
    d = runs.withColumn("duration_s", F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))
    g = d.groupBy("service").agg(
        F.max_by(F.struct("started_at", "status", "duration_s"), F.struct("started_at", "version")).alias("_l"), F.count(F.lit(1)).alias("runs"),
        F.avg("duration_s").alias("avg_duration_s"))
    return g.select("service", "_l.*", "runs", "avg_duration_s")


def daily_levels(vix: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    d = vix.where(F.col("date") > F.date_sub(as_of, days))
    return d.groupBy("date").agg(F.max("vix").alias("vix"), F.max("spot").alias("spot"))
