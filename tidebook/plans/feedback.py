"""Feedback on closed trades: drift, attribution, gates, statistics, sizing.
A symbol may hold a large share of all trades, so everything here is a
combining aggregate; no trade list is collected or sorted per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.exprs import attach_row, clip, flag, safe_div
from tidebook.functions.text import feature_json, feature_map
from tidebook.operators.running import current_streak
from tidebook.operators.stats import guarded_corr, top_n

# Drift windows and gate thresholds.
WINDOWS, BASELINE_DAYS, MIN_TRADES, DRIFT_LIMIT, MIN_DRIFTED = (30, 60, 90), 180, 10, 0.15, 2
BT_GATES = {"trades": 50, "win_rate": 0.55, "sharpe": 0.10, "years": 2.0}
PAPER_MIN_TRADES, PAPER_MAX_DRIFT = 30, -0.10
MICRO_MIN_TRADES = 20
MIN_WINNERS = 5
STAGES = {1: "BACKTEST", 2: "PAPER", 3: "MICRO_LIVE", 4: "FULL_LIVE"}


def feature_rows(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Feature columns packed as JSON without missing values."""
    return df.select(*keys, feature_json(names).alias("features_json"))


def explode_features(df: DataFrame, column: str = "features_json") -> DataFrame:
    """One row per (trade, feature); bad JSON and NULL values disappear."""
    e = df.withColumn("_m", feature_map(column)).select(*[c for c in df.columns if c != column], F.explode("_m").alias("feature_name", "feature_value"))
    return e.where("feature_value is not null")


def feature_drift(live: DataFrame, history: DataFrame, as_of: Column, date: str = "exit_date", windows=WINDOWS,
                  baseline_days: int = BASELINE_DAYS, min_trades: int = MIN_TRADES) -> DataFrame:
    """Correlation of each feature with winning, in recent windows of live
    trades against a baseline of live and historical trades.

    Windows are conditional aggregates of one pass; rows are not repeated per
    window."""
    cols = ["symbol", date, "pnl_pts", "features_json"]
    a = live.select(*cols).withColumn("_live", F.lit(1)).unionByName(history.select(*cols).withColumn("_live", F.lit(0)))
    e = explode_features(a.where(F.col(date) <= as_of)).withColumn("_win", flag(F.col("pnl_pts") >= 0).cast("double"))
    age = F.datediff(as_of, F.col(date))
    aggs = []
    for n in windows:
        e = e.withColumn(f"_x{n}", F.when((F.col("_live") == 1) & (age <= n), F.col("feature_value")))
        aggs += [F.count(f"_x{n}").alias(f"_n{n}"), guarded_corr(f"_x{n}", "_win").alias(f"_c{n}")]
    e = e.withColumn("_xb", F.when(age <= baseline_days, F.col("feature_value")))
    g = e.groupBy("symbol", "feature_name").agg(*aggs, F.count("_xb").alias("_nb"), guarded_corr("_xb", "_win").alias("_cb"))
    base = F.when(F.col("_nb") >= min_trades, F.col("_cb")).otherwise(0.0)
    rows = F.array(*[F.struct(F.lit(n).alias("window_days"), F.col(f"_n{n}").alias("n_trades"), F.col(f"_c{n}").alias("correlation")) for n in windows])
    d = g.select("symbol", "feature_name", base.alias("baseline_corr"), F.explode(rows).alias("_r")).select("symbol", "feature_name", "_r.*", "baseline_corr")
    d = d.where(F.col("n_trades") >= min_trades)
    drifted = (F.abs("baseline_corr") >= 1e-6) & (F.abs(F.col("correlation") - F.col("baseline_corr")) > DRIFT_LIMIT)
    return d.withColumn("drift_detected", flag(drifted))


def retrain_triggers(drift: DataFrame, window: int = 30, minimum: int = MIN_DRIFTED) -> DataFrame:
    """Symbols with at least ``minimum`` drifted features in the short window.
    The collected names are bounded by the number of features."""
    d = drift.where((F.col("window_days") == window) & (F.col("drift_detected") == 1))
    g = d.groupBy("symbol").agg(F.sort_array(F.collect_set("feature_name")).alias("_f"))
    return g.where(F.size("_f") >= minimum).select("symbol", F.array_join("_f", ", ").alias("drifted_features"), F.size("_f").alias("n_drifted"))


def loss_attribution(losses: DataFrame, winners: DataFrame) -> DataFrame:
    """Each losing trade's features in population deviations from the winners."""
    w = explode_features(winners.select("features_json"))
    prof = w.groupBy("feature_name").agg(F.avg("feature_value").alias("win_mean"), F.stddev_pop("feature_value").alias("_sd"))
    n_winners = winners.agg(F.count(F.lit(1)).alias("_n"))
    j = explode_features(losses).join(prof, "feature_name")
    j = attach_row(j, n_winners).where(F.col("_n") >= MIN_WINNERS).drop("_n")
    diff = F.col("feature_value") - F.col("win_mean")
    flat = F.when(F.abs(diff) < 1e-9, 0.0).otherwise(clip(diff * 10, -10, 10))
    return j.withColumn("attribution", F.when(F.col("_sd") < 1e-9, flat).otherwise(safe_div(diff, "_sd"))).drop("_sd")


def backtest_metrics(trades: DataFrame, by: str, pnl: str, date: str, win: Column) -> DataFrame:
    return trades.groupBy(by).agg(
        F.count(F.lit(1)).alias("bt_oos_trades"), F.avg(flag(win)).alias("bt_win_rate"),
        F.coalesce(safe_div(F.avg(pnl), F.stddev_samp(pnl)), F.lit(0.0)).alias("bt_sharpe"),
        (F.datediff(F.max(date), F.min(date)) / 365.0).alias("bt_years"))


def stage_metrics(trades: DataFrame, by: str, pnl: str, prefix: str) -> DataFrame:
    return trades.groupBy(by).agg(
        F.count(F.lit(1)).alias(f"{prefix}_trades"), F.avg(flag(F.col(pnl) > 0)).alias(f"{prefix}_win_rate"), F.sum(pnl).alias(f"{prefix}_net_pnl"))


def graduation(bt: DataFrame, paper: DataFrame, micro: DataFrame, by: str, min_years: float = BT_GATES["years"]) -> DataFrame:
    """Gates and stage 1-4 per strategy; all thresholds are inclusive except
    the drift and profit ones."""
    j = bt.join(paper, by, "left").join(micro, by, "left").na.fill(0)
    j = j.withColumn("paper_vs_bt_delta", F.col("paper_win_rate") - F.col("bt_win_rate"))
    gates = {
        "bt_gate_trades": F.col("bt_oos_trades") >= BT_GATES["trades"], "bt_gate_win_rate": F.col("bt_win_rate") >= BT_GATES["win_rate"],
        "bt_gate_sharpe": F.col("bt_sharpe") >= BT_GATES["sharpe"], "bt_gate_years": F.col("bt_years") >= min_years,
        "paper_gate_trades": F.col("paper_trades") >= PAPER_MIN_TRADES, "paper_gate_win_rate": F.col("paper_vs_bt_delta") > PAPER_MAX_DRIFT,
        "paper_gate_pnl": F.col("paper_net_pnl") > 0, "micro_gate_trades": F.col("micro_trades") >= MICRO_MIN_TRADES,
        "micro_gate_win_rate": F.col("micro_trades") >= MICRO_MIN_TRADES, "micro_gate_pnl": F.col("micro_net_pnl") > 0,
    }
    j = j.withColumns({k: flag(v) for k, v in gates.items()})
    def ok(prefix):
        return F.least(*[F.col(g) for g in gates if g.startswith(prefix)]) == 1

    stage = F.when(~ok("bt"), 1).when(~ok("paper"), 2).when(~ok("micro"), 3).otherwise(4)
    j = j.withColumn("stage", stage)
    return j.withColumn("stage_label", F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("stage")))


def trade_statistics(trades: DataFrame, by: list[str], pnl: str, order: list[str], score: str) -> DataFrame:
    """Counts, totals, best and worst trade, current streak, and win counts in
    the high and low score buckets."""
    win = F.col(pnl) > 0
    hi, lo = F.col(score) >= 70, F.col(score) < 50
    g = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), (F.avg(flag(win)) * 100).alias("win_rate"), F.sum(pnl).alias("total_pnl"),
        F.avg(pnl).alias("avg_pnl"), F.max_by("trade_id", F.struct(F.col(pnl), -F.col("trade_id"))).alias("best_trade"), F.max(pnl).alias("best_pnl"),
        F.min_by("trade_id", F.struct(pnl, "trade_id")).alias("worst_trade"), F.min(pnl).alias("worst_pnl"),
        F.count_if(hi).alias("hi_n"), F.count_if(hi & win).alias("hi_wins"), F.count_if(lo).alias("lo_n"), F.count_if(lo & win).alias("lo_wins"))
    return g.join(current_streak(trades.withColumn("_w", flag(win)), by, order, "_w"), by)


def recent_win_average(trades: DataFrame, by: list[str], order: list[str], pnl: str, lookback: int = 30, min_trades: int = 10) -> DataFrame:
    """Mean of the last ``lookback`` winning trades; NULL with little history."""
    last = top_n(trades.where(F.col(pnl) > 0), by, [F.col(o).desc() for o in order], lookback)
    a = last.groupBy(*by).agg(F.avg(pnl).alias("_a"))
    n = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return n.join(a, by, "left").select(*by, F.when(F.col("_n") >= min_trades, F.col("_a")).alias("avg_win"))
