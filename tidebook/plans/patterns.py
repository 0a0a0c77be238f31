"""Pattern mining on daily bars: moves, features, rules, labels, ratings,
predictions and their validation. All windows share one (symbol, date)
exchange; the bar history is never sliced per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.exprs import attach_row, flag, pct_change, safe_div
from tidebook.functions.market import opportunity_score, vix_regime
from tidebook.functions.rules import match_rules
from tidebook.operators.asof import asof_join, with_fallback
from tidebook.operators.dedup import latest_by
from tidebook.operators.recursive import ema, rsi
from tidebook.operators.rolling import Series, crossover, trailing_sums, volume_trend
from tidebook.operators.running import exact_quantiles
from tidebook.operators.stats import split_label, summary_exprs, two_sided_p

BARS = Series(["symbol"])

# Gap and history limits.
GAP_OPEN = 1.005
MIN_HISTORY = 30
FALLBACK_SCALE = 0.263

# Rating weights and gates.
RATING_WEIGHTS = {"win": 0.35, "sample": 0.20, "recency": 0.20, "risk": 0.25}
MIN_SAMPLE = 10
HARMFUL_SHARPE = -0.5


def detect_moves(bars: DataFrame, threshold: float, regimes: DataFrame | None = None) -> DataFrame:
    """Bars whose close moved at least ``threshold`` percent from the previous
    close, with direction and gap/intraday class."""
    d = bars.withColumn("prev_close", BARS.lag("close")).where("prev_close > 0")
    d = d.withColumn("pct_change", (F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100)
    d = d.where(F.abs("pct_change") >= threshold)
    ratio = F.col("open") / F.col("prev_close")
    up = F.col("close") > F.col("prev_close")
    kind = (
        F.when(up & (ratio >= GAP_OPEN), "gap_up").when(up, "intraday_surge")
        .when(ratio <= 2 - GAP_OPEN, "gap_down").otherwise("intraday_crash")
    )
    d = d.withColumn("direction", F.when(F.col("pct_change") > 0, "UP").otherwise("DOWN")).withColumn("event_type", kind)
    if regimes is None:
        return d
    return d.join(regimes, "date", "left").withColumn("market_regime", F.coalesce("market_regime", F.lit("")))


def price_features(bars: DataFrame) -> DataFrame:
    """Every price and volume feature of a bar, from history up to that bar."""
    s = BARS
    d = rsi(bars, ["symbol"], "date", "close", [14, 5])
    d = ema(d, ["symbol"], "date", "close", [20])
    d = trailing_sums(d, s, 200, {"_sum200": F.col("close")})
    d = d.withColumns({
        "_rn": s.row_number(), "_sma20": s.sma("close", 20), "_sma50": s.sma("close", 50),
        "_sma200": F.when(s.row_number() >= 200, F.col("_sum200") / 200.0),
        "_tr": s.true_range(), "volume_z5": s.zscore("volume", 5), "volume_z20": s.zscore("volume", 20),
        "volume_trend": volume_trend(s, "volume"), "bb_position": s.bollinger("close"),
        "return_5d": F.coalesce(s.ret("close", 5), F.lit(0.0)), "return_20d": F.coalesce(s.ret("close", 20), F.lit(0.0)),
        "drawdown_pct": s.drawdown("close"),
    })
    d = crossover(d, s, "close", "_sma20", "sma_20_cross")
    d = crossover(d, s, "close", "_sma50", "sma_50_cross")
    d = crossover(d, s, "close", "ema_20", "ema_20_cross")
    atr = F.when(F.col("_rn") >= 15, F.avg("_tr").over(s.rows(14))).otherwise(0.0)
    d = d.withColumn("atr_14", atr)
    d = d.withColumns({
        "atr_pct": F.coalesce(safe_div("atr_14", "close") * 100, F.lit(0.0)),
        "price_vs_sma20": F.coalesce(pct_change("close", "_sma20"), F.lit(0.0)),
        "price_vs_sma50": F.coalesce(pct_change("close", "_sma50"), F.lit(0.0)),
        "price_vs_sma200": F.coalesce(pct_change("close", "_sma200"), F.lit(0.0)),
        "n_hist": F.col("_rn"),
    })
    return d.drop("_rn", "_sma20", "_sma50", "_sma200", "_sum200", "_tr", "ema_20")


FEATURES = [
    "rsi_14", "rsi_5", "sma_20_cross", "sma_50_cross", "ema_20_cross", "price_vs_sma20", "price_vs_sma50",
    "price_vs_sma200", "volume_z5", "volume_z20", "volume_trend", "atr_14", "atr_pct", "bb_position", "return_5d",
    "return_20d", "drawdown_pct",
]


def event_features(bars: DataFrame, threshold: float) -> DataFrame:
    """Feature vector of each move, from the history that ends one row before
    it. Features are shifted by one row in the same window, so no join back to
    the bars is needed."""
    f = price_features(bars)
    prev = F.lag(F.struct(*FEATURES, "n_hist")).over(BARS.w)
    d = f.select("symbol", "date", "open", "high", "low", "close", "volume", prev.alias("_f"))
    m = detect_moves(d, threshold)
    return m.where(F.col("_f.n_hist") >= MIN_HISTORY).select(
        "symbol", F.col("date").alias("event_date"), "close", "direction", "event_type", "_f.*"
    )


def context(bench: DataFrame, flows: DataFrame, vix: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Per day: benchmark return over the 5 rows before it, flow sum over the
    3 rows before it (with a scaled fallback source), volatility and regime.

    One row per calendar day; every input is already aggregated by day, so the
    single-partition windows are bounded by the number of days."""
    one = F.lit(0)
    w = W.partitionBy(one).orderBy("date")
    last6 = F.collect_list("close").over(w.rowsBetween(-5, 0))
    b = bench.select("date", last6.alias("_c")).where(F.size("_c") >= 2)
    b = b.select("date", pct_change(F.element_at("_c", -1), F.element_at("_c", 1)).alias("nifty_trend_5d"))
    fl = flows
    if fallback is not None:
        alt = fallback.withColumn("net_value", (F.col("level") - F.lag("level").over(w)) * FALLBACK_SCALE)
        fl = with_fallback(flows.select("date", "net_value"), alt.where("net_value is not null").select("date", "net_value"), ["date"])
    fl = fl.select("date", F.sum("net_value").over(w.rowsBetween(-2, 0)).alias("fii_net_3d"))
    days = bench.select("date").union(flows.select("date")).union(vix.select("date")).distinct().withColumn("_k", one)
    j = asof_join(days, b.withColumn("_k", one), ["_k"], "date", "date", ["nifty_trend_5d"], allow_exact=False)
    j = asof_join(j, fl.withColumn("_k", one), ["_k"], "date", "date", ["fii_net_3d"], allow_exact=False)
    j = j.join(vix.select("date", F.col("vix").alias("vix_level")), "date", "left")
    return j.select(
        "date", F.coalesce("nifty_trend_5d", F.lit(0.0)).alias("nifty_trend_5d"),
        F.coalesce("fii_net_3d", F.lit(0.0)).alias("fii_net_3d"),
        F.coalesce("vix_level", F.lit(0.0)).alias("vix_level"), vix_regime("vix_level").alias("vix_regime"),
    )


def with_context(features: DataFrame, ctx: DataFrame, date: str = "event_date") -> DataFrame:
    j = features.join(ctx.withColumnRenamed("date", date), date, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("nifty_trend_5d", "fii_net_3d", "vix_level")})


def match_patterns(features: DataFrame, rules: dict, known: DataFrame | None = None) -> DataFrame:
    """(pattern, symbol, event date) of every match that is not recorded yet."""
    m = match_rules(features, rules)
    if known is not None:
        m = m.join(known, ["pattern_id", "symbol", "event_date"], "left_anti")
    return m.withColumn("match_score", F.lit(1.0))


def forward_labels(bars: DataFrame, hit_pct: float = 2.0, direction: Column | None = None, fill: float | None = None) -> DataFrame:
    """Forward returns 1/3/5 rows ahead, direction-aware hits and the worst
    close of the next three rows. ``fill`` replaces missing returns."""
    s = BARS
    d = bars.withColumns({f"_c{n}": s.lead("close", n) for n in (1, 2, 3, 4, 5)})
    up = (direction if direction is not None else F.lit("UP")) == "UP"
    out = {}
    for n in (1, 3, 5):
        r = pct_change(f"_c{n}", "close")
        out[f"return_{n}d"] = r if fill is None else F.coalesce(r, F.lit(fill))
        out[f"hit_2pct_{n}d"] = flag(F.when(up, r >= hit_pct).otherwise(r <= -hit_pct))
    worst = F.when(F.col("_c3").isNotNull(), pct_change(F.least("_c1", "_c2", "_c3"), "close"))
    out["max_adverse_3d"] = worst if fill is None else F.coalesce(worst, F.lit(fill))
    return d.where("close > 0").withColumns(out).drop("_c1", "_c2", "_c3", "_c4", "_c5")


def labelled_moves(bars: DataFrame, threshold: float, hit_pct: float = 2.0, fill: float | None = None) -> DataFrame:
    """Labels for moves only: leads are taken before the move filter."""
    direction = F.when(F.col("close") > BARS.lag("close"), F.lit("UP")).otherwise(F.lit("DOWN"))
    lab = forward_labels(bars.withColumn("_dir", direction), hit_pct, F.col("_dir"), fill)
    return detect_moves(lab, threshold).drop("_dir").withColumnRenamed("date", "signal_date")


def pattern_stats(backtests: DataFrame, by: list[str]) -> DataFrame:
    sharpe = F.coalesce(safe_div(F.avg("return_1d"), F.stddev_samp("return_1d")) * 252**0.5, F.lit(0.0))
    aggs = [F.count(F.lit(1)).alias("total_matches")]
    for n in (1, 3, 5):
        aggs += [(F.avg(f"hit_2pct_{n}d") * 100).alias(f"win_rate_{n}d"), F.avg(f"return_{n}d").alias(f"avg_return_{n}d")]
    return backtests.groupBy(*by).agg(*aggs, sharpe.alias("sharpe_1d"), F.min("max_adverse_3d").alias("max_drawdown_3d"))


def rate_patterns(stats: DataFrame, matches: DataFrame, as_of: Column, by: str = "pattern_id", window_days: int = 90) -> DataFrame:
    """1-5 stars from hit rate, sample size, recency and clipped Sharpe."""
    rec = matches.groupBy(by).agg(
        F.round(F.avg(flag(F.col("signal_date") >= F.date_sub(as_of, window_days))), 4).alias("recency_score"),
        F.round(F.avg("hit_2pct_1d"), 4).alias("win_rate"),
    )
    j = stats.join(rec, by, "left").na.fill(0.0, ["recency_score", "win_rate"])
    n, sh = F.col("total_matches"), F.col("sharpe_1d")
    sample = F.least(F.lit(1.0), F.log10(F.greatest(n, F.lit(1))) / F.log10(F.lit(1000.0)))
    risk = F.round((F.greatest(F.lit(-3.0), F.least(F.lit(3.0), sh)) + 3) / 6, 4)
    w = RATING_WEIGHTS
    score = F.round(F.col("win_rate") * w["win"] + sample * w["sample"] + F.col("recency_score") * w["recency"] + risk * w["risk"], 4)
    few, bad = n < MIN_SAMPLE, sh < HARMFUL_SHARPE
    stars = F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(F.round(score / 0.20, 6))))
    zero = F.lit(0.0)
    return j.select(
        by, F.when(few | bad, 1).otherwise(stars).cast("int").alias("stars"), n.alias("sample_size"),
        F.when(few, zero).otherwise(F.col("win_rate")).alias("win_rate"),
        F.when(few, zero).otherwise(F.col("recency_score")).alias("recency_score"),
        F.when(few, zero).otherwise(risk).alias("risk_adj_return"), flag(few).alias("needs_more_data"), sh.alias("sharpe_1d"),
    )


def predict(features_latest: DataFrame, rules: dict, ratings: DataFrame, moves: DataFrame, as_of: Column, target: Column,
            min_confidence: float = 60.0, min_stars: int = 3, lookback_days: int = 30) -> DataFrame:
    """Today's features against well-rated rules; direction is that of the
    latest move in the lookback, else UP."""
    m = match_rules(features_latest, rules).join(ratings.where(F.col("stars") >= min_stars), "pattern_id")
    conf = (
        F.col("win_rate") * 100 * F.when(F.col("stars") >= 4, 1.10).otherwise(1.0)
        * F.when(F.col("recency_score") > 0.5, 1.05).otherwise(1.0) * F.when(F.col("vix_level") > 20, 0.90).otherwise(1.0)
    )
    m = m.withColumn("confidence_pct", F.round(F.least(F.lit(95.0), conf), 2)).where(F.col("confidence_pct") >= min_confidence)
    recent = moves.where(F.col("date").between(F.date_sub(as_of, lookback_days), as_of))
    dirs = recent.groupBy("symbol").agg(F.max_by("direction", "date").alias("_d"))
    j = m.join(dirs, "symbol", "left")
    return j.select(
        as_of.alias("prediction_date"), target.alias("target_date"), "symbol", "pattern_id", "stars", "confidence_pct",
        F.coalesce("_d", F.lit("UP")).alias("predicted_direction"), F.lit(2.0).alias("predicted_min_pct"), F.lit("open").alias("status"),
    )


def validate_predictions(preds: DataFrame, bars: DataFrame, as_of: Column, grace_days: int = 5) -> DataFrame:
    """Entry at the open of the target date, closes 1/3/5 rows after the
    prediction date. Rows without a target bar expire after the grace period."""
    s = BARS
    fwd = bars.select("symbol", F.col("date").alias("prediction_date"), *[s.lead("close", n).alias(f"_c{n}") for n in (1, 3, 5)])
    ent = bars.select("symbol", F.col("date").alias("target_date"), F.col("open").alias("entry_price"))
    j = preds.join(fwd, ["symbol", "prediction_date"], "left").join(ent, ["symbol", "target_date"], "left")
    up, floor_ = F.col("predicted_direction") == "UP", F.col("predicted_min_pct")
    out = {}
    for n in (1, 3, 5):
        r = F.round(pct_change(f"_c{n}", "entry_price"), 4)
        out[f"actual_pct_{n}d"] = F.coalesce(r, F.lit(0.0))
        out[f"was_correct_{n}d"] = flag(F.when(up, r >= floor_).otherwise(r <= -floor_))
    j = j.withColumns(out)
    hit = F.greatest("was_correct_1d", "was_correct_3d", "was_correct_5d")
    have = F.col("entry_price") > 0
    status = F.when(have & (hit == 1), "hit").when(have, "miss").when(F.date_add("target_date", grace_days) < as_of, "expired").otherwise("open")
    return j.select(
        "symbol", "pattern_id", "prediction_date", "target_date", "predicted_direction",
        F.coalesce("entry_price", F.lit(0.0)).alias("entry_price"), *out, F.when(have, hit).otherwise(0).alias("hit_threshold"),
        status.alias("status"),
    )


def miss_rates(moves: DataFrame, preds: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Moves without a prediction, and resolved predictions that were wrong."""
    m = moves.where(F.col("date").between(lo, hi))
    p = preds.where(F.col("prediction_date").between(lo, hi))
    marks = p.select("symbol", F.col("prediction_date").alias("date")).distinct().withColumn("_p", F.lit(1))
    a = m.join(marks, ["symbol", "date"], "left").agg(
        F.count(F.lit(1)).alias("total_events"), F.sum(flag(F.col("_p").isNull())).alias("missed_events"),
        F.count_distinct("symbol").alias("symbols_reviewed"),
    )
    done = p.where("status <> 'open'").agg(
        F.count(F.lit(1)).alias("total_preds"), F.sum(flag(F.col("status").isin("miss", "expired"))).alias("false_positives")
    )
    return attach_row(a, done).select(
        "*", F.coalesce(safe_div("missed_events", "total_events"), F.lit(0.0)).alias("false_negative_rate"),
        F.coalesce(safe_div("false_positives", "total_preds"), F.lit(0.0)).alias("false_positive_rate"),
    )


def walkforward(backtests: DataFrame, train_end: Column, by: str = "pattern_id", ret: str = "return_5d") -> DataFrame:
    """Train and test statistics side by side with the edge flag."""
    d = split_label(backtests.where(F.col(ret).isNotNull()), "signal_date", train_end).where("period <> 'full'")
    g = d.groupBy(by, "period").agg(*summary_exprs(ret, annual=252.0))
    t = {p: g.where(F.col("period") == p).select(by, *[F.col(c).alias(f"{p}_{c}") for c in ("n", "win_rate", "avg_ret", "sharpe")]) for p in ("train", "test")}
    j = t["train"].join(t["test"], by)
    edge = (
        (F.col("train_win_rate") > 50) & (F.col("test_win_rate") > 50) & (F.col("train_avg_ret") > 0)
        & (F.col("test_avg_ret") > 0) & (F.col("test_sharpe") >= F.col("train_sharpe") * 0.5)
    )
    return j.withColumn("edge", flag(edge))


def flow_momentum(flows: DataFrame, bench: DataFrame) -> DataFrame:
    """Flow sums over 3/5/10 rows against forward benchmark returns, by
    terciles of the flow: bucket means, difference and its p-value."""
    w = W.partitionBy(F.lit(0)).orderBy("date")
    f = flows.select("date", *[
        F.when(F.count("net_value").over(w.rowsBetween(-(n - 1), 0)) >= n, F.sum("net_value").over(w.rowsBetween(-(n - 1), 0))).alias(f"flow_{n}d")
        for n in (3, 5, 10)
    ])
    b = bench.select("date", *[(F.lead("close", n).over(w) / F.col("close") - 1).alias(f"_r{n}") for n in (5, 10, 20)])
    b = b.select("date", *[(F.col(f"_r{n}") * 100).alias(f"ret_{n}d") for n in (5, 10, 20)])
    j = f.join(b, "date").na.drop()
    long = j.select("date", "ret_5d", "ret_10d", "ret_20d", F.explode(F.array(*[
        F.struct(F.lit(f"flow_{n}d").alias("signal"), F.col(f"flow_{n}d").alias("flow")) for n in (3, 5, 10)
    ])).alias("_s")).select("*", "_s.*").drop("_s")
    q = exact_quantiles(long, ["signal"], "flow", {"p33": 0.33, "p66": 0.66})
    lab = F.when(F.col("flow") >= F.col("p66"), "buy").when(F.col("flow") <= F.col("p33"), "sell").otherwise("neutral")
    t = long.join(F.broadcast(q), "signal").withColumn("bucket", lab)
    aggs = []
    for r in ("ret_5d", "ret_10d", "ret_20d"):
        for side in ("buy", "neutral", "sell"):
            x = F.when(F.col("bucket") == side, F.col(r))
            aggs += [F.avg(x).alias(f"_{r}_{side}_m"), F.var_samp(x).alias(f"_{r}_{side}_v"), F.count(x).alias(f"_{r}_{side}_n")]
    g = t.groupBy("signal").agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(r).alias("horizon"), F.col(f"_{r}_buy_m").alias("buy_mean"), F.col(f"_{r}_neutral_m").alias("neutral_mean"),
            F.col(f"_{r}_sell_m").alias("sell_mean"),
            safe_div(F.col(f"_{r}_buy_m") - F.col(f"_{r}_sell_m"), F.sqrt(
                F.col(f"_{r}_buy_v") / F.col(f"_{r}_buy_n") + F.col(f"_{r}_sell_v") / F.col(f"_{r}_sell_n"))).alias("t_stat"),
        ) for r in ("ret_5d", "ret_10d", "ret_20d")
    ])
    return g.select("signal", F.explode(rows).alias("_r")).select("signal", "_r.*").withColumn("p_value", two_sided_p("t_stat"))


def price_action(bars: DataFrame) -> DataFrame:
    """Price-action snapshot of every bar with at least 22 rows of history.

    The narrow-range streak compares earlier ranges with the mean of the last
    20 of them. At least one of those 20 is not below their mean, so the streak
    always ends inside that window and a 20-row list is enough."""
    s = BARS
    rng = (F.col("high") - F.col("low")) / F.col("close") * 100
    wk = F.trunc("date", "week")
    weekly = bars.groupBy("symbol", wk.alias("week")).agg(F.min_by("open", "date").alias("w_open"))
    wwin = W.partitionBy("symbol").orderBy("week")
    whl = bars.groupBy("symbol", wk.alias("week")).agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    whl = whl.select("symbol", "week", F.lag("_h").over(wwin).alias("p_high"), F.lag("_l").over(wwin).alias("p_low"))
    inweek = W.partitionBy("symbol", "week").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = bars.withColumn("week", wk).withColumn("range_pct", rng)
    d = d.withColumns({
        "_rn": s.row_number(), "prev_range_pct": s.lag("range_pct"),
        "_atr": F.avg("range_pct").over(s.w.rowsBetween(-20, -1)),
        "_past": F.collect_list("range_pct").over(s.w.rowsBetween(-20, -1)),
        "_ma20": F.avg("close").over(s.rows(20)), "_ma50": F.avg("close").over(s.rows(50)),
        "_wh": F.max("high").over(inweek), "_wl": F.min("low").over(inweek),
    }).where("_rn >= 22")
    d = d.withColumn("_ma50", F.when(F.col("_rn") >= 50, F.col("_ma50")).otherwise(F.col("_ma20")))
    d = d.join(weekly, ["symbol", "week"]).join(whl, ["symbol", "week"])
    # Position of the latest earlier range that was not narrow; everything after it is the streak.
    wide = F.array_position(F.transform(F.reverse("_past"), lambda x: x >= F.col("_atr")), True)
    streak = F.when(wide > 0, wide - 1).otherwise(F.size("_past"))
    return d.select(
        "symbol", "date", "prev_range_pct", F.coalesce(safe_div("prev_range_pct", "_atr"), F.lit(0.0)).alias("range_vs_atr"),
        flag((F.col("_wh") < F.col("p_high")) & (F.col("_wl") > F.col("p_low"))).alias("inside_bar"),
        pct_change("close", "_ma20").alias("ma20_dist_pct"), pct_change("close", "_ma50").alias("ma50_dist_pct"),
        flag(F.col("close") > F.col("_ma20")).alias("above_ma20"),
        F.coalesce(safe_div(F.col("_wh") - F.col("_wl"), "w_open") * 100, F.lit(0.0)).alias("week_range_pct"),
        streak.cast("int").alias("consec_inside_days"),
    )


def regime_table(vix: DataFrame) -> DataFrame:
    """Daily regime, trend against the last non-zero spot, and opportunity."""
    w = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("spot") > 0, F.col("spot")), ignorenulls=True).over(w)
    d = vix.withColumn("_p", prev).withColumn("vix_regime", vix_regime("vix"))
    both = (F.col("_p") > 0) & (F.col("spot") > 0)
    d = d.withColumn("trend", F.when(both & (F.col("spot") > F.col("_p")), "up").when(both, "down").otherwise("flat"))
    d = d.withColumn("opportunity_score", opportunity_score("vix_regime", "trend"))
    return d.select(
        "date", "vix_regime", "trend", "opportunity_score", flag(F.col("opportunity_score") >= 50).alias("trade_recommended"),
        F.format_string("VIX=%.1f (%s), trend=%s", "vix", "vix_regime", "trend").alias("reason"),
    )


def latest_features(features: DataFrame) -> DataFrame:
    return latest_by(features, ["symbol"], ["date"])
