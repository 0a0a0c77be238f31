"""Multi-leg spread pricing, parameter choice and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.exprs import flag, repeat_for, safe_div
from tidebook.functions.market import SCORE_THRESHOLD, VIX_MAX, VIX_MIN, pick_structure, position_lots, trade_score
from tidebook.operators.asof import asof_join
from tidebook.operators.stats import top_n
from tidebook.plans.options import SNAP, atm_min_gap, strike_step

STRUCTURES = ("iron_condor", "bull_put", "bear_call")
FLY_WINGS = {"NIFTY": 4, "BANKNIFTY": 5, "FINNIFTY": 4, "MIDCPNIFTY": 8}


# Short legs 1-4 steps out, wings 1-4 steps wide.
GRID_NAMES = ("strategy", "short_n", "wing_m")
GRID = [(s, n, m) for s in STRUCTURES for n in range(1, 5) for m in range(1, 5)]


def _leg_key(side: str | Column, strike: Column) -> Column:
    s = F.lit(side) if isinstance(side, str) else side
    return F.concat(s, F.round(strike * 100).cast("long").cast("string"))


def day_prices(chain: DataFrame, out: str = "prices") -> DataFrame:
    """(side, strike) -> price map per (symbol, snap_date, expiry). A snapshot
    holds one price per strike and side, so the map is bounded by the strikes."""
    entry = F.struct(_leg_key(F.col("option_type"), F.col("strike")).alias("k"), F.col("ltp").alias("v"))
    return chain.groupBy(*SNAP).agg(F.map_from_entries(F.collect_list(entry)).alias(out))


def leg(prices: str, strike: Column, side: str) -> Column:
    return F.try_element_at(F.col(prices), _leg_key(side, strike))


def consecutive_days(chain: DataFrame) -> DataFrame:
    """(symbol, entry day, next day) over the days that have snapshots."""
    d = chain.select("symbol", "snap_date").distinct()
    w = W.partitionBy("symbol").orderBy("snap_date")
    return d.select("symbol", F.lag("snap_date").over(w).alias("entry_date"), F.col("snap_date").alias("exit_date")).where("entry_date is not null")


def price_spreads(chain: DataFrame, max_dte: int = 5, fly_wings: dict | None = None, default_wing: int = 4) -> DataFrame:
    """Profit of every structure held from one snapshot day to the next.

    Prices are looked up in per-snapshot maps: the chain is shuffled once to
    build them and the parameter grid multiplies rows after that shuffle.
    """
    chain = chain.where("ltp > 0.05")
    pairs = consecutive_days(chain)
    prices = day_prices(chain)
    entry = prices.select("symbol", F.col("snap_date").alias("entry_date"), "expiry", F.col("prices").alias("pe_in"))
    exit_ = prices.select("symbol", F.col("snap_date").alias("exit_date"), "expiry", F.col("prices").alias("pe_out"))
    atm = atm_min_gap(chain).withColumnRenamed("snap_date", "entry_date")
    j = entry.join(pairs, ["symbol", "entry_date"]).where(
        (F.col("exit_date") <= F.col("expiry")) & (F.datediff("expiry", "exit_date") <= max_dte))
    j = j.join(atm, ["symbol", "entry_date", "expiry"]).join(exit_, ["symbol", "exit_date", "expiry"], "left")
    j = j.join(strike_step(chain), ["symbol", "expiry"])

    wing = F.lit(default_wing)
    for s, m in (fly_wings or FLY_WINGS).items():
        wing = F.when(F.col("symbol").cast("string") == str(s), m).otherwise(wing)
    g = repeat_for(j, GRID_NAMES, [*GRID, ("iron_fly", 0, 0)]).withColumn("wing_m", F.when(F.col("strategy") == "iron_fly", wing).otherwise(F.col("wing_m")))

    atm_k, step, n, m, st = (F.col(c) for c in ("atm_strike", "strike_step", "short_n", "wing_m", "strategy"))
    has_ce, has_pe = st != "bull_put", st != "bear_call"
    used = {"short_ce": ("CE", has_ce, atm_k + n * step), "short_pe": ("PE", has_pe, atm_k - n * step),
            "long_ce": ("CE", has_ce, atm_k + (n + m) * step), "long_pe": ("PE", has_pe, atm_k - (n + m) * step)}
    zero, fly_done = F.lit(0.0), (st == "iron_fly") & (F.col("exit_date") == F.col("expiry"))
    cols = {}
    for name, (side, on, strike) in used.items():
        cols[f"{name}_strike"] = F.when(on, strike).otherwise(zero)
        cols[f"{name}_entry"] = F.when(on, leg("pe_in", strike, side)).otherwise(zero)
        raw = leg("pe_out", strike, side)
        cols[f"{name}_settle"] = F.when(on, F.when(fly_done, F.coalesce(raw, zero)).otherwise(raw)).otherwise(zero)
    g = g.withColumns(cols)
    ok = F.lit(True)
    for name, (_, on, _) in used.items():
        ok = ok & (~on | (F.col(f"{name}_entry") >= 0.05)) & F.col(f"{name}_settle").isNotNull()
    g = g.where(ok)
    credit = F.col("short_ce_entry") + F.col("short_pe_entry") - (F.col("long_ce_entry") + F.col("long_pe_entry"))
    cost = F.col("short_ce_settle") + F.col("short_pe_settle") - (F.col("long_ce_settle") + F.col("long_pe_settle"))
    g = g.withColumn("net_credit", credit).where("net_credit > 0").withColumn("exit_cost", cost)
    g = g.withColumn("max_loss", m * step - F.col("net_credit"))
    raw_pnl = F.col("net_credit") - F.col("exit_cost")
    g = g.withColumn("pnl_pts", F.when(F.col("max_loss") > 0, F.greatest(raw_pnl, -F.col("max_loss"))).otherwise(raw_pnl))
    return g.select(
        "symbol", "expiry", "entry_date", "exit_date", "strategy", "short_n", "wing_m", "strike_step", "atm_strike", *cols,
        "net_credit", "max_loss", "exit_cost", "pnl_pts", (F.col("pnl_pts") / (m * step) * 100).alias("pnl_pct"), flag(F.col("pnl_pts") > 0).alias("target"))


def optimal_params(trades: DataFrame, min_trades: int = 5) -> DataFrame:
    """Statistics per symbol, structure and parameters. Sharpe uses the
    population std; zero percentages stay out of the percentage mean."""
    g = trades.groupBy("symbol", "strategy", "short_n", "wing_m").agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg("target").alias("win_rate"), F.avg("pnl_pts").alias("avg_pnl_pts"),
        F.coalesce(F.avg(F.when(F.col("pnl_pct") != 0, F.col("pnl_pct"))), F.lit(0.0)).alias("avg_pnl_pct"),
        (F.avg("pnl_pts") / (F.stddev_pop("pnl_pts") + 1e-9)).alias("sharpe_pct"), F.avg("net_credit").alias("avg_net_credit"),
        F.avg("max_loss").alias("avg_max_loss"), F.min_by("strike_step", F.struct("expiry", "entry_date")).alias("_step"))
    p2r = F.coalesce(safe_div(F.col("avg_net_credit") * 100, F.col("wing_m") * F.col("_step")), F.lit(0.0))
    return g.where(F.col("n_trades") >= min_trades).withColumn("premium_to_risk", p2r).drop("_step")


def best_params(optimal: DataFrame, min_trades: int = 10) -> DataFrame:
    """Highest Sharpe per (symbol, structure)."""
    o = optimal.where(F.col("n_trades") >= min_trades)
    return top_n(o, ["symbol", "strategy"], [F.col("sharpe_pct").desc(), F.col("short_n"), F.col("wing_m")], 1).drop("rank")


def track_record(trades: DataFrame, lot_size: int) -> DataFrame:
    """What closed trades showed up to each exit day: (symbol, score_date,
    strategy_type, confidence, avg_win). Confidence is the share of won trades
    of the structure in percent; avg_win the mean amount that a won trade of
    the symbol paid. Trades are summed per day first, so the windows run over
    days."""
    day = trades.groupBy("symbol", F.col("exit_date").alias("score_date"), F.col("strategy").alias("strategy_type")).agg(
        F.sum("target").alias("_w"), F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("target") == 1, F.col("pnl_pts"))).alias("_p"))
    own = W.partitionBy("symbol", "strategy_type").orderBy("score_date")
    all_ = W.partitionBy("symbol").orderBy("score_date")
    return day.select(
        "symbol", "score_date", "strategy_type", (F.sum("_w").over(own) * 100 / F.sum("_n").over(own)).alias("confidence"),
        safe_div(F.sum("_p").over(all_) * lot_size, F.sum("_w").over(all_)).alias("avg_win"))


def recommend(days: DataFrame, scores: DataFrame, chain: DataFrame, signals: DataFrame, optimal: DataFrame,
              capital: float, lot_size: int, min_confidence: float = 60.0, threshold: float = SCORE_THRESHOLD, min_ltp: float = 0.05) -> DataFrame:
    """Recommendation per (symbol, rec_date, expiry) of ``days``, for all days at once.

    Prices and signals come from the newest snapshot of the expiry on or before
    the day; contracts at or below ``min_ltp`` do not count. ``scores`` has
    (symbol, score_date, strategy_type, confidence, avg_win); the newest score
    of each structure within 7 days counts. ``signals`` has the inputs per
    (symbol, snap_date, expiry): vix, iv_rank, pcr, iv_skew, term_slope,
    skew_2pct and walls.
    """
    chain = chain.where(F.col("ltp") > min_ltp)
    shots = chain.select("symbol", "expiry", F.col("snap_date").alias("_shot")).distinct().withColumn("snap_date", F.col("_shot"))
    days = asof_join(days.select("symbol", "rec_date", "expiry").where("rec_date <= expiry"), shots, ["symbol", "expiry"], "rec_date", "_shot", ["snap_date"]).where("snap_date is not null")
    kinds = [(s,) for s in (*STRUCTURES, "iron_fly")]
    want = repeat_for(days, ["strategy_type"], kinds)
    sc = asof_join(want, scores, ["symbol", "strategy_type"], "rec_date", "score_date", ["confidence", "avg_win"], tolerance_days=7).where("confidence is not null")
    best = sc.groupBy("symbol", "rec_date", "expiry", "snap_date").agg(
        F.max_by(F.struct("strategy_type", "confidence", "avg_win"), F.struct("confidence", "strategy_type")).alias("_b"))
    j = best.select("symbol", "rec_date", "expiry", "snap_date", F.col("_b.strategy_type").alias("_ml"), F.col("_b.confidence").alias("confidence"), F.col("_b.avg_win").alias("avg_win"))
    j = j.join(signals, SNAP)
    parts = trade_score("confidence", "vix", "iv_rank", "pcr", "iv_skew", "term_slope")
    j = j.withColumns({c: e for c, e in parts.items()}).where(F.col("score") >= threshold)
    j = j.where(F.col("vix").isNull() | F.col("vix").between(VIX_MIN, VIX_MAX))
    strat = F.when(F.col("confidence") >= min_confidence, F.col("_ml")).otherwise(pick_structure("pcr", "iv_skew", "skew_2pct"))
    j = j.withColumn("strategy", strat)
    bp = best_params(optimal).select("symbol", "strategy", "short_n", "wing_m", "avg_max_loss")
    j = j.join(bp, ["symbol", "strategy"])
    j = j.withColumn("lots", position_lots(F.lit(capital), "avg_max_loss", F.lit(lot_size), "iv_rank", "avg_win"))

    atm = atm_min_gap(chain, min_leg=0.0, min_common=1)
    j = j.join(atm, SNAP).join(day_prices(chain), SNAP).join(strike_step(chain, min_oi=0), ["symbol", "expiry"])
    a, step, n, m, st = (F.col(c) for c in ("atm_strike", "strike_step", "short_n", "wing_m", "strategy"))
    sce, spe = a + n * step, a - n * step
    call_side, put_side = st.isin("iron_condor", "bear_call"), st.isin("iron_condor", "bull_put")
    inside = (call_side & (F.col("ce_wall_strike") > 0) & (sce < F.col("ce_wall_strike"))) | (
        put_side & (F.col("pe_wall_strike") > 0) & (spe > F.col("pe_wall_strike")))
    z = F.lit(0.0)
    pc = lambda k, side: F.coalesce(leg("prices", k, side), z)
    j = j.where(~inside).withColumns({
        "short_ce_strike": sce, "short_pe_strike": spe, "long_ce_strike": F.when(call_side, sce + m * step).otherwise(z),
        "long_pe_strike": F.when(put_side, spe - m * step).otherwise(z), "short_ce_entry": pc(sce, "CE"), "short_pe_entry": pc(spe, "PE"),
        "long_ce_entry": F.when(call_side, pc(sce + m * step, "CE")).otherwise(z), "long_pe_entry": F.when(put_side, pc(spe - m * step, "PE")).otherwise(z)})
    credit = F.col("short_ce_entry") + F.col("short_pe_entry") - F.col("long_ce_entry") - F.col("long_pe_entry")
    j = j.withColumn("net_credit", credit).withColumn("max_loss", F.when(m > 0, m * step - F.col("net_credit")).otherwise(z))
    return j.withColumn("capital_at_risk", F.col("max_loss") * F.col("lots") * lot_size).withColumn("outcome", F.lit("pending")).drop("prices", "_ml")


def fill_outcomes(recs: DataFrame, trades: DataFrame, as_of: Column, lot_size: int) -> DataFrame:
    """Outcome of pending recommendations whose expiry has passed. The join
    includes the priced snapshot, so a recommendation meets one trade at most."""
    keys = ["symbol", "expiry", "strategy", "short_n", "wing_m"]
    t = trades.select(*keys, F.col("entry_date").alias("snap_date"), F.col("pnl_pts").alias("_pnl"), F.col("target").alias("_t"))
    j = recs.join(t, [*keys, "snap_date"], "left")
    done = (F.col("outcome") == "pending") & (F.col("expiry") < as_of) & F.col("_pnl").isNotNull()
    return j.withColumns({
        "pnl_pts": F.when(done, F.col("_pnl")).otherwise(0.0),
        "pnl_amount": F.when(done, F.col("_pnl") * F.col("lots") * lot_size).otherwise(0.0),
        "outcome": F.when(done & (F.col("_t") == 1), "win").when(done, "loss").otherwise(F.col("outcome")),
    }).drop("_pnl", "_t")
