"""Strategy trade tables: signals by window functions, exits by join or
aggregate. Only strategies with one open position per symbol walk a symbol's
bars in order, and those bars are bounded by its months or days."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions import blackscholes as BS
from tidebook.functions.exprs import attach_row, bucket_label, flag, round_half_even, safe_div
from tidebook.functions.market import annualised_return, directional_bias, round_trip_cost
from tidebook.operators.asof import asof_join
from tidebook.operators.calendar import weekend_triplets
from tidebook.operators.rolling import Series, period_rollup
from tidebook.operators.stats import expectancy, quantile_bins, split_label, summary_exprs
from tidebook.plans.options import SNAP, atm_rounded, near_expiry, put_call_ratio, spot_by_parity

# Costs, limits and exit ratios.
COST_PER_LEG = 0.001
TARGET_MULT = 2.0
TARGET_RATIO, STOP_RATIO, STRADDLE_COST = 0.50, 2.00, 160.0
BEST_STRIKE_STEPS, MIN_STRADDLE = 6, 5.0


def _legs(chain: DataFrame) -> DataFrame:
    def pick(side, v):
        return F.max(F.when(F.col("option_type") == side, F.col(v)))

    return chain.groupBy(*SNAP, "strike").agg(
        pick("CE", "ltp").alias("ce"), pick("PE", "ltp").alias("pe"), pick("CE", "oi").alias("ce_oi"), pick("PE", "oi").alias("pe_oi"))


def liquid_atm(chain: DataFrame, step: float, min_oi: int) -> DataFrame:
    """Most liquid strike within 3 steps of the theoretical at-the-money
    strike, with its straddle; the theoretical strike when none qualifies.

    Equal liquidity prefers the strike checked first: 0, +1, -1, +2, ... steps.
    """
    legs = _legs(chain).join(spot_by_parity(chain).select(*SNAP, "spot"), SNAP)
    r = round_half_even(F.col("spot") / step) * step
    k = F.col("strike")
    theo = legs.groupBy(*SNAP).agg(
        F.max(F.when(k == r, k)).alias("_exact"), F.min_by("strike", F.struct(F.abs(k - F.col("spot")), k)).alias("_near"))
    j = legs.join(theo.select(*SNAP, F.coalesce("_exact", "_near").alias("theoretical")), SNAP)
    off = (k - F.col("theoretical")) / step
    order = F.when(off > 0, 2 * off - 1).otherwise(-2 * off)
    ok = (F.abs(off) <= 3) & (off == F.floor(off)) & (F.col("ce_oi") >= min_oi) & (F.col("pe_oi") >= min_oi)
    total = F.col("ce_oi") + F.col("pe_oi")
    row = F.struct("strike", "ce", "pe", "ce_oi", "pe_oi")
    g = j.groupBy(*SNAP).agg(
        F.max("spot").alias("spot"), F.max_by(row, F.when(ok, F.struct(total, -order))).alias("_best"),
        F.max_by(row, F.when(k == F.col("theoretical"), F.lit(1))).alias("_theo"), F.max(flag(ok)).alias("liquidity_ok"))
    b = F.when(F.col("liquidity_ok") == 1, F.col("_best")).otherwise(F.col("_theo"))
    zero = F.lit(0.0)
    return g.withColumn("_b", b).select(
        *SNAP, "spot", F.col("_b.strike").alias("atm_strike"), F.coalesce(F.col("_b.ce") + F.col("_b.pe"), zero).alias("straddle"),
        F.coalesce(F.col("_b.ce_oi").cast("double"), zero).alias("oi_ce"), F.coalesce(F.col("_b.pe_oi").cast("double"), zero).alias("oi_pe"), "liquidity_ok")


def expiry_edge(chain: DataFrame, settle: DataFrame, step: float, min_oi: int, iv: DataFrame | None = None) -> DataFrame:
    """Straddle sold on the last day before expiry and held to it: implied
    against realised move, and the best strike in hindsight.

    ``settle`` is (symbol, expiry, spot_expiry)."""
    key = ["symbol", "expiry"]
    t1 = chain.where("snap_date < expiry").groupBy(*key).agg(F.max("snap_date").alias("snap_date"))
    d1 = chain.join(t1, SNAP, "left_semi")
    a = liquid_atm(d1, step, min_oi).join(settle, key, "left").na.fill(0.0, ["spot_expiry"])
    exit_px = _legs(chain.where("snap_date = expiry")).where("ce is not null and pe is not null").select(
        *key, F.col("strike").alias("atm_strike"), (F.col("ce") + F.col("pe")).alias("_exit_px"))
    a = a.join(exit_px, [*key, "atm_strike"], "left")
    se, s1, k = F.col("spot_expiry"), F.col("spot"), F.col("atm_strike")
    have = se > 0
    intrinsic = F.abs(se - k)
    a = a.withColumn("exit_1dte", F.when(have, F.coalesce("_exit_px", intrinsic)).otherwise(0.0))
    a = a.withColumn("profit_1dte_pts", F.col("straddle") - F.col("exit_1dte"))
    a = a.withColumn("profit_1dte_pct", F.coalesce(safe_div(F.col("profit_1dte_pts") * 100, "straddle"), F.lit(0.0)))
    a = a.withColumn("implied_move_pct", F.col("straddle") / s1 * 100)
    a = a.withColumn("realized_move_pct", F.when(have, F.abs(se - s1) / s1 * 100).otherwise(0.0))
    a = a.withColumn("vrp", F.col("implied_move_pct") - F.col("realized_move_pct")).withColumn("win_1dte", flag(F.col("profit_1dte_pts") > 0))
    if iv is not None:
        est = BS.straddle("spot", "atm_strike", F.lit(1 / 252), F.col("atm_iv") / 100)
        a = a.join(iv.select(*SNAP, "atm_iv"), SNAP, "left").withColumn("estimated_0dte_entry", F.coalesce(est, F.lit(0.0)))
        out0 = F.when(have, intrinsic).otherwise(F.col("exit_1dte"))
        a = a.withColumn("profit_0dte_pts", F.col("estimated_0dte_entry") - out0)
        a = a.withColumn("profit_0dte_pct", F.coalesce(safe_div(F.col("profit_0dte_pts") * 100, "estimated_0dte_entry"), F.lit(0.0)))
    best = _legs(d1).where("ce is not null and pe is not null").join(a.select(*SNAP, "spot", "spot_expiry"), SNAP)
    ent = F.col("ce") + F.col("pe")
    ref = F.when(se > 0, se).otherwise(F.col("spot"))
    base = round_half_even(F.col("spot") / step) * step
    off = (F.col("strike") - base) / step
    best = best.where((ent >= MIN_STRADDLE) & (F.abs(off) <= BEST_STRIKE_STEPS) & (off == F.floor(off)))
    pts = ent - F.abs(F.col("strike") - ref)
    g = best.withColumn("_pts", pts).withColumn("_pct", pts / ent * 100).groupBy(*key).agg(
        F.max_by(F.struct("strike", "_pts", "_pct"), F.struct("_pct", -F.col("strike"))).alias("_b"))
    a = a.join(g, key, "left")
    return a.withColumnRenamed("snap_date", "t1_date").withColumns({
        "best_strike": F.coalesce("_b.strike", base), "best_profit_pts": F.coalesce("_b._pts", F.lit(0.0)), "best_profit_pct": F.coalesce("_b._pct", F.lit(0.0)),
    }).drop("_b", "_exit_px")


def edge_context(edges: DataFrame, signals: DataFrame, index_days: DataFrame) -> DataFrame:
    """Edge rows with the signals of their entry day (``signals`` per symbol
    and snap_date) and the index's price action on that day. What is unknown
    counts as 0 for signals and stays NULL for price action."""
    names = ["iv_rank", "atm_iv", "pcr", "term_slope", "skew_2pct"]
    s = signals.select("symbol", F.col("snap_date").alias("t1_date"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    p = index_days.select(F.col("date").alias("t1_date"), "range_vs_atr", "inside_bar", "above_ma20")
    return edges.join(s, ["symbol", "t1_date"], "left").na.fill(0.0, names).join(p, "t1_date", "left")


# Bucket edges and labels, and the fewest rows of a bucket and of its section.
EDGE_BUCKETS = {
    "iv_rank": ([20, 40, 60, 80], ["0-20", "20-40", "40-60", "60-80", "80+"]),
    "atm_iv": ([12, 16, 20, 25], ["<12", "12-16", "16-20", "20-25", ">25"]),
    "pcr": ([0.7, 1.0, 1.3], ["<0.7", "0.7-1.0", "1.0-1.3", ">1.3"]),
    "term_slope": ([-0.02, 0, 0.02, 0.04], ["<-2%", "-2-0%", "0-2%", "2-4%", ">4%"]),
    "skew_2pct": ([0, 0.01, 0.02, 0.04], ["<0", "0-1%", "1-2%", "2-4%", ">4%"]),
    "range_vs_atr": ([0.6, 1.2], ["tight", "normal", "wide"]),
}
MIN_BUCKET, MIN_SURFACE, MIN_PRICE_ACTION = 3, 10, 6


def edge_dimensions() -> dict[str, Column]:
    """Bucket of an edge row in every dimension; NULL keeps it out of a dimension."""
    c = F.col
    d = {n: bucket_label(n, edges, labels) for n, (edges, labels) in EDGE_BUCKETS.items()}
    d["term_slope"] = F.when(c("term_slope") != 0, d["term_slope"])
    d["skew_2pct"] = F.when((c("term_slope") != 0) & (c("skew_2pct") != 0), d["skew_2pct"])
    d["range_vs_atr"] = F.when(c("range_vs_atr").isNotNull(), d["range_vs_atr"])
    d["weekday"] = F.when(F.weekday("expiry") < 5, F.date_format("expiry", "EEEE"))
    d["inside_bar"] = F.when(c("inside_bar") == 1, "inside").when(c("inside_bar") == 0, "not inside")
    d["above_ma20"] = F.when(c("above_ma20") == 1, "above").when(c("above_ma20") == 0, "below")
    good = c("iv_rank").between(20, 70) & c("atm_iv").between(12, 22) & c("pcr").between(0.7, 1.3)
    d["conditions"] = F.when(good, "trade").otherwise("skip")
    return d


def edge_report(rows: DataFrame, by: Sequence[str] = (), profit: str = "profit_1dte_pts", win: str = "win_1dte") -> DataFrame:
    """(by, dimension, bucket, n, win_rate, expectancy, avg_profit) of edge rows
    in every dimension, by grouping sets over one scan.

    A bucket needs three rows. Term slope and skew need ten rows that have
    them, price action six; the combined conditions are always shown."""
    dims = edge_dimensions()
    by = list(by)
    d = rows.select(*by, profit, win, *[e.alias(f"_{n}") for n, e in dims.items()])
    cols = [F.col(f"_{n}") for n in dims]
    name = F.coalesce(*[F.when(F.grouping(f"_{n}") == 0, F.lit(n)) for n in dims])
    g = d.groupingSets([[*[F.col(b) for b in by], c] for c in cols], *by, *cols).agg(
        name.alias("dimension"), *expectancy(profit, win), F.avg(profit).alias("avg_profit"))
    g = g.withColumn("bucket", F.coalesce(*cols)).where("bucket is not null")
    whole = F.sum("n").over(W.partitionBy(*by, "dimension"))  # a section has at most five buckets
    dim = F.col("dimension")
    need = F.when(dim.isin("term_slope", "skew_2pct"), MIN_SURFACE).when(dim.isin("range_vs_atr", "inside_bar", "above_ma20"), MIN_PRICE_ACTION).otherwise(0)
    g = g.withColumn("_whole", whole).where((F.col("_whole") >= need) & (F.col("n") >= F.when(dim == "conditions", 1).otherwise(MIN_BUCKET)))
    return g.select(*by, "dimension", "bucket", "n", "win_rate", "expectancy", "avg_profit")


def weekend_decay(chain: DataFrame, settle: DataFrame, step: float, min_oi: int) -> DataFrame:
    """Straddle sold on Friday, marked on Monday and at expiry."""
    days = chain.select("symbol", F.col("snap_date").alias("date")).distinct()
    trip = weekend_triplets(days, chain.select("expiry").distinct())
    a = liquid_atm(chain, step, min_oi)
    fri = a.select("symbol", F.col("snap_date").alias("friday"), "expiry", F.col("spot").alias("spot_friday"), "atm_strike", F.col("straddle").alias("entry"))
    mon = a.select("symbol", F.col("snap_date").alias("monday"), "expiry", F.col("spot").alias("spot_monday"), F.col("straddle").alias("exit_mon"))
    j = trip.join(fri, ["friday", "expiry"]).join(mon, ["symbol", "monday", "expiry"]).where("entry > 0 and exit_mon > 0")
    j = j.join(settle, ["symbol", "expiry"], "left").na.fill(0.0, ["spot_expiry"])
    ex = F.when(F.col("spot_expiry") > 0, F.abs(F.col("spot_expiry") - F.col("atm_strike"))).otherwise(F.col("exit_mon"))
    e = F.col("entry")
    return j.select(
        "symbol", "expiry", "friday", "monday", "atm_strike", "entry", "exit_mon", (e - F.col("exit_mon")).alias("profit_mon_pts"),
        ((e - F.col("exit_mon")) / e * 100).alias("profit_mon_pct"), flag(e > F.col("exit_mon")).alias("win_mon"), ex.alias("exit_exp"),
        (e - ex).alias("profit_exp_pts"), flag(e > ex).alias("win_exp"),
        ((F.col("spot_monday") - F.col("spot_friday")) / F.col("spot_friday") * 100).alias("gap_pct"))


def weekly_straddle(chain: DataFrame, target: float = TARGET_RATIO, stop: float = STOP_RATIO, lots: DataFrame | None = None) -> DataFrame:
    """Straddle from the first day after the previous expiry to the first of
    target, stop or expiry. The first exit is a ``min_by`` over the days held."""
    key = ["symbol", "expiry"]
    exps = chain.select(*key).distinct()
    w = W.partitionBy("symbol").orderBy("expiry")
    exps = exps.withColumn("_prev", F.lag("expiry").over(w)).where("_prev is not null")
    days = chain.select(*SNAP).distinct()
    ent = days.join(exps, key).where(F.col("snap_date") > F.col("_prev")).groupBy(*key).agg(F.min("snap_date").alias("snap_date"))
    spots = spot_by_parity(chain).select(*SNAP, "spot")
    e = chain.join(ent, SNAP, "left_semi").join(spots, SNAP)
    legs = _legs(chain).where("ce is not null and pe is not null").select(*SNAP, "strike", (F.col("ce") + F.col("pe")).alias("_v"))
    pick = e.groupBy(*SNAP).agg(F.max("spot").alias("spot"), F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))).alias("strike"))
    e = pick.join(legs, [*SNAP, "strike"]).where("_v > 0").select(
        *key, F.col("snap_date").alias("entry_date"), "spot", "strike", F.col("_v").alias("entry_premium"))
    hold = days.join(e, key).where(F.col("snap_date") > F.col("entry_date"))
    hold = hold.join(legs, [*SNAP, "strike"], "left").join(spots.withColumnRenamed("spot", "_spot"), SNAP, "left")
    at_exp, v, p = F.col("snap_date") >= F.col("expiry"), F.col("_v"), F.col("entry_premium")
    why = F.when(at_exp, "expiry").when(v <= p * target, "target").when(v >= p * stop, "stop_loss")
    cost = F.when(at_exp, F.abs(F.coalesce("_spot", "spot") - F.col("strike"))).otherwise(v)
    hold = hold.withColumn("exit_reason", why).withColumn("exit_cost", cost).where("exit_reason is not null")
    x = hold.groupBy(*key).agg(F.min_by(F.struct("snap_date", "exit_reason", "exit_cost"), "snap_date").alias("_x"))
    t = e.join(x, key).select(
        *key, "entry_date", "strike", "entry_premium", F.col("_x.snap_date").alias("exit_date"), F.col("_x.exit_reason").alias("exit_reason"),
        F.col("_x.exit_cost").alias("exit_cost"))
    t = t.withColumn("pnl_points", F.col("entry_premium") - F.col("exit_cost")).withColumn("hold_days", F.datediff("exit_date", "entry_date"))
    if lots is not None:
        t = asof_join(t, lots, ["symbol"], "entry_date", "effective_from", ["lot_size"])
        t = t.withColumn("pnl_rupees", F.col("pnl_points") * F.coalesce("lot_size", F.lit(1)) - STRADDLE_COST)
    return t


def monthly_bars(bars: DataFrame) -> DataFrame:
    return period_rollup(bars, ["symbol"], F.trunc("date", "MM"), "month")


def _one_position(pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk one symbol's months: a signal seen in month i executes at the next open."""
    pdf = pdf.sort_values("month").reset_index(drop=True)
    out, held, state = [], None, "flat"
    for row in pdf.itertuples():
        if row.Index < 4:
            continue
        if state == "enter":
            held, state = row, "in"
        elif state == "leave":
            out.append((row.symbol, held.month, row.month, held.open, row.open, 0))
            state = "flat"
        if state == "flat" and row.enter:
            state = "enter"
        elif state == "in" and row.leave:
            state = "leave"
    if state in ("in", "leave") and len(pdf):
        last = pdf.iloc[-1]
        out.append((last.symbol, held.month, last.month, held.open, last.close, 1))
    return pd.DataFrame(out, columns=["symbol", "entry_month", "exit_month", "entry_px", "exit_px", "is_open"])


def monthly_breakout(bars: DataFrame) -> DataFrame:
    """Enter when a month closes above the high of the three months before it,
    leave when a month closes below the previous month's low."""
    s = Series(["symbol"], "month")
    m = monthly_bars(bars)
    pc, ph = s.lag("close"), F.max("high").over(s.w.rowsBetween(-4, -2))
    m = m.withColumn("enter", F.coalesce(pc > ph, F.lit(False))).withColumn("leave", F.coalesce(pc < s.lag("low", 2), F.lit(False)))
    n = m.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 6")
    m = m.join(n, "symbol", "left_semi")
    t = m.groupBy("symbol").applyInPandas(
        _one_position, "symbol string, entry_month date, exit_month date, entry_px double, exit_px double, is_open int")
    raw = F.col("exit_px") / F.col("entry_px") - 1
    return t.withColumn("hold_months", F.months_between("exit_month", "entry_month").cast("int")).withColumn("raw_ret", raw).withColumn(
        "net_ret", F.col("raw_ret") - 2 * COST_PER_LEG)


def _target_or_stop(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("date").reset_index(drop=True)
    out, held = [], None
    for row in pdf.itertuples():
        if held is not None:
            why = "target" if row.close >= TARGET_MULT * held.close else "stop" if row.close < row.prior_week_low else None
            if why:
                out.append((row.symbol, held.date, row.date, held.close, row.close, why))
                held = None
        if held is None and row.signal:
            held = row
    return pd.DataFrame(out, columns=["symbol", "entry_date", "exit_date", "entry_price", "exit_price", "exit_reason"])


def month_end_breakout(bars: DataFrame, lookback: int = 3) -> DataFrame:
    """Enter at a month-end close above the highs of the previous months; leave
    at twice the entry or below the low of the week before."""
    sm = Series(["symbol"], "month")
    m = bars.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(
        F.max_by("close", "date").alias("_c"), F.max("high").alias("_h"), F.max("date").alias("date"))
    prior = F.when(F.count("_h").over(sm.w.rowsBetween(-lookback, -1)) >= lookback, F.max("_h").over(sm.w.rowsBetween(-lookback, -1)))
    m = m.withColumn("_p", prior).select("symbol", "date", F.coalesce(F.col("_c") > F.col("_p"), F.lit(False)).alias("signal"))
    sw = Series(["symbol"], "week")
    wk = bars.groupBy("symbol", F.trunc("date", "week").alias("week")).agg(F.min("low").alias("_l")).withColumn("prior_week_low", sw.lag("_l"))
    d = bars.withColumn("week", F.trunc("date", "week")).join(wk.select("symbol", "week", "prior_week_low"), ["symbol", "week"])
    d = d.join(m, ["symbol", "date"], "left").select("symbol", "date", "close", "prior_week_low", F.coalesce("signal", F.lit(False)).alias("signal"))
    t = d.groupBy("symbol").applyInPandas(
        _target_or_stop, "symbol string, entry_date date, exit_date date, entry_price double, exit_price double, exit_reason string")
    t = t.withColumn("holding_days", F.datediff("exit_date", "entry_date")).withColumn("return_pct", (F.col("exit_price") / F.col("entry_price") - 1) * 100)
    return t.withColumn("xirr_annualized", annualised_return("entry_date", "exit_date", "return_pct"))


def momentum_quintiles(bars: DataFrame, min_stocks: int = 20, cost: float = COST_PER_LEG) -> DataFrame:
    """12-1 momentum quintiles per month with next-month returns and the
    running wealth of each quintile."""
    m = monthly_bars(bars).select("symbol", "month", "close")
    first = m.agg(F.add_months(F.min("month"), 13).alias("_start"))
    j = attach_row(m, first).where(F.col("month") >= F.col("_start")).drop("_start")
    for n in (1, 2, 12):
        j = j.join(m.select("symbol", F.add_months("month", n).alias("month"), F.col("close").alias(f"_c{n}")), ["symbol", "month"])
    j = j.select("symbol", "month", (F.col("_c2") / F.col("_c12") - 1).alias("mom"), (F.col("close") / F.col("_c1") - 1).alias("fwd"))
    n = j.groupBy("month").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_stocks)
    q = quantile_bins(j.join(n, "month", "left_semi"), ["month"], "mom", 5, "quintile")
    g = q.groupBy("month", "quintile").agg(
        F.count(F.lit(1)).alias("n_stocks"), F.avg("fwd").alias("raw_return"), F.median("fwd").alias("median_ret"), F.stddev_samp("fwd").alias("std"))
    g = g.withColumn("net_return", F.col("raw_return") - 2 * cost)
    w = W.partitionBy("quintile").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("log_wealth", F.sum(F.log1p("net_return")).over(w))
    return g.withColumn("wealth", F.exp("log_wealth"))


def option_signals(chain: DataFrame, vix: DataFrame, lot_size: int, side: str = "buy", step: float = 50.0) -> DataFrame:
    """Daily bias, at-the-money entry, exit three chain days later or at
    expiry, cost and hit flag."""
    near = near_expiry(chain, strict=True)
    spots = spot_by_parity(near).select(*SNAP, "spot")
    s = Series(["_k"], "snap_date")
    v = vix.select(F.col("date").alias("snap_date"), "vix", F.lit(0).alias("_k")).where("vix > 0")
    v = v.select("snap_date", "vix", F.coalesce(s.pct_rank("vix"), F.lit(0.0)).alias("vix_rank"))
    sd = Series(["symbol"], "snap_date")
    days = chain.select("symbol", "snap_date").distinct()
    days = days.select("symbol", "snap_date", sd.row_number().alias("_i"), F.coalesce(
        sd.lead("snap_date", 3), F.last("snap_date").over(sd.w.rowsBetween(W.currentRow, W.unboundedFollowing))).alias("_x"))
    j = put_call_ratio(near).where("total_ce_oi > 0").join(v, "snap_date").join(days, ["symbol", "snap_date"])
    j = j.where((F.col("vix_rank") != 0) | (F.col("_i") > 20)).withColumn("bias", directional_bias("pcr", "vix", "vix_rank")).where("bias <> 'neutral'")
    call = (F.col("bias") == "bullish") if side == "buy" else (F.col("bias") == "bearish")
    j = j.withColumn("entry_type", F.when(call, "CE").otherwise("PE"))
    ce, pe = (atm_rounded(near, spots, step, x).withColumn("entry_type", F.lit(x)) for x in ("CE", "PE"))
    j = j.join(ce.unionByName(pe), [*SNAP, "entry_type"]).where("_x > snap_date")
    j = j.withColumn("exit_date", F.least("_x", "expiry"))
    j = j.join(days.select("symbol", F.col("snap_date").alias("exit_date")), ["symbol", "exit_date"], "left_semi")
    px = chain.select("symbol", F.col("snap_date").alias("exit_date"), "expiry", F.col("strike").alias("atm_strike"), F.col("option_type").alias("entry_type"),
                      F.col("ltp").alias("exit_price"))
    j = j.join(px, ["symbol", "exit_date", "expiry", "atm_strike", "entry_type"], "left").na.fill(0.0, ["exit_price"])
    gross = F.col("exit_price") - F.col("entry_price") if side == "buy" else F.col("entry_price") - F.col("exit_price")
    j = j.withColumn("pnl", gross - round_trip_cost("entry_price", "exit_price", side, F.lit(lot_size)))
    return j.select("symbol", F.col("snap_date").alias("signal_date"), "expiry", "vix", "vix_rank", "pcr", "bias", "atm_strike", "entry_type", "entry_price",
                    "exit_date", "exit_price", "pnl", (F.col("pnl") / F.col("entry_price") * 100).alias("pnl_pct"), flag(F.col("pnl") > 0).alias("hit"))


def run_summary(trades: DataFrame, bench: DataFrame, entry: str, ret: str, split: Column) -> DataFrame:
    """Statistics per period (full, train, test) with the benchmark's mean
    monthly return and the alpha over it."""
    m = bench.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max_by("close", "date").alias("_c"))
    w = W.partitionBy(F.lit(0)).orderBy("month")
    b = m.select((F.col("_c") / F.lag("_c").over(w) - 1).alias("_r")).agg(F.avg("_r").alias("bm_monthly_ret"))
    g = split_label(trades, entry, split).groupBy("period").agg(*summary_exprs(ret, annual=12.0))
    return attach_row(g, b).withColumn("alpha_monthly", F.col("avg_ret") - F.col("bm_monthly_ret"))
