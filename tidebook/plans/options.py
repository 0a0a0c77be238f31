"""Option-chain analytics. A chain row is (symbol, snap_date, expiry, strike,
option_type, ltp, oi); one (symbol, snap_date, expiry) holds at most a few
hundred strikes, so windows and lists inside it are bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions import blackscholes as BS
from tidebook.functions.exprs import flag, round_half_even, safe_div
from tidebook.functions.market import directional_bias
from tidebook.operators.rolling import Series
from tidebook.operators.running import mode_of

SNAP = ["symbol", "snap_date", "expiry"]

# Surface limits, interpolation targets and skew bands.
MONEYNESS = (0.80, 1.20)
MIN_SURFACE_LTP = 5.0
TARGET_DTES = (7, 14, 30, 60, 90)
SKEW_LEVELS = {"skew_1pct": 0.99, "skew_2pct": 0.98, "skew_3pct": 0.97, "skew_5pct": 0.95}
SKEW_TOL = 0.015
OTM_RANGE = 0.03


def _side(side: str, value: str) -> Column:
    return F.when(F.col("option_type") == side, F.col(value))


def by_strike(chain: DataFrame, value: str = "ltp") -> DataFrame:
    """Call and put value side by side per strike: one shuffle, no self join."""
    return chain.groupBy(*SNAP, "strike").agg(F.max(_side("CE", value)).alias("ce"), F.max(_side("PE", value)).alias("pe"))


def both_legs(chain: DataFrame) -> DataFrame:
    return by_strike(chain).where("ce is not null and pe is not null")


def spot_by_parity(chain: DataFrame) -> DataFrame:
    """Spot = K + CE - PE at the strike with the smallest |CE - PE|."""
    legs = both_legs(chain)
    pick = F.min_by(F.struct("strike", "ce", "pe"), F.struct(F.abs(F.col("ce") - F.col("pe")), F.col("strike")))
    g = legs.groupBy(*SNAP).agg(pick.alias("_b"))
    return g.select(*SNAP, (F.col("_b.strike") + F.col("_b.ce") - F.col("_b.pe")).alias("spot"), F.col("_b.strike").alias("parity_strike"))


def atm_min_gap(chain: DataFrame, min_leg: float = 0.5, min_common: int = 2) -> DataFrame:
    """At-the-money strike with liquid legs; needs at least two common strikes."""
    legs = both_legs(chain).where((F.col("ce") > min_leg) & (F.col("pe") > min_leg))
    g = legs.groupBy(*SNAP).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("strike", F.struct(F.abs(F.col("ce") - F.col("pe")), F.col("strike"))).alias("atm_strike")
    )
    return g.where(F.col("_n") >= min_common).drop("_n")


def atm_nearest(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """Strike closest to spot; ties take the lowest."""
    j = chain.select(*SNAP, "strike").join(spots.select(*SNAP, "spot"), SNAP)
    return j.groupBy(*SNAP).agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))).alias("atm_strike"))


def atm_rounded(chain: DataFrame, spots: DataFrame, step: float, side: str) -> DataFrame:
    """round(spot/step)*step, else the first priced strike of +1, -1, +2, -2 steps."""
    c = chain.where((F.col("option_type") == side) & (F.col("ltp") > 0)).join(spots.select(*SNAP, "spot"), SNAP)
    k = (F.col("strike") - round_half_even(F.col("spot") / step) * step) / step
    order = F.when(k == 0, 0).when(k == 1, 1).when(k == -1, 2).when(k == 2, 3).when(k == -2, 4)
    c = c.withColumn("_o", order).where("_o is not null")
    return c.groupBy(*SNAP).agg(F.min_by(F.struct("strike", "ltp"), "_o").alias("_b")).select(
        *SNAP, F.col("_b.strike").alias("atm_strike"), F.col("_b.ltp").alias("entry_price"))


def put_call_ratio(chain: DataFrame) -> DataFrame:
    g = chain.groupBy(*SNAP).agg(
        F.coalesce(F.sum(_side("CE", "oi")), F.lit(0)).alias("total_ce_oi"), F.coalesce(F.sum(_side("PE", "oi")), F.lit(0)).alias("total_pe_oi"))
    return g.withColumn("pcr", F.coalesce(safe_div("total_pe_oi", "total_ce_oi"), F.lit(0.0)))


def writer_payout(chain: DataFrame) -> DataFrame:
    """Payout of option writers at every strike, by prefix sums:
    S*C0 - C1 + P1 - S*P0 with C over lower and P over higher strikes."""
    oi = chain.groupBy(*SNAP, "strike").agg(
        F.coalesce(F.sum(_side("CE", "oi")), F.lit(0)).cast("double").alias("_c"), F.coalesce(F.sum(_side("PE", "oi")), F.lit(0)).cast("double").alias("_p"))
    w = W.partitionBy(*SNAP).orderBy("strike")
    below, above = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    s, z = F.col("strike"), F.lit(0.0)
    c0, c1 = F.coalesce(F.sum("_c").over(below), z), F.coalesce(F.sum(s * F.col("_c")).over(below), z)
    p0, p1 = F.coalesce(F.sum("_p").over(above), z), F.coalesce(F.sum(s * F.col("_p")).over(above), z)
    return oi.select(*SNAP, "strike", (s * c0 - c1 + p1 - s * p0).alias("payout"))


def max_pain(chain: DataFrame) -> DataFrame:
    return writer_payout(chain).groupBy(*SNAP).agg(F.min_by("strike", F.struct("payout", "strike")).alias("max_pain_strike"))


def near_expiry(chain: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of the nearest expiry on or after the snapshot day."""
    ok = F.col("expiry") > F.col("snap_date") if strict else F.col("expiry") >= F.col("snap_date")
    near = chain.where(ok).groupBy("symbol", "snap_date").agg(F.min("expiry").alias("expiry"))
    return chain.join(near, SNAP, "left_semi")


def eod_summary(chain: DataFrame) -> DataFrame:
    """One row per (symbol, day): spot, at-the-money strike, open interest,
    put-call ratio, max pain and walls of the nearest expiry."""
    near = near_expiry(chain)
    spots = spot_by_parity(near)
    out = put_call_ratio(near).join(spots.select(*SNAP, "spot"), SNAP, "left")
    out = out.join(atm_nearest(near, spots), SNAP, "left").join(max_pain(near), SNAP, "left").join(oi_walls(near), SNAP, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("spot", "atm_strike", "ce_wall_strike", "pe_wall_strike")})


def oi_walls(chain: DataFrame) -> DataFrame:
    """Strike of the largest call and put open interest; ties take the lowest."""
    def wall(side):
        o = F.when(F.col("option_type") == side, F.struct(F.col("oi"), -F.col("strike")))
        return F.coalesce(F.max_by("strike", o), F.lit(0.0))

    return chain.groupBy(*SNAP).agg(wall("CE").alias("ce_wall_strike"), wall("PE").alias("pe_wall_strike"))


def _is_call() -> Column:
    return F.col("option_type") == "CE"


def with_spot(chain: DataFrame) -> DataFrame:
    """Chain rows with the parity spot of their snapshot and years to expiry."""
    j = chain.join(spot_by_parity(chain).select(*SNAP, "spot"), SNAP)
    return j.withColumn("t", F.datediff("expiry", "snap_date") / 365.0)


def implied_vols(chain: DataFrame, variant: BS.IvVariant, out: str = "iv") -> DataFrame:
    return with_spot(chain).withColumn(out, BS.implied_vol("spot", "strike", "t", BS.RISK_FREE, "ltp", _is_call(), variant))


def greeks(chain: DataFrame) -> DataFrame:
    """IV, delta and daily theta of every chain row."""
    d = implied_vols(chain, BS.GREEKS)
    return d.withColumn("delta", BS.delta("spot", "strike", "t", "iv", _is_call())).withColumn(
        "theta", BS.theta_per_day("spot", "strike", "t", "iv", _is_call()))


def atm_iv_daily(chain: DataFrame, band: float = 0.02) -> DataFrame:
    """Median IV within a band around spot, by side, in percent, with its
    trailing rank and percentile. The strike filter runs before the solver."""
    d = with_spot(near_expiry(chain))
    d = d.where(F.abs(F.col("strike") - F.col("spot")) <= F.col("spot") * band)
    d = d.withColumn("iv", BS.implied_vol("spot", "strike", "t", BS.RISK_FREE, "ltp", _is_call(), BS.HISTORICAL))
    g = d.groupBy(*SNAP).agg(
        (F.coalesce(F.median(_side("CE", "iv")), F.lit(0.0)) * 100).alias("atm_ce_iv"), (F.coalesce(F.median(_side("PE", "iv")), F.lit(0.0)) * 100).alias("atm_pe_iv"))
    g = g.where("atm_ce_iv > 0 or atm_pe_iv > 0").withColumn("atm_iv", F.when(F.col("atm_ce_iv") > 0, F.col("atm_ce_iv")).otherwise(F.col("atm_pe_iv")))
    s = Series(["symbol"], "snap_date")
    return g.withColumns({"iv_rank": s.minmax_rank("atm_iv"), "iv_percentile": s.share_below("atm_iv")})


def iv_skew(chain: DataFrame) -> DataFrame:
    """Median put IV 0-3 % out of the money minus median call IV, in percent."""
    d = with_spot(chain).where("t > 0")
    k, s = F.col("strike"), F.col("spot")
    put = (F.col("option_type") == "PE") & (k >= s * (1 - OTM_RANGE)) & (k < s)
    call = (F.col("option_type") == "CE") & (k > s) & (k <= s * (1 + OTM_RANGE))
    d = d.where(put | call).withColumn("iv", BS.implied_vol("spot", "strike", "t", BS.RISK_FREE, "ltp", _is_call(), BS.SKEW))
    g = d.groupBy(*SNAP).agg(F.median(_side("PE", "iv")).alias("_p"), F.median(_side("CE", "iv")).alias("_c"))
    return g.select(*SNAP, F.coalesce((F.col("_p") - F.col("_c")) * 100, F.lit(0.0)).alias("iv_skew"))


def vol_surface(chain: DataFrame, min_ltp: float = MIN_SURFACE_LTP) -> DataFrame:
    """Surface points with moneyness in range; spot is the parity spot of each expiry."""
    d = greeks(chain).where((F.col("iv") > 0) & (F.col("ltp") >= min_ltp))
    d = d.withColumn("dte", F.datediff("expiry", "snap_date")).withColumn("moneyness", F.col("strike") / F.col("spot"))
    return d.where((F.col("dte") >= 0) & F.col("moneyness").between(*MONEYNESS)).select(
        *SNAP, "dte", "strike", "moneyness", "option_type", "iv", "delta", "ltp", "oi", "spot")


def interpolate_knots(knots: DataFrame, by: list[str], targets=TARGET_DTES) -> DataFrame:
    """Linear interpolation of (dte, iv) knots at fixed targets, flat outside;
    groups with fewer than two knots are dropped. Knots are a handful per day,
    so each target is an aggregate over lower and upper neighbours."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for t in targets:
        lo, hi = F.col("dte") <= t, F.col("dte") >= t
        p = F.struct("dte", "iv")
        aggs += [F.max_by(p, F.when(lo, F.col("dte"))).alias(f"_l{t}"), F.min_by(p, F.when(hi, F.col("dte"))).alias(f"_h{t}"),
                 F.max(flag(lo)).alias(f"_hl{t}"), F.max(flag(hi)).alias(f"_hh{t}")]
    g = knots.groupBy(*by).agg(*aggs).where("_n >= 2")
    out = []
    for t in targets:
        l, h = F.col(f"_l{t}"), F.col(f"_h{t}")
        w = safe_div(F.lit(float(t)) - l["dte"], h["dte"] - l["dte"])
        mid = F.when(l["dte"] == h["dte"], l["iv"]).otherwise(l["iv"] * (1 - w) + h["iv"] * w)
        out.append(F.when(F.col(f"_hl{t}") == 0, h["iv"]).when(F.col(f"_hh{t}") == 0, l["iv"]).otherwise(mid).alias(f"atm_iv_{t}d"))
    return g.select(*by, *out)


def skews(surface: DataFrame, by: list[str]) -> DataFrame:
    """Mean put IV around m minus mean call IV around 2 - m; 0 if a side is empty."""
    def mean_at(side, m):
        band = F.col("moneyness").between(m - SKEW_TOL, m + SKEW_TOL)
        return F.avg(F.when((F.col("option_type") == side) & band, F.col("iv")))

    return surface.groupBy(*by).agg(*[F.coalesce(mean_at("PE", m) - mean_at("CE", 2.0 - m), F.lit(0.0)).alias(n) for n, m in SKEW_LEVELS.items()])


def term_structure(surface: DataFrame) -> DataFrame:
    """At-the-money IV at fixed days to expiry, slope 30 - 7, and skews per day."""
    by = ["symbol", "snap_date"]
    atm = surface.where(F.col("moneyness").between(0.99, 1.01))
    knots = atm.groupBy(*by, "dte").agg(F.avg("iv").alias("iv"))
    t = interpolate_knots(knots, by).withColumn("term_slope", F.col("atm_iv_30d") - F.col("atm_iv_7d"))
    rep = surface.groupBy(*by).agg(F.min_by("spot", "expiry").alias("spot"))
    return t.join(skews(surface, by), by).join(rep, by)


def chain_features(chain: DataFrame) -> DataFrame:
    """Straddle premium, CE/PE ratio, put-call ratio, concentration of the
    three largest open interests, and the at-the-money OI ratio."""
    top3 = lambda side: F.aggregate(
        F.slice(F.sort_array(F.collect_list(_side(side, "oi")), asc=False), 1, 3), F.lit(0).cast("long"), lambda a, x: a + x)
    one = F.lit(1.0)
    g = chain.groupBy(*SNAP).agg(
        F.sum(_side("CE", "oi")).alias("_tc"), F.sum(_side("PE", "oi")).alias("_tp"), top3("CE").alias("_c3"), top3("PE").alias("_p3"))
    atm = atm_min_gap(chain)
    legs = chain.groupBy(*SNAP, F.col("strike").alias("atm_strike")).agg(
        F.max(_side("CE", "ltp")).alias("ce"), F.max(_side("PE", "ltp")).alias("pe"), F.max(_side("CE", "oi")).alias("co"), F.max(_side("PE", "oi")).alias("po"))
    j = atm.join(legs, [*SNAP, "atm_strike"]).join(g, SNAP)
    prem = F.col("ce") + F.col("pe")
    tc, tp = F.coalesce(F.col("_tc").cast("double"), F.lit(0.0)), F.coalesce(F.col("_tp").cast("double"), F.lit(0.0))
    return j.where(prem >= 1).select(
        *SNAP, "atm_strike", prem.alias("straddle_premium"), (prem / F.col("atm_strike") * 100).alias("straddle_pct"),
        (F.col("ce") / F.greatest(F.col("pe"), F.lit(0.01))).alias("ce_pe_ratio"), (tp / F.greatest(tc, one)).alias("pcr_oi"),
        (F.col("_c3") / F.greatest(tc, one)).alias("oi_conc_ce"), (F.col("_p3") / F.greatest(tp, one)).alias("oi_conc_pe"),
        (F.col("co") / F.greatest(F.col("po").cast("double"), one)).alias("atm_oi_ratio"))


def measured_signals(chain: DataFrame, vix: DataFrame) -> DataFrame:
    """Daily signals of the nearest expiry, one row per (symbol, snap_date,
    expiry): put-call ratio, walls, spot, at-the-money IV with its rank, IV
    skew, term slope, surface skew and the volatility index. What a day does
    not show stays NULL; ``chain`` should be stored, it is read by each part."""
    near = near_expiry(chain)
    day = ["symbol", "snap_date"]
    d = put_call_ratio(near).join(oi_walls(near), SNAP, "left").join(spot_by_parity(near).select(*SNAP, "spot"), SNAP, "left")
    d = d.join(atm_iv_daily(chain).select(*SNAP, "atm_iv", "iv_rank", "iv_percentile"), SNAP, "left").join(iv_skew(near), SNAP, "left")
    d = d.join(term_structure(vol_surface(chain)).select(*day, "term_slope", "skew_2pct", "skew_3pct", "atm_iv_30d"), day, "left")
    return d.join(vix.select(F.col("date").alias("snap_date"), "vix"), "snap_date", "left")


def neutral_signals(signals: DataFrame) -> DataFrame:
    """Signals as a decision reads them: an unknown rank is the middle, an unknown skew or slope flat."""
    neutral = {"iv_rank": 50.0, "iv_skew": 0.0, "term_slope": 0.0, "skew_2pct": 0.0}
    return signals.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in neutral.items()})


def strike_gaps(chain: DataFrame, by: list[str]) -> DataFrame:
    k = chain.select(*by, "strike").distinct()
    gap = F.col("strike") - F.lag("strike").over(W.partitionBy(*by).orderBy("strike"))
    return k.select(*by, gap.alias("gap")).where("gap > 0")


def strike_step(chain: DataFrame, default: float = 50.0, min_oi: int = 1000) -> DataFrame:
    """Modal gap of liquid call strikes per (symbol, expiry); the default when
    fewer than three rows are liquid."""
    by = ["symbol", "expiry"]
    liquid = chain.where((F.col("option_type") == "CE") & (F.col("oi") > min_oi))
    n = liquid.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    keys = chain.select(*by).distinct()
    j = keys.join(n, by, "left").join(mode_of(strike_gaps(liquid, by), by, "gap", "_step"), by, "left")
    return j.select(*by, F.when(F.col("_n") >= 3, F.coalesce("_step", F.lit(default))).otherwise(default).alias("strike_step"))


def suggestions(summary: DataFrame, regime: DataFrame, iv_rank: DataFrame, step: float = 50.0) -> DataFrame:
    """Daily strike suggestion: contrarian on extreme put-call ratios, else
    with the regime trend; the structure depends on the IV rank."""
    j = summary.join(regime.select(F.col("date").alias("snap_date"), "trend"), "snap_date", "left").join(iv_rank, ["symbol", "snap_date"], "left")
    p = F.col("pcr")
    bias = F.when(p > 1.3, "bullish").when(p < 0.7, "bearish").when(F.col("trend") == "up", "bullish").when(F.col("trend") == "down", "bearish").otherwise("neutral")
    atm = round_half_even(F.col("spot") / step) * step
    rich, bull = F.coalesce(F.col("iv_rank"), F.lit(0.0)) > 60, F.col("bias") == "bullish"
    j = j.withColumn("bias", bias).where("bias <> 'neutral'").withColumn("_atm", atm)
    return j.select(
        "symbol", "snap_date", "bias",
        F.when(bull & rich, "bull_put_spread").when(bull, "buy_call").when(rich, "bear_call_spread").otherwise("buy_put").alias("strategy"),
        F.when(bull & ~rich, F.col("_atm")).when(~bull & rich, F.col("_atm") + step).otherwise(0.0).alias("rec_call"),
        F.when(bull & rich, F.col("_atm") - step).when(~bull & ~rich, F.col("_atm")).otherwise(0.0).alias("rec_put"))


def bias_by_day(summary: DataFrame, vix: DataFrame) -> DataFrame:
    """PCR / volatility / volatility-rank bias of every summary row."""
    w = Series(["_k"], "date")
    v = vix.withColumn("_k", F.lit(0)).select("date", "vix", F.coalesce(w.pct_rank("vix"), F.lit(0.0)).alias("vix_rank"))
    j = summary.join(v.withColumnRenamed("date", "snap_date"), "snap_date")
    return j.withColumn("bias", directional_bias("pcr", "vix", "vix_rank"))
