"""Market labels, scores and cost formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.exprs import bucket_label, clip, col, round_at, safe_div

# Volatility bands (upper bound inclusive) and base scores.
VIX_BANDS = ((13.0, "low"), (18.0, "normal"), (25.0, "elevated"))
REGIME_BASE = {"low": 75, "normal": 60, "elevated": 40, "extreme": 25}

# Cost model.
BROKERAGE = 20.0
GST_RATE = 0.18
STT_PCT = 0.0005
EXCHANGE_PCT = 0.0005

# Structure choice and trade score.
PCR_BULLISH, PCR_BEARISH = 1.2, 0.8
IV_SKEW_THRESH = 2.0
SURFACE_SKEW_THRESH = 0.02
VIX_MIN, VIX_MAX = 11.0, 28.0
VIX_SWEET_LO, VIX_SWEET_HI = 14.0, 22.0
W_CONFIDENCE, W_VIX, W_IV_RANK, W_ALIGNMENT = 40.0, 20.0, 20.0, 20.0
TERM_BONUS_LO, TERM_BONUS_HI, TERM_BONUS = -0.04, -0.01, 3.0
SCORE_THRESHOLD = 65.0


def vix_regime(vix: str | Column) -> Column:
    """low < 13 <= normal <= 18 < elevated <= 25 < extreme; '' when absent."""
    v = col(vix)
    return (
        F.when(v.isNull() | (v <= 0), "")
        .when(v < 13, "low").when(v <= 18, "normal").when(v <= 25, "elevated").otherwise("extreme")
    )


def opportunity_score(regime: str | Column, trend: str | Column) -> Column:
    base = F.lit(None).cast("int")
    for name, score in REGIME_BASE.items():
        base = F.when(col(regime) == name, score).otherwise(base)
    step = F.when(col(trend) == "up", 10).when(col(trend) == "down", -10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + step))


def round_trip_cost(entry: str | Column, exit_: str | Column, side: str, lot: str | Column) -> Column:
    """Cost per unit of one round trip; tax falls on the sell leg."""
    brokerage = F.lit(BROKERAGE * 2 * (1 + GST_RATE))
    exchange = (col(entry) + col(exit_)) * EXCHANGE_PCT
    taxed = col(exit_) if side == "buy" else col(entry)
    return round_at((brokerage + exchange + taxed * STT_PCT) / col(lot), 4)


def itemised_cost(premium: Column, wing: Column, lot: Column, lots: Column, fly: Column) -> dict[str, Column]:
    """Brokerage, tax, exchange fee and total of a whole position."""
    orders = F.when(fly, 8).otherwise(4)
    brok = round_at(orders * BROKERAGE * (1 + GST_RATE), 2)
    stt = round_at(premium * STT_PCT * lot * lots * 2, 2)
    exch = round_at((premium + wing) * lot * lots * EXCHANGE_PCT * 2, 2)
    return {"brok": brok, "stt": stt, "exch": exch, "total_cost": round_at(brok + stt + exch, 2)}


def margin_estimate(ce_iv: Column, pe_iv: Column, spot: Column, lot: Column, straddle_pct: Column, iv_scale: float = 1.0) -> Column:
    """Daily-move margin from the mean at-the-money IV, else from the premium."""
    iv = (F.coalesce(ce_iv, F.lit(0.0)) + F.coalesce(pe_iv, F.lit(0.0))) / 2 * iv_scale
    by_iv = iv * spot * (1 / 252) ** 0.5 * lot * 3.0
    by_premium = straddle_pct / 100 * spot * lot * 2 * 0.30
    return F.when((iv > 0) & (spot > 0), by_iv).when((straddle_pct > 0) & (spot > 0), by_premium).otherwise(0.0)


def annualised_return(entry: str | Column, exit_: str | Column, ret_pct: str | Column) -> Column:
    """Annualised trade return with a 7-day floor, capped to [-1, 10]."""
    years = F.greatest(F.datediff(col(exit_), col(entry)), F.lit(7)) / 365.25
    growth = 1 + col(ret_pct) / 100
    return F.when(growth <= 0, -1.0).otherwise(clip(F.pow(growth, 1 / years) - 1, -1.0, 10.0))


def directional_bias(pcr: str | Column, vix: str | Column, vix_rank: str | Column, hi=1.3, lo=0.7) -> Column:
    p, v, r = col(pcr), col(vix), col(vix_rank)
    return (
        F.when(p > hi, "bullish").when(p < lo, "bearish")
        .when((v < 18) & (r < 50), "bullish").when(v > 22, "bearish").otherwise("neutral")
    )


def _skew_flags(pcr, skew):
    p, s = col(pcr), col(skew)
    return p > PCR_BULLISH, p < PCR_BEARISH, s > IV_SKEW_THRESH, s < -IV_SKEW_THRESH


def pick_structure(pcr: str | Column, skew: str | Column, surface_skew: str | Column) -> Column:
    bull, bear, skew_bull, skew_bear = _skew_flags(pcr, skew)
    return (
        F.when(bull & ~skew_bear, "bull_put").when(bear & ~skew_bull, "bear_call")
        .when((col(surface_skew) > SURFACE_SKEW_THRESH) & ~skew_bear, "bull_put").otherwise("iron_condor")
    )


def trade_score(confidence, vix, iv_rank, pcr, skew, term_slope) -> dict[str, Column]:
    """Score components (weights 40/20/20/20, plus a term-structure bonus)."""
    bull, bear, skew_bull, skew_bear = _skew_flags(pcr, skew)
    v = col(vix)
    s_conf = F.least(col(confidence), F.lit(100.0)) / 100 * W_CONFIDENCE
    s_vix = (
        F.when(v.isNull(), W_VIX * 0.5).when(v.between(VIX_SWEET_LO, VIX_SWEET_HI), W_VIX)
        .when(v.between(VIX_MIN, VIX_MAX), W_VIX * 0.5).otherwise(0.0)
    )
    s_iv = F.least(col(iv_rank), F.lit(100.0)) / 100 * W_IV_RANK
    agree = (bull & skew_bull) | (bear & skew_bear)
    s_align = F.when(agree, W_ALIGNMENT).when(bull | bear, W_ALIGNMENT * 0.5).otherwise(0.0)
    s_term = F.when(col(term_slope).between(TERM_BONUS_LO, TERM_BONUS_HI), TERM_BONUS).otherwise(0.0)
    return {
        "s_confidence": s_conf, "s_vix": s_vix, "s_iv_rank": s_iv, "s_alignment": s_align, "s_term_slope": s_term,
        "score": s_conf + s_vix + s_iv + s_align + s_term,
    }


def scorecard(iv_rank, vix, atr_pctile, hv_ratio, iv_hv, event_flag) -> Column:
    """Rule scorecard: 50 plus signed points, over 100, clipped to [0, 1].
    The most severe volatility band is tested first so it can apply."""
    r, v, a, h, i = (col(c) for c in (iv_rank, vix, atr_pctile, hv_ratio, iv_hv))
    s = F.lit(50.0)
    s = s + F.when(r > 70, 12).when(r > 50, 6).when(r < 25, -8).otherwise(0)
    s = s + F.when(v <= 0, 0).when(v < 13, 10).when(v < 17, 4).when(v > 28, -16).when(v > 22, -8).otherwise(0)
    s = s + F.when(a < 30, 8).when(a > 70, -8).otherwise(0)
    s = s + F.when(h > 1.3, -10).when(h < 0.8, 6).otherwise(0)
    s = s + F.when(i <= 0, 0).when(i > 1.5, 8).when(i < 0.8, -6).otherwise(0)
    s = s + F.when(col(event_flag) == 1, 4).otherwise(0)
    return clip(s / 100.0, 0.0, 1.0)


def verdict(confidence: str | Column) -> Column:
    return bucket_label(confidence, [50, 60, 75], ["SKIP", "BORDERLINE", "BUY", "STRONG BUY"])


def position_lots(capital, max_loss, lot, iv_rank, avg_win, risk_pct: float = 0.02) -> Column:
    """Lots from a risk budget, scaled by IV rank, capped by the average win."""
    cap, ml, lt, rank, win = (col(c).cast("double") for c in (capital, max_loss, lot, iv_rank, avg_win))
    base = F.when(ml > 0, F.floor(cap * risk_pct / (ml * lt))).otherwise(F.lit(1))
    lots = F.greatest(F.lit(1), F.floor(base * (0.5 + rank / 100.0)))
    limit = F.when((win > 0) & (ml > 0), F.greatest(F.lit(1), F.floor(win / (ml * lt))))
    return F.least(lots, limit).cast("int")


def trend_arrow(m1: str | Column, m3: str | Column) -> Column:
    d = F.coalesce(col(m1), F.lit(0.0)) - F.coalesce(col(m3) / 3, F.lit(0.0))
    return F.when(d > 1.0, "up").when(d > 0.3, "rising").when(d > -0.3, "flat").when(d > -1.0, "falling").otherwise("down")


def age_label(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
    )


def size_label(n: Column) -> Column:
    v = n.cast("double")
    out = F.format_string("%.1f TiB", v / 1024.0**4)
    for p, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out = F.when(v < 1024.0 ** (p + 1), F.format_string(f"%.1f {unit}", v / 1024.0**p)).otherwise(out)
    return F.when(v < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


__all__ = [n for n in dir() if not n.startswith("_")] + ["safe_div"]
