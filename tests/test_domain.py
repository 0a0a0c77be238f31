"""Domain invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.functions import blackscholes as BS
from tidebook.functions import market as M
from tidebook.functions.rules import compile_rule
from tidebook.functions.text import fund_house, missing_features, relevant_scheme, scheme_category
from tidebook.plans import feedback as FB
from tidebook.plans import funds as FU
from tidebook.plans import options as O
from tidebook.plans import spreads as SP

D = dt.date


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_normal_cdf_close_to_erf(spark):
    xs = [-6.0, -1.3, -0.2, 0.0, 0.4, 2.5, 7.0]
    got = [r.c for r in spark.createDataFrame([(x,) for x in xs], "x double").select(BS.norm_cdf("x").alias("c")).collect()]
    np.testing.assert_allclose(got, [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], atol=1e-7)


def test_put_call_parity_and_iv_round_trip(spark):
    s, k, t, r, sig = (F.lit(float(x)) for x in (100, 100, 30 / 365, 0.065, 0.2))
    c, p = BS.price(s, k, t, r, sig, F.lit(True)), BS.price(s, k, t, r, sig, F.lit(False))
    assert one(spark, c - p) == pytest.approx(100 - 100 * math.exp(-0.065 * 30 / 365), abs=1e-3)
    for v in (BS.GREEKS, BS.HISTORICAL, BS.SKEW, BS.LIVE):
        for call in (True, False):
            ltp = BS.price(s, k, t, r, sig, F.lit(call))
            assert one(spark, BS.implied_vol(s, k, t, 0.065, ltp, F.lit(call), v)) == pytest.approx(0.2, abs=2e-3)


def test_iv_unsolved_values_differ_by_variant(spark):
    args = (F.lit(100.0), F.lit(100.0), F.lit(0.0), 0.065, F.lit(5.0), F.lit(True))
    assert one(spark, BS.implied_vol(*args, BS.GREEKS)) == 0.0
    assert one(spark, BS.implied_vol(*args, BS.HISTORICAL)) is None
    assert one(spark, BS.implied_vol(*args, BS.LIVE)) == 0.15


def test_term_interpolation_exact_mid_and_flat(spark):
    df = spark.createDataFrame([("n", 7, 0.15), ("n", 30, 0.18), ("n", 90, 0.20), ("one", 7, 0.3)], "k string, dte int, iv double")
    r = O.interpolate_knots(df, ["k"], targets=(1, 7, 60, 120)).collect()
    assert len(r) == 1  # a single knot gives no row
    assert [r[0][f"atm_iv_{t}d"] for t in (1, 7, 60, 120)] == pytest.approx([0.15, 0.15, 0.19, 0.20])


def chain(spark, rows):
    return spark.createDataFrame([(0, d, D(2025, 5, 8), float(k), o, float(p), int(oi)) for d, k, o, p, oi in rows],
                                 "symbol long, snap_date date, expiry date, strike double, option_type string, ltp double, oi long")


def test_max_pain_is_first_minimum(spark):
    d = D(2025, 5, 1)
    c = chain(spark, [(d, 100, "CE", 5, 10), (d, 110, "CE", 3, 50), (d, 100, "PE", 3, 40), (d, 110, "PE", 6, 10)])
    # Payout at 100: puts at 110 owe 10*10; at 110: calls at 100 owe 10*10. A tie takes the lower strike.
    assert O.max_pain(c).first().max_pain_strike == 100.0


def test_spread_credit_max_loss_and_floor(spark):
    d1, d2 = D(2025, 5, 6), D(2025, 5, 7)
    rows = []
    for k in range(23700, 24350, 50):
        for o in ("CE", "PE"):
            gap = (k - 24000) if o == "CE" else (24000 - k)
            rows += [(d1, k, o, max(1, 100 - gap / 4), 5000), (d2, k, o, max(1, 900 - gap), 5000)]
    t = SP.price_spreads(chain(spark, rows)).where("strategy = 'bear_call' and short_n = 1 and wing_m = 2").first()
    assert t.net_credit == pytest.approx(25.0) and t.max_loss == pytest.approx(75.0)
    assert t.exit_cost == pytest.approx(100.0) and t.pnl_pts == pytest.approx(-75.0)


def test_sip_is_positive_and_constant_within_a_month(spark):
    rows, nav, day = [], 100.0, D(2020, 1, 1)
    while day < D(2023, 1, 1):
        if day.weekday() < 5:
            rows.append((1, day, nav))
            nav *= 1.0003
        day += dt.timedelta(days=1)
    df = spark.createDataFrame(rows, "scheme_code long, date date, nav double")
    g = FU.sip_returns(df).groupBy(F.trunc("date", "MM").alias("m")).agg(F.count_distinct("sip_return_1y").alias("n"), F.max("sip_return_1y").alias("v")).orderBy("m").collect()
    assert all(r.n == 1 for r in g) and all(r.v >= 0 for r in g)
    assert g[-1].v == pytest.approx((1.0003**261 - 1) * 100, rel=0.05)


def test_graduation_thresholds_are_inclusive(spark):
    bt = spark.createDataFrame([("s", 50, 0.55, 0.10, 2.0)], "k string, bt_oos_trades long, bt_win_rate double, bt_sharpe double, bt_years double")
    paper = spark.createDataFrame([("s", 30, 0.50, 1.0)], "k string, paper_trades long, paper_win_rate double, paper_net_pnl double")
    micro = spark.createDataFrame([("s", 19, 0.5, 1.0)], "k string, micro_trades long, micro_win_rate double, micro_net_pnl double")
    r = FB.graduation(bt, paper, micro, "k").first()
    assert (r.stage, r.stage_label) == (3, "MICRO_LIVE")


def test_attribution_with_flat_winners_is_capped(spark):
    cols = "trade_id long, features_json string"
    win = spark.createDataFrame([(i, '{"a": 5.0}') for i in range(5)], cols)
    loss = spark.createDataFrame([(9, '{"a": 7.0, "b": 1.0}'), (10, "not json")], cols)
    r = FB.loss_attribution(loss, win).collect()
    assert len(r) == 1 and r[0].attribution == 10.0
    assert FB.loss_attribution(loss, win.limit(4)).count() == 0


def test_rule_operators_first_one_wins(spark):
    df = spark.createDataFrame([(5.0,)], "x double")
    cases = [({"x": {"lt": 6}}, True), ({"x": {"between": [5, 6]}}, True), ({"x": {"in": [1, 2]}}, False), ({"x": {"near": 5}}, False),
             ({"y": {"lt": 6}}, False), ({"x": {"gt": 4, "lt": 1}}, False), ({"x": {"gte": 5}, "z": {"lt": 0}}, False)]
    assert [df.select(compile_rule(r, df.columns).alias("m")).first().m for r, _ in cases] == [w for _, w in cases]


def test_regime_bounds_and_opportunity(spark):
    got = [one(spark, M.vix_regime(F.lit(v))) for v in (0.0, 12.9, 13.0, 18.0, 18.1, 25.0, 25.1)]
    assert got == ["", "low", "normal", "normal", "elevated", "elevated", "extreme"]
    assert one(spark, M.opportunity_score(F.lit("low"), F.lit("up"))) == 85


def test_scorecard_tests_the_severe_band_first(spark):
    card = lambda v: one(spark, M.scorecard(F.lit(50.0), F.lit(v), F.lit(50.0), F.lit(1.0), F.lit(1.2), F.lit(0)))
    assert card(30.0) == pytest.approx(0.34) and card(24.0) == pytest.approx(0.42)


def test_names(spark):
    n = F.lit("ICICI Prudential Balanced Advantage Fund - Direct Growth")
    assert one(spark, fund_house(n)) == "ICICI Prudential"
    assert one(spark, scheme_category(n)) == "Balanced Advantage"
    assert one(spark, relevant_scheme(n)) is True
    assert one(spark, fund_house(F.lit("Acme Capital Growth (IDCW) - Regular"))) == "Acme Capital"
    assert one(spark, missing_features(F.lit('{"a": 0, "b": 2}'), ["a", "b", "c"])) == ["a", "c"]
    assert one(spark, missing_features(F.lit("oops"), ["a"])) == ["a"]
