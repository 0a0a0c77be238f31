"""Bitemporal reads, edge reports and recommendations on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators.dedup import as_known
from tidebook.plans import backtests as B
from tidebook.plans import options as O
from tidebook.plans import scoring as SC
from tidebook.plans import spreads as SP

D = dt.date
CHAIN = "symbol long, snap_date date, expiry date, strike double, option_type string, ltp double, oi long"


def test_as_known_reads_each_day_its_own_version(spark):
    random.seed(3)
    rows = [(k, random.randrange(4), random.randrange(20), random.randrange(100)) for k in range(3) for _ in range(30)]
    versions = spark.createDataFrame(rows, "k int, item int, known int, v int")
    reads = spark.createDataFrame([(k, at) for k in range(4) for at in (-1, 5, 19)], "k int, at int")
    got = {(r.k, r["at"], r.item): (r.known, r.v) for r in as_known(reads, versions, ["k"], ["item"], "known", "at").collect()}
    want = {}
    for k, item, known, v in rows:
        for at in (-1, 5, 19):
            if known <= at:
                want[k, at, item] = max(want.get((k, at, item), (-1, -1)), (known, v))
    assert got == want


def test_visible_chain_keeps_corrections_out_until_they_are_known(spark):
    e1, e2 = D(2025, 1, 9), D(2025, 1, 16)
    rows = [
        (0, D(2025, 1, 6), e1, 100.0, "CE", 1.0, 10, D(2025, 1, 6)), (0, D(2025, 1, 6), e1, 100.0, "CE", 2.0, 20, D(2025, 1, 8)),
        (0, D(2025, 1, 6), e2, 100.0, "CE", 5.0, 50, D(2025, 1, 6)), (0, D(2025, 1, 13), e2, 100.0, "CE", 7.0, 70, D(2025, 1, 20)),
    ]
    versions = spark.createDataFrame(rows, CHAIN + ", known_at date")
    days = spark.createDataFrame([(0, D(2025, 1, d)) for d in (5, 7, 8, 9, 16, 20)], "symbol long, as_of date")
    got = {r.as_of.day: (r.snap_date, r.expiry, r.ltp) for r in SC.visible_chain(days, versions).collect()}
    # Before any row nothing; on an expiry's own day the next one; after the last expiry nothing.
    assert got == {7: (D(2025, 1, 6), e1, 1.0), 8: (D(2025, 1, 6), e1, 2.0), 9: (D(2025, 1, 6), e2, 5.0)}


def edge_rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        profit = rng.choice([-30.0, -5.0, 10.0, 25.0])
        out.append((i % 2, D(2025, 1, 6) + dt.timedelta(days=rng.randrange(7)), profit, int(profit > 0), rng.choice([0.0, 20.0, 50.0, 79.9, 80.0]), rng.choice([11.0, 12.0, 18.0, 26.0]),
                    rng.choice([0.5, 0.7, 1.2, 2.0]), rng.choice([0.0, -0.03, 0.01, 0.05]), rng.choice([0.0, -0.01, 0.015]), rng.choice([None, 0.5, 0.6, 3.0]), rng.choice([0, 1]), rng.choice([0, 1])))
    return out


EDGE = "symbol long, expiry date, profit_1dte_pts double, win_1dte int, iv_rank double, atm_iv double, pcr double, term_slope double, skew_2pct double, range_vs_atr double, inside_bar int, above_ma20 int"


def test_edge_report_equals_a_loop_over_rows(spark):
    rows = edge_rows(120)
    df = spark.createDataFrame(rows, EDGE)
    got = {(r.symbol, r.dimension, r.bucket): (r.n, r.win_rate, r.expectancy, r.avg_profit) for r in B.edge_report(df, ["symbol"]).collect()}
    names = [c.split()[0] for c in EDGE.split(", ")]
    groups = {}
    for row in rows:
        r = dict(zip(names, row, strict=True))
        labels = {n: next((x for e, x in zip(edges, text, strict=False) if r[n] < e), text[-1]) for n, (edges, text) in B.EDGE_BUCKETS.items() if r[n] is not None}
        if not r["term_slope"]:
            labels.pop("term_slope")
        if not r["term_slope"] or not r["skew_2pct"]:
            labels.pop("skew_2pct")
        labels["inside_bar"] = "inside" if r["inside_bar"] else "not inside"
        labels["above_ma20"] = "above" if r["above_ma20"] else "below"
        labels["conditions"] = "trade" if 20 <= r["iv_rank"] <= 70 and 12 <= r["atm_iv"] <= 22 and 0.7 <= r["pcr"] <= 1.3 else "skip"
        if r["expiry"].weekday() < 5:
            labels["weekday"] = r["expiry"].strftime("%A")
        for dim, label in labels.items():
            groups.setdefault((r["symbol"], dim, label), []).append((r["profit_1dte_pts"], r["win_1dte"]))
    mean = lambda x: sum(x) / len(x) if x else 0.0
    want = {}
    for key, g in groups.items():
        if len(g) >= (1 if key[1] == "conditions" else 3):
            wr = mean([w for _, w in g])
            want[key] = (len(g), wr * 100, wr * mean([p for p, w in g if w]) + (1 - wr) * mean([p for p, w in g if not w]), mean([p for p, _ in g]))
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def test_edge_report_small_sections_and_empty_table(spark):
    rows = [(0, D(2025, 1, 6), 5.0, 1, 50.0, 15.0, 1.0, 0.01, 0.015, None, None, None)] * 4
    dims = {r.dimension for r in B.edge_report(spark.createDataFrame(rows, EDGE)).collect()}
    assert dims == {"iv_rank", "atm_iv", "pcr", "weekday", "conditions"}  # four rows are too few for the surface, none has price action
    assert B.edge_report(spark.createDataFrame([], EDGE), ["symbol"]).count() == 0


def test_measured_signals_leave_unknown_values_open(spark):
    day = D(2025, 5, 5)
    rows = [(0, day, D(2025, 5, 8), float(k), o, p, oi) for k, o, p, oi in ((100, "CE", 3.0, 10), (100, "PE", 2.0, 30), (105, "CE", 1.0, 5), (105, "PE", 5.0, 5))]
    s = O.measured_signals(spark.createDataFrame(rows, CHAIN), spark.createDataFrame([(day, 15.0)], "date date, vix double"))
    r = s.first()
    assert (r.pcr, r.ce_wall_strike, r.pe_wall_strike, r.spot, r.vix) == (pytest.approx(35 / 15), 100.0, 100.0, 101.0, 15.0)
    assert r.term_slope is None and r.skew_2pct is None  # one expiry has no term structure
    n = O.neutral_signals(s).first()
    assert (n.term_slope, n.skew_2pct) == (0.0, 0.0)


def test_track_record_counts_only_closed_trades(spark):
    t = spark.createDataFrame([(0, D(2025, 1, 6), "a", 1, 10.0), (0, D(2025, 1, 6), "a", 0, -4.0), (0, D(2025, 1, 13), "a", 1, 20.0), (0, D(2025, 1, 13), "b", 0, -1.0)],
                              "symbol long, exit_date date, strategy string, target int, pnl_pts double")
    got = {(r.strategy_type, r.score_date.day): (round(r.confidence, 3), r.avg_win) for r in SP.track_record(t, 50).collect()}
    assert got == {("a", 6): (50.0, 500.0), ("a", 13): (66.667, 750.0), ("b", 13): (0.0, 750.0)}


def test_recommendation_takes_the_newest_priced_snapshot(spark):
    mon, wed, exp = D(2025, 5, 5), D(2025, 5, 7), D(2025, 5, 15)
    chain = [(0, mon, exp, 100.0 + 50 * i, o, 20.0 - 4 * abs(i) + (o == "PE") * abs(i), 1000) for i in range(-3, 4) for o in ("CE", "PE")]
    chain += [(0, wed, exp, 100.0 + 50 * i, o, 0.05, 1000) for i in range(-3, 4) for o in ("CE", "PE")]  # at the floor: not a price
    chain = spark.createDataFrame(chain, CHAIN)
    days = spark.createDataFrame([(0, D(2025, 5, 8), exp), (0, D(2025, 5, 2), exp), (0, D(2025, 5, 16), exp)], "symbol long, rec_date date, expiry date")
    scores = spark.createDataFrame([(0, D(2025, 5, 6), "bull_put", 90.0, None)], "symbol long, score_date date, strategy_type string, confidence double, avg_win double")
    optimal = spark.createDataFrame([(0, "bull_put", 1, 1, 20, 0.5, 50.0)], "symbol long, strategy string, short_n int, wing_m int, n_trades long, sharpe_pct double, avg_max_loss double")
    signals = spark.createDataFrame([(0, mon, exp, 15.0, 80.0, 1.5, 3.0, 0.0, 0.0, 0.0, 0.0), (0, wed, exp, 15.0, 80.0, 1.5, 3.0, 0.0, 0.0, 0.0, 0.0)],
                                    "symbol long, snap_date date, expiry date, vix double, iv_rank double, pcr double, iv_skew double, term_slope double, skew_2pct double, ce_wall_strike double, pe_wall_strike double")
    rows = SP.recommend(days, scores, chain, signals, optimal, 1e6, 50).collect()
    assert [(r.rec_date, r.snap_date, r.strategy, r.short_pe_strike, r.long_pe_strike) for r in rows] == [(D(2025, 5, 8), mon, "bull_put", 50.0, 0.0)]
    guarded = SP.recommend(days, scores, chain, signals.withColumn("pe_wall_strike", F.lit(40.0)), optimal, 1e6, 50)
    assert guarded.count() == 0  # the short put lies above the wall
