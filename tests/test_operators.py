"""Operators against brute force on small frames, including hot keys."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators import asof, dedup, recursive, running, stats
from tidebook.operators.calendar import calendar, trading_days_between
from tidebook.schemas import conform

D0 = dt.date(2024, 1, 1)


def days(n):
    return D0 + dt.timedelta(days=n)


def test_latest_version_takes_highest_version_and_tiebreak(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 2, 2.0, 1), ("a", 2, 3.0, 2), ("b", 1, 9.0, 1)], "k string, v int, x double, t int")
    got = {r.k: r.x for r in dedup.latest_version(df, ["k"], "v", ["t"]).collect()}
    assert got == {"a": 3.0, "b": 9.0}


def test_upsert_changes_only_hit_rows(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, v long, x double")
    upd = spark.createDataFrame([("a", 5.0), ("c", 7.0)], "k string, x double")
    got = sorted(tuple(r) for r in dedup.upsert_columns(base, upd, ["k"], "v", F.lit(9)).collect())
    assert got == [("a", 9, 5.0), ("b", 1, 2.0)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_matches_brute_force_with_a_hot_key(spark, direction, exact):
    rnd = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b"]
    left = [(rnd.choice(keys), days(rnd.randrange(400)), i) for i in range(300)]
    right = [(rnd.choice(keys), days(rnd.randrange(400)), float(i)) for i in range(60)]
    best = {}
    for k, d, v in right:
        best[(k, d)] = max(best.get((k, d), -1.0), v)
    want = {}
    for k, d, i in left:
        ok = [x for (kk, x) in best if kk == k and ((x <= d) if direction == "backward" else (x >= d)) and (exact or x != d)]
        pick = (max(ok) if direction == "backward" else min(ok)) if ok else None
        want[i] = None if pick is None else best[(k, pick)]
    lf = spark.createDataFrame(left, "k string, d date, i int")
    rf = spark.createDataFrame(right, "k string, e date, v double")
    got = {r.i: r.v for r in asof.asof_join(lf, rf, ["k"], "d", "e", ["v"], direction=direction, allow_exact=exact).collect()}
    assert got == want


def test_asof_tolerance(spark):
    lf = spark.createDataFrame([("a", days(10)), ("a", days(3))], "k string, d date")
    rf = spark.createDataFrame([("a", days(1), 5.0)], "k string, e date, v double")
    got = {r.d: r.v for r in asof.asof_join(lf, rf, ["k"], "d", "e", ["v"], tolerance_days=7).collect()}
    assert got == {days(10): None, days(3): 5.0}


@pytest.fixture(scope="module")
def trades(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.7 else "cold", i, i // 40, round(rnd.uniform(-5, 5), 1), rnd.randrange(2)) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "k string, i int, s int, v double, y int")


def test_equity_curve_matches_pandas(trades):
    rows, df = trades
    got = running.equity_curve(df, ["k"], ["i"], "s", "v").toPandas().sort_values(["k", "i"])
    p = pd.DataFrame(rows, columns=["k", "i", "s", "v", "y"]).sort_values(["k", "i"])
    cum = p.groupby("k")["v"].cumsum()
    np.testing.assert_allclose(got["cum"], cum, atol=1e-9)
    np.testing.assert_allclose(got["peak"], cum.groupby(p["k"]).cummax(), atol=1e-9)


def test_streaks_match_a_row_walk(trades):
    rows, df = trades
    want = {}
    for k in ("hot", "cold"):
        flags = [1 if r[3] > 0 else 0 for r in rows if r[0] == k]
        best = cur = 0
        for f in flags:
            cur = cur + 1 if f == 0 else 0
            best = max(best, cur)
        tail = 1
        while tail < len(flags) and flags[-tail - 1] == flags[-1]:
            tail += 1
        want[k] = (best, "W" if flags[-1] else "L", tail)
    d = df.withColumn("w", F.when(F.col("v") > 0, 1).otherwise(0))
    a = {r.k: r.n for r in running.longest_run(d, ["k"], ["i"], "s", F.col("w") == 0, "n").collect()}
    b = {r.k: (r.streak_type, r.streak) for r in running.current_streak(d, ["k"], ["i"], "w").collect()}
    assert {k: (a[k], *b[k]) for k in a} == want


def test_exact_quantiles_match_numpy(trades):
    rows, df = trades
    got = {r.k: (r.a, r.b) for r in running.exact_quantiles(df, ["k"], "v", {"a": 0.33, "b": 0.9}, cuts=16).collect()}
    for k, (a, b) in got.items():
        x = [r[3] for r in rows if r[0] == k]
        assert a == pytest.approx(np.quantile(x, 0.33)) and b == pytest.approx(np.quantile(x, 0.9))


def test_rank_auc_matches_pair_count(trades):
    rows, df = trades
    got = {r.k: r.auc for r in running.average_rank_auc(df.withColumn("p", (F.col("v") + 5) / 10), ["k"], "p", "y", resolution=8).collect()}
    for k, auc in got.items():
        pos = np.array([r[3] for r in rows if r[0] == k and r[4] == 1])
        neg = np.array([r[3] for r in rows if r[0] == k and r[4] == 0])
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert auc == pytest.approx(want)


def test_ewm_matches_pandas_across_blocks(spark):
    rnd = np.random.default_rng(1)
    x = 100 + rnd.normal(size=2500).cumsum()
    pdf = pd.DataFrame({"k": "a", "d": range(2500), "x": x})
    df = spark.createDataFrame(pdf)
    got = recursive.ewm_mean(df, ["k"], "d", {"w": ("x", 1 / 14, 14), "e": ("x", 2 / 51, 50)}).toPandas().sort_values("d")
    np.testing.assert_allclose(got["w"].to_numpy()[13:], pdf["x"].ewm(alpha=1 / 14, adjust=False, min_periods=14).mean().to_numpy()[13:], rtol=1e-10)
    np.testing.assert_allclose(got["e"].to_numpy()[49:], pdf["x"].ewm(span=50, adjust=False, min_periods=50).mean().to_numpy()[49:], rtol=1e-10)
    assert got["w"].isna().sum() == 13


def test_rsi_without_losses_is_zero_by_default(spark):
    df = spark.createDataFrame([("a", i, 100.0 + i) for i in range(30)], "k string, d int, x double")
    for mode, want in (("ref", 0.0), ("standard", 100.0)):
        last = recursive.rsi(df, ["k"], "d", "x", [14], mode).orderBy(F.desc("d")).first()
        assert last.rsi_14 == want


def test_ewm_takes_decays_far_apart_in_one_call(spark):
    pdf = pd.DataFrame({"k": "a", "d": range(600), "x": np.random.default_rng(2).normal(size=600).cumsum()})
    got = recursive.ewm_mean(spark.createDataFrame(pdf), ["k"], "d", {"slow": ("x", 0.01, 1), "fast": ("x", 0.5, 1)}).toPandas().sort_values("d")
    for name, alpha in (("slow", 0.01), ("fast", 0.5)):
        np.testing.assert_allclose(got[name], pdf["x"].ewm(alpha=alpha, adjust=False).mean(), rtol=1e-9, atol=1e-9)


def test_adx_and_rsi_match_pandas_from_the_first_move(spark):
    step = np.random.default_rng(5).normal(size=(80, 3))
    step[:3] = 0  # a flat start has no direction
    close = 100 + step[:, 0].cumsum()
    pdf = pd.DataFrame({"k": "a", "d": range(80), "high": close + np.abs(step[:, 1]), "low": close - np.abs(step[:, 2]), "close": close})
    got = recursive.rsi(recursive.adx(spark.createDataFrame(pdf), ["k"], "d"), ["k"], "d", "close", [14], "missing").toPandas().sort_values("d")

    def smooth(x):
        return x.ewm(alpha=1 / 14, adjust=False).mean()

    up, down, move = pdf["high"].diff(), -pdf["low"].diff(), pdf["close"].diff()
    plus, minus = smooth(up.where((up > down) & (up > 0), 0.0)), smooth(down.where((down > up) & (down > 0), 0.0))
    want = smooth(100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan))
    np.testing.assert_allclose(got["adx14"].to_numpy(float), want, rtol=1e-9)
    assert got["adx14"].isna().sum() == want.isna().sum() > 0
    gain, loss = smooth(move.clip(lower=0)), smooth((-move).clip(lower=0)).replace(0, np.nan)
    np.testing.assert_allclose(got["rsi_14"].to_numpy(float), 100 - 100 / (1 + gain / loss), rtol=1e-9)


def test_bar_order_is_exact_beyond_double_precision(spark, tmp_path):
    from tidebook.sources.adapters import Tables

    day = dt.datetime(2024, 1, 2)
    rows = [(9_100_000_000 + i, 7, 1, 1.0, float(i + 1), day) for i in range(20)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "b")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    bar = Tables(spark, str(tmp_path)).bars.first()
    assert (bar.open, bar.close) == (1.0, 20.0)


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", 50.0), ("a", 100.0), ("a", 100.0), ("a", 50.0)], "k string, g double")
    assert running.mode_of(df, ["k"], "g", "m").first().m == 50.0


def test_correlation_guards(spark):
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    got = [d.agg(stats.guarded_corr("x", "y").alias("r")).first().r for d in (flat, two, line)]
    assert got[0] == 0.0 and got[1] == 0.0 and got[2] == pytest.approx(1.0)


def test_trading_days_between_is_inclusive(spark):
    bounds = spark.createDataFrame([(days(0), days(30))], "lo date, hi date")
    hol = spark.createDataFrame([(days(2),)], "holiday_date date")
    cal = calendar(bounds, hol)
    df = spark.createDataFrame([(days(0), days(4))], "a date, b date")
    # Monday to Friday with Wednesday off.
    assert trading_days_between(df, cal, "a", "b", "n").first().n == 4


def test_conform_adds_missing_columns_with_defaults(spark):
    df = spark.createDataFrame([("x", None)], "symbol string, close double")
    r = conform(df, "symbol:s close:d volume:l day:date").first()
    assert tuple(r) == ("x", 0.0, 0, dt.date(1970, 1, 1))


def test_layout_comes_from_each_files_header(spark):
    """Quoted cells, shuffled columns, short lines, an empty file and a file of neither layout."""
    import os

    from tidebook.session import shared_dir
    from tidebook.sources import files as S

    files = {
        "old": 'NAME,INSTRUMENT,SYMBOL,EXPIRY_DT,STRIKE_PR,OPTION_TYP,CLOSE,OPEN_INT,CHG_IN_OI,CONTRACTS,trade_date\n"Index, weekly",OPTIDX , N ,25-Jan-2024,"21000",ce,10.5,100,1,2,2024-01-02\nx,FUTIDX,N,25-Jan-2024,0,XX,1,1,1,1,2024-01-02\nx,OPTIDX,N,never,1,CE,1,1,1,1,2024-01-02\n',
        "new": 'trade_date,OptnTp,TckrSymb,FinInstrmTp,StrkPric,XpryDt,ClsPric,OpnIntrst,ChngInOpnIntrst,TtlTradgVol,More\n2024-01-03,PE,N,IDO,21500,2024-02-01,,7,0,9,x\n2024-01-03,PE\n',
        "other": "a,b\n1,2\nOPTIDX,N\n", "empty": "", "header_only": "INSTRUMENT,SYMBOL\n",
    }
    base = shared_dir(spark, "reports").removeprefix("file:")
    os.makedirs(base)
    for name, text in files.items():
        with open(f"{base}/{name}.csv", "w") as f:
            f.write(text)
    got = sorted((r.symbol, str(r.expiry), r.strike, r.option_type, r.ltp, r.oi, r.volume, str(r.timestamp)) for r in S.routed_derivatives(spark, [base]).collect())
    assert got == [("N", "2024-01-25", 21000.0, "CE", 10.5, 100, 2, "2024-01-02 15:30:00"), ("N", "2024-02-01", 21500.0, "PE", 0.0, 7, 9, "2024-01-03 15:30:00")]
