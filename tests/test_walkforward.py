"""Folds, fits and live scores against plain loops and the batch."""

import random
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidebook.plans import scoring as SC
from tidebook.plans import walkforward as WF
from tidebook.session import shared_dir
from tidebook.streaming import jobs as J

FEATURES = ["a", "b", "c"]


def trades(spark):
    random.seed(11)
    rows = []
    for g, n, span in (("x", 400, 900), ("y", 130, 700), ("z", 40, 300)):
        for i in range(n):
            a, b = random.gauss(0, 1), random.gauss(0, 2)
            rows.append((g, i, date(2020, 1, 5) + timedelta(days=random.randrange(span)), a, b, None if i % 9 == 0 else random.random(), int(a + 0.3 * b + random.gauss(0, 1) > 0)))
    return rows, spark.createDataFrame(rows, "g string, id long, day date, a double, b double, c double, target int")


def month(d, k=0):
    m = d.year * 12 + d.month - 1 + k
    return date(m // 12, m % 12 + 1, 1)


def loop(rows, train_months, test_months):
    """Folds of one group as a plain loop over test starts."""
    rows = sorted(rows, key=lambda r: r[2])
    if len(rows) <= WF.MIN_HISTORY:
        return []
    out, fold, start = [], 0, month(rows[WF.MIN_HISTORY][2])
    while start <= rows[-1][2]:
        end, low = month(start, test_months), month(start, -train_months)
        train, test = [r for r in rows if low <= r[2] < start], [r for r in rows if start <= r[2] < end]
        if len(train) >= WF.MIN_TRAIN and test:
            out.append((fold, start, train, test))
            fold += 1
        start = end
    return out


def test_folds_and_scores_equal_a_loop(spark):
    rows, df = trades(spark)
    for limits in ({}, {"train_months": 6, "test_months": 3}, {"train_months": 5, "test_months": 4}):
        plan = {(r.g, r.fold): (r.test_start, r.n_train, r.n_test) for r in WF.fold_plan(df, ["g"], "day", **limits).collect()}
        scored = {(r.g, r.id): (r.fold, r.confidence) for r in WF.out_of_fold(df, ["g"], "day", FEATURES, ["id"], **limits).collect()}
        want_plan, want = {}, {}
        x = lambda rs: np.array([[v or 0.0 for v in r[3:6]] for r in rs])
        for g in "xyz":
            for fold, start, train, test in loop([r for r in rows if r[0] == g], limits.get("train_months", 12), limits.get("test_months", 1)):
                want_plan[g, fold] = (start, len(train), len(test))
                p = WF.logistic_scores(x(train), np.array([r[6] for r in train], float), x(test))
                want |= {(g, r[1]): (fold, v) for r, v in zip(test, p, strict=True)}
        assert plan == want_plan and plan
        assert {k: v[0] for k, v in scored.items()} == {k: v[0] for k, v in want.items()}
        assert max(abs(scored[k][1] - want[k][1]) for k in want) < 1e-9


def test_logistic_fit_is_the_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + rng.normal(size=80) > 0.8).astype(float)
    mean, scale, w, b = WF.fit_logistic(x, y)
    z, weight = (x - mean) / scale, np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (1 - y).sum()))

    def loss(w, b):
        margin = z @ w + b
        return 0.5 * w @ w + WF.INVERSE_PENALTY * (weight * (np.logaddexp(0, margin) - y * margin)).sum()

    best = loss(w, b)
    assert all(loss(w + rng.normal(size=3) * 1e-3, b + rng.normal() * 1e-3) >= best for _ in range(200))
    assert WF.logistic_scores(x, np.ones(80), x[:2]).tolist() == [1.0, 1.0]


def test_stored_models_fall_back_to_the_pooled_one(spark):
    _, df = trades(spark)
    path = shared_dir(spark, "models")
    meta = {r.model_key: r for r in WF.store_models(SC._ready(df, FEATURES), ["g"], FEATURES, "lr", path, [("x",), ("z",), ()], category="g").collect()}
    assert set(meta) == {"x", "pooled"} and meta["x"].n_train == 400 and meta["pooled"].is_pooled  # z has too few rows
    ready = SC._ready(df, FEATURES).where("g = 'z'")
    own, features = WF.load_model(spark, path, ("x",))
    pooled, _ = WF.load_model(spark, path, ("z",))
    assert features == FEATURES and SC.score(own, ready).count() == SC.score(pooled, ready).count() == 40
    assert WF.load_model(spark, path, ("none",)) is not None


def test_pooled_model_of_few_rows_scores_and_no_rows_give_no_score(spark):
    _, df = trades(spark)
    few, path = SC._ready(df, FEATURES).where("g = 'z'").limit(28), shared_dir(spark, "few")
    meta = [(r.model_key, r.n_train, r.is_pooled) for r in WF.store_models(few, ["g"], FEATURES, "lr", path, [("z",), ()], category="g").collect()]
    assert meta == [("pooled", 28, True)]
    model, features = WF.load_model(spark, path, ("z",))
    inputs = few.select(F.lit("x").alias("symbol"), F.lit(0).alias("ts"), F.lit(0).alias("expiry"), "g", *features)
    assert WF.live_scores(inputs, model).where("confidence between 0 and 100").count() == 28
    none = shared_dir(spark, "none")
    meta = [(r.model_key, r.n_train) for r in WF.store_models(few.where("id < 0"), ["g"], FEATURES, "lr", none, [("z",), ()], category="g").collect()]
    assert meta == [("pooled", 0)] and WF.load_model(spark, none, ("z",)) is None
    assert [r.confidence for r in WF.live_scores(inputs.limit(2), None).collect()] == [None, None]


def test_live_scores_of_a_stream_equal_the_batch(spark):
    random.seed(2)
    snaps = [(s, datetime(2024, 1, 1) + timedelta(days=d, hours=10, minutes=5 * k), date(2024, 1, 1) + timedelta(days=d + 3), 100.0 * k, 40.0 + d + k, 12.0, None if k == 2 else 14.0)
             for s in ("x", "y") for d in range(20) for k in range(3)]
    df = spark.createDataFrame(snaps, "symbol string, ts timestamp, expiry date, strike double, straddle double, ce_iv double, pe_iv double")
    days = spark.createDataFrame([(s, date(2024, 1, 1 + d)) for s in ("x", "y") for d in (0, 1, 5, 9)], "symbol string, date date")
    values = spark.createDataFrame([(s, date(2024, 1, 1 + d), 10.0 + d) for s in ("x", "y") for d in (0, 1, 5, 9)], "symbol string, date date, vix double")
    events = spark.createDataFrame([(date(2024, 1, 6),), (date(2024, 1, 30),)], "event_date date")
    daily = WF.next_event(SC.point_in_time(WF.calendar(days), {"v": (values, "date", ["vix"])}), events)
    stats = df.groupBy("symbol", F.datediff("expiry", F.to_date("ts")).alias("dte")).agg(F.avg("straddle").alias("_mean"), F.stddev_pop("straddle").alias("_std"))
    features = ["vix", "straddle_pct", "straddle_z", "dte", "atm_ce_iv", "atm_pe_iv", "event_in_window", "days_to_event", "day_of_week", "unknown"]
    train = WF.live_inputs(df, daily, stats, features).withColumn("target", (F.col("straddle_pct") > 30).cast("int"))
    model = SC.final_model(train, features, "lr")
    path = shared_dir(spark, "snaps")
    for part in (2, 0, 1):  # three files a day, out of order
        df.where(F.minute("ts") == 5 * part).orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(path)
    stream = J.stream_parquet(spark, path, df.schema, max_files=1)
    got = J.drain(WF.live_scores(WF.live_inputs(stream, daily, stats, features), model), "live")
    batch = WF.live_scores(WF.live_inputs(df, daily, stats, features), model)
    key = lambda d: sorted((r.symbol, r.ts, r.confidence) for r in d.collect())
    assert key(got) == key(batch) and got.count() == len(snaps)
    rows = {(r.symbol, r.ts): r for r in WF.live_inputs(df, daily, stats, features).collect()}
    r = rows["x", datetime(2024, 1, 4, 10, 5)]  # newest value is of January 2nd; the event of the 6th lies before the expiry
    assert (r.vix, r.dte, r.event_in_window, r.days_to_event, r.straddle_pct, r.unknown) == (11.0, 3.0, 1.0, 2.0, 44.0, 0.0)
    assert rows["x", datetime(2024, 1, 20, 10, 0)].vix == 0.0  # beyond the calendar's horizon
