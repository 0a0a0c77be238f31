"""Tasks of the fund jobs hold a fixed number of rows, whatever the session's shuffle partitions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidebook import session
from tidebook.operators.asof import asof_join
from tidebook.plans import funds as FU
from tidebook.sources.adapters import Tables

ROOT = "/root/testdata/sf0.001"


@pytest.fixture
def small(spark, monkeypatch):
    """Tables whose tasks take 500 rows, and the number of tasks of lineitem."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    t = Tables(spark, ROOT)
    n = -(-t.raw("lineitem").count() // 500)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    return t, n


def test_fund_windows_get_more_tasks_as_rows_grow(small):
    t, n = small
    assert FU.technical(t.nav).rdd.getNumPartitions() == n


def test_forward_asof_gets_more_tasks_as_rows_grow(spark, small):
    _, n = small
    assert entry.queries()["join08_asof_forward"](spark, ROOT).rdd.getNumPartitions() == n


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_by_whole_keys_matches_brute_force(spark, direction, exact):
    rnd = random.Random(5)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(200))
    left = [(rnd.choice("abc"), day(), i) for i in range(150)] + [("a", None, 150), (None, day(), 151)]
    right = {(rnd.choice("ab"), day()): float(i) for i in range(40)} | {(None, dt.date(2024, 3, 1)): -1.0}
    want = {}
    for k, d, i in left:
        ok = [x for kk, x in right if None not in (k, d) and kk == k and (x <= d if direction == "backward" else x >= d) and (exact or x != d)]
        want[i] = right[k, (max if direction == "backward" else min)(ok)] if ok else None
    lf = spark.createDataFrame(left, "k string, d date, i int")
    rf = spark.createDataFrame([(*kd, v) for kd, v in right.items()], "k string, e date, v double")
    got = asof_join(lf, rf, ["k"], "d", "e", ["v"], direction=direction, allow_exact=exact, time_slice=None, tasks=3)
    assert {r.i: r.v for r in got.collect()} == want


def test_enrichment_leaves_fund_rows_where_they_are(spark, small, capsys):
    t, n = small
    # A benchmark of its own, so that only the fund rows' shuffles are counted.
    bench = spark.createDataFrame([(dt.date(2001, 5, 1), 1.0)], "date date, close double")
    d = FU.enrich(t.nav, bench, F.to_date(F.lit("2001-06-30")), n)
    assert d.rdd.getNumPartitions() == n
    d.select("scheme_code", "date", "sma_20", "sip_return_1y", "week_return_pct", "volatility_1y").explain()
    # Raw rows and prices, for the daily and for the monthly columns, and the solved months.
    assert capsys.readouterr().out.count(" Exchange ") <= 5


def test_sip_months_without_prices_and_null_days(spark):
    nav = [(1, dt.date(2020, 1, 15), 10.0), (1, dt.date(2020, 4, 20), 20.0), (1, None, 7.0), (None, dt.date(2020, 2, 3), 9.0)]
    got = FU.sip_monthly(spark.createDataFrame(nav, "scheme_code long, date date, nav double"), {"r": 3}).orderBy("month").collect()
    assert [(r.scheme_code, r.month, r.month_end) for r in got] == [(1, dt.date(2020, 1, 1), dt.date(2020, 1, 15)), (1, dt.date(2020, 4, 1), dt.date(2020, 4, 20))]
    # February to April all buy on 20 April, the day they are valued: no rate.
    assert [r.r for r in got] == [0.0, 0.0]
    daily = FU.sip_returns(spark.createDataFrame(nav, "scheme_code long, date date, nav double"))
    assert sorted(r.date for r in daily.collect()) == [dt.date(2020, 1, 15), dt.date(2020, 4, 20)]


def test_captures_read_the_prices_as_the_other_columns_do(spark, small, capsys):
    # A filter on days below the shuffle would make the quality score read and shuffle the prices twice.
    t, _ = small
    bench = spark.createDataFrame([(dt.date(2001, 5, d), float(d)) for d in (2, 9)], "date date, close double")
    FU.captures(t.nav, bench, F.to_date(F.lit("2001-12-31"))).explain()
    scans = re.findall(r"DataFilters: \[([^\]]*)\]", capsys.readouterr().out)
    assert scans and not any("l_shipdate" in s for s in scans)


def test_captures_leave_out_days_outside_the_years(spark):
    day = dt.date
    nav = [(1, day(2021, 1, 4), 10.0), (1, day(2021, 1, 20), 11.0), (1, day(2021, 1, 29), 99.0), (1, day(2019, 12, 2), 1.0), (1, day(2019, 12, 9), 9.0),
           (2, day(2021, 1, 28), 5.0), (3, None, 5.0)]
    bench = [(day(2021, 1, 4), 100.0), (day(2021, 1, 20), 120.0), (day(2021, 1, 29), 60.0), (day(2019, 12, 2), 1.0), (day(2019, 12, 9), 2.0), (None, 3.0)]
    got = FU.captures(spark.createDataFrame(nav, "scheme_code long, date date, nav double"), spark.createDataFrame(bench, "date date, close double"),
                      F.to_date(F.lit("2021-01-20")), years=1).collect()
    assert [(r.scheme_code, round(r.upside_capture, 9), r.downside_capture) for r in got] == [(1, 50.0, 0.0)]
