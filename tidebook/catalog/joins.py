"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.functions.exprs import repeat_for
from tidebook.operators import asof as A
from tidebook.operators.dedup import latest_version
from tidebook.operators.rolling import period_rollup
from tidebook.plans import quality as Q


@query("join01_equi_of_deduped", "scheme_code:l scheme_name:s nav:4",
       "with l as (select scheme_code, max_by(nav, date) as nav from nav group by 1) select f.scheme_code, scheme_name, l.nav from funds f join l using (scheme_code) where is_active = 1")
def _join01(t):
    latest = latest_version(t.nav, ["scheme_code"], "date").select("scheme_code", "nav")
    return t.funds.where("is_active = 1").join(latest, "scheme_code")


@query("join02_left_multi_key", "symbol:l snap_date:d expiry:d strike:1 option_type:s ltp:2 next_ltp:2",
       """select a.symbol, a.snap_date, a.expiry, a.strike, a.option_type, a.ltp, b.ltp as next_ltp from chain_w a left join chain_w b
       on a.symbol=b.symbol and a.expiry=b.expiry and a.strike=b.strike and a.option_type=b.option_type and b.snap_date = a.snap_date + 7""")
def _join02(t):
    c = t.chain_w
    nxt = c.select("symbol", F.date_sub("snap_date", 7).alias("snap_date"), "expiry", "strike", "option_type", F.col("ltp").alias("next_ltp"))
    return c.join(nxt, ["symbol", "snap_date", "expiry", "strike", "option_type"], "left")


@query("join03_anti_without_prediction", "symbol:s date:d",
       """select symbol, date from bars b where not exists (select 1 from vix v where v.date = b.date and v.vix > 20)""")
def _join03(t):
    return t.bars.join(t.vix.where("vix > 20"), "date", "left_anti").select("symbol", "date")


@query("join04_semi_in_set", "scheme_code:l date:d nav:4",
       "select * from nav n where exists (select 1 from supplier s where s.s_suppkey = n.scheme_code and s_acctbal > 5000)")
def _join04(t):
    good = t.raw("supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("scheme_code"))
    return t.nav.join(good, "scheme_code", "left_semi")


@query("join05_asof_lot_size", "symbol:s date:d lot_size:i effective_from:d",
       "select b.symbol, b.date, l.lot_size, l.effective_from from bars b asof left join lots l on b.symbol=l.symbol and b.date >= l.effective_from")
def _join05(t):
    return A.asof_join(t.bars, t.lots, ["symbol"], "date", "effective_from", ["lot_size"], matched_on="effective_from")


@query("join06_asof_tolerance", "symbol:s date:d vix:2",
       """with v as (select date, vix from vix where extract(day from date) % 9 = 0), j as (select b.symbol, b.date, v.vix, v.date as vd from bars b asof left join v on b.date >= v.date)
       select symbol, date, case when date - vd <= 7 then vix end as vix from j""")
def _join06(t):
    # One series for all symbols: a constant key, split by month inside the join.
    v = t.vix.where(F.dayofmonth("date") % 9 == 0).withColumn("_k", F.lit(0))
    return A.asof_join(t.bars.select("symbol", "date", F.lit(0).alias("_k")), v, ["_k"], "date", "date", ["vix"], tolerance_days=7)


@query("join07_previous_trading_day", "symbol:s date:d prev_date:d",
       "select symbol, date, lag(date) over (partition by symbol order by date) as prev_date from bars")
def _join07(t):
    b = t.bars.select("symbol", "date")
    return A.previous_match(b, b, ["symbol"], "date", "date", "prev_date")


@query("join08_asof_forward", "scheme_code:l month_start:d first_date:d nav:4",
       """with m as (select distinct scheme_code, cast(date_trunc('month', date) as date) as month_start from nav)
       select m.scheme_code, month_start, n.date as first_date, n.nav from m asof left join nav n on m.scheme_code=n.scheme_code and m.month_start <= n.date""")
def _join08(t):
    m = t.nav.select("scheme_code", F.trunc("date", "MM").alias("month_start")).distinct()
    # One price per fund and day: a fund's rows are bounded by its days.
    return A.asof_join(m, t.nav, ["scheme_code"], "month_start", "date", ["nav"], direction="forward", matched_on="first_date",
                       time_slice=None, tasks=t.tasks("lineitem"))


@query("join09_interval_events", "snap_date:d expiry:d event_in_window:i days_to_event:i",
       """with k as (select distinct snap_date, expiry from chain), h as (select distinct event_date from market_events where impact = 'HIGH')
       select k.snap_date, k.expiry, max(case when h.event_date <= k.expiry then 1 else 0 end) as event_in_window,
       coalesce(least(min(h.event_date - k.snap_date), 30), 30) as days_to_event from k left join h on h.event_date >= k.snap_date group by 1,2""")
def _join09(t):
    keys = t.chain.select("snap_date", "expiry").distinct()
    return A.interval_hits(keys, t.market_events.where("impact = 'HIGH'"), "snap_date", "expiry", "event_date")


@query("join10_legs_on_strike", "symbol:l snap_date:d expiry:d strike:1 ce:2 pe:2",
       """select a.symbol, a.snap_date, a.expiry, a.strike, a.ltp as ce, b.ltp as pe from chain a join chain b using (symbol, snap_date, expiry, strike)
       where a.option_type='CE' and b.option_type='PE'""")
def _join10(t):
    from tidebook.plans.options import both_legs
    return both_legs(t.chain)


@query("join11_multi_leg_prices", "snap_date:d expiry:d strike:1 sce:2 spe:2 lce:2 lpe:2",
       """select a.snap_date, a.expiry, a.strike, a.ltp as sce, b.ltp as spe, c.ltp as lce, d.ltp as lpe from chain_w a
       join chain_w b on b.symbol=a.symbol and b.snap_date=a.snap_date and b.expiry=a.expiry and b.strike=a.strike and b.option_type='PE'
       join chain_w c on c.symbol=a.symbol and c.snap_date=a.snap_date and c.expiry=a.expiry and c.strike=a.strike+100 and c.option_type='CE'
       join chain_w d on d.symbol=a.symbol and d.snap_date=a.snap_date and d.expiry=a.expiry and d.strike=a.strike-100 and d.option_type='PE' where a.option_type='CE'""")
def _join11(t):
    from tidebook.plans.spreads import day_prices, leg
    d = day_prices(t.chain_w)
    k = t.chain_w.where("option_type = 'CE'").select("symbol", "snap_date", "expiry", "strike").join(d, ["symbol", "snap_date", "expiry"])
    legs = {"sce": ("CE", 0), "spe": ("PE", 0), "lce": ("CE", 100), "lpe": ("PE", -100)}
    out = k.withColumns({n: leg("prices", F.col("strike") + off, side) for n, (side, off) in legs.items()})
    return out.dropna(subset=list(legs))


@query("join12_parameter_cross", "strategy:s short_n:i wing_m:i n_snapshots:l",
       """select s.strategy, a.n as short_n, b.n as wing_m, (select count(*) from (select distinct symbol, snap_date, expiry from chain) z) as n_snapshots
       from (values ('iron_condor'),('bull_put'),('bear_call')) s(strategy), (values (1),(2),(3),(4)) a(n), (values (1),(2),(3),(4)) b(n)""")
def _join12(t):
    from tidebook.plans.spreads import GRID, GRID_NAMES
    n = t.chain.select("symbol", "snap_date", "expiry").distinct()
    return repeat_for(n, GRID_NAMES, GRID).groupBy("strategy", "short_n", "wing_m").agg(F.count(F.lit(1)).alias("n_snapshots"))


@query("join13_theta_self_join", "symbol:l snap_date:d expiry:d strike:1 payout:0",
       """with k as (select symbol, snap_date, expiry, strike, sum(case when option_type='CE' then oi else 0 end) as c, sum(case when option_type='PE' then oi else 0 end) as p from chain group by 1,2,3,4)
       select a.symbol, a.snap_date, a.expiry, a.strike, sum(greatest(a.strike-b.strike,0)*b.c + greatest(b.strike-a.strike,0)*b.p) as payout
       from k a join k b using (symbol, snap_date, expiry) group by 1,2,3,4""")
def _join13(t):
    from tidebook.plans.options import writer_payout
    return writer_payout(t.chain)


@query("join14_broadcast_dims", "symbol:s date:d vix:2 net_value:2",
       "select b.symbol, b.date, coalesce(v.vix,0) as vix, coalesce(f.net_value,0) as net_value from bars b left join vix v using (date) left join day_flows f using (date)")
def _join14(t):
    b = A.dim_lookup(t.bars, t.vix.select("date", "vix"), ["date"], {"vix": 0.0})
    return A.dim_lookup(b, t.day_flows, ["date"], {"net_value": 0.0})


@query("join15_lag_behind_market", "market:s symbol:s last_date:d market_max:d days_behind:i",
       """with s as (select case when symbol like '%1%' then 'A' else 'B' end as market, symbol, max(date) as last_date from bars group by 1,2),
       m as (select market, max(last_date) as market_max from s group by 1) select *, market_max - last_date as days_behind from s join m using (market)""")
def _join15(t):
    b = t.bars.withColumn("market", F.when(F.col("symbol").contains("1"), "A").otherwise("B"))
    return Q.lag_behind_market(b, 0, inclusive=True)


@query("join16_latest_with_dimension", "scheme_code:l current_nav:4 category:i",
       "select n.scheme_code, max_by(n.nav, n.date) as current_nav, any_value(f.scheme_category) as category from nav n join funds f using (scheme_code) group by 1")
def _join16(t):
    latest = t.nav.groupBy("scheme_code").agg(F.max_by("nav", "date").alias("current_nav"))
    return latest.join(t.funds.select("scheme_code", F.col("scheme_category").alias("category")), "scheme_code")


@query("join17_rollup_to_days", "symbol:s date:d week_high:4 week_low:4",
       """with w as (select symbol, cast(date_trunc('week',date) as date) as week, max(high) as week_high, min(low) as week_low from bars group by 1,2)
       select b.symbol, b.date, week_high, week_low from bars b join w on w.symbol=b.symbol and w.week=cast(date_trunc('week',b.date) as date)""")
def _join17(t):
    wk = period_rollup(t.bars, ["symbol"], F.trunc("date", "week"), "week").select(
        "symbol", "week", F.col("high").alias("week_high"), F.col("low").alias("week_low"))
    return t.bars.withColumn("week", F.trunc("date", "week")).join(wk, ["symbol", "week"])


@query("join18_fallback_source", "date:d net_value:2",
       """select date, net_value from day_flows where extract(day from date) <= 20 union all select date, sum(volume) from bars b
       where not exists (select 1 from day_flows f where f.date=b.date and extract(day from f.date) <= 20) group by 1""")
def _join18(t):
    alt = t.bars.groupBy("date").agg(F.sum("volume").alias("net_value"))
    return A.with_fallback(t.day_flows.where(F.dayofmonth("date") <= 20).select("date", "net_value"), alt, ["date"])


