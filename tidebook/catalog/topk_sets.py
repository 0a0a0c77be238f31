"""Sort, limit, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.options import OPTIMAL_SQL, SPREAD_SQL
from tidebook.catalog.registry import query
from tidebook.operators import dedup as D
from tidebook.operators import stats as ST
from tidebook.plans import spreads as SP
from tidebook.plans.options import both_legs


@query("srt01_order_limit", "symbol:s date:d close:4", "select symbol, date, close from bars order by close desc, symbol, date limit 25")
def _srt01(t):
    return t.bars.orderBy(F.col("close").desc(), "symbol", "date").limit(25)


@query("srt02_latest_row_per_key", "scheme_code:l date:d nav:4", "select * from (select *, row_number() over (partition by scheme_code order by date desc) as z from nav) q where z = 1")
def _srt02(t):
    return D.latest_by(t.nav, ["scheme_code"], ["date"])


@query("srt03_top_n_per_group", "scheme_category:i scheme_code:l nav:4 rank:i",
       """with l as (select scheme_code, max_by(nav,date) as nav from nav group by 1) select * from (select f.scheme_category, scheme_code, nav, row_number() over (partition by f.scheme_category order by nav desc, scheme_code) as rank from funds f join l using (scheme_code)) q where rank <= 3""")
def _srt03(t):
    latest = D.latest_by(t.nav, ["scheme_code"], ["date"]).join(t.funds, "scheme_code")
    return ST.top_n(latest, ["scheme_category"], [F.col("nav").desc(), F.col("scheme_code")], 3)


@query("srt04_nearest_value", "symbol:l snap_date:d expiry:d nearest:1", "select symbol, snap_date, expiry, arg_min(strike, abs(strike-24010)*1000000+strike) as nearest from chain group by 1,2,3")
def _srt04(t):
    return ST.nearest(t.chain.withColumn("_t", F.lit(24010.0)), ["symbol", "snap_date", "expiry"], "strike", "_t", "nearest")


@query("srt05_best_params", "symbol:l strategy:s short_n:i wing_m:i sharpe_pct:4",
       f"with {SPREAD_SQL.format(c='chain_w', dte=100)}, {OPTIMAL_SQL} select * from (select *, row_number() over (partition by symbol, strategy order by sharpe_pct desc, short_n, wing_m) as z from op where n_trades >= 10) q where z = 1")
def _srt05(t):
    return SP.best_params(SP.optimal_params(SP.price_spreads(t.chain_w, max_dte=100)))


@query("srt06_best_worst_rows", "symbol:l best_trade:l best_pnl:2 worst_trade:l worst_pnl:2",
       "select symbol, arg_max(trade_id, pnl_pts*1000000000-trade_id) as best_trade, max(pnl_pts) as best_pnl, arg_min(trade_id, pnl_pts*1000000000+trade_id) as worst_trade, min(pnl_pts) as worst_pnl from outcomes group by 1")
def _srt06(t):
    p, i = F.col("pnl_pts"), F.col("trade_id")
    return t.outcomes.groupBy("symbol").agg(
        F.max_by(i, F.struct(p, -i)).alias("best_trade"), F.max(p).alias("best_pnl"), F.min_by(i, F.struct(p, i)).alias("worst_trade"), F.min(p).alias("worst_pnl"))


@query("set01_union_all", "origin:s symbol:l n:l total:2",
       "select origin, symbol, count(*) as n, sum(pnl_pts) as total from (select 'live' as origin, symbol, pnl_pts from outcomes union all select 'hist', symbol, pnl_pts*lots from outcomes) z group by 1,2")
def _set01(t):
    a = t.outcomes.select(F.lit("live").alias("origin"), "symbol", "pnl_pts")
    b = t.outcomes.select(F.lit("hist").alias("origin"), "symbol", (F.col("pnl_pts") * F.col("lots")).alias("pnl_pts"))
    return a.unionByName(b).groupBy("origin", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl_pts").alias("total"))


@query("set02_date_difference", "date:d", "select distinct date from bars except select date from vix where vix > 20")
def _set02(t):
    return t.bars.select("date").distinct().join(t.vix.where("vix > 20").select("date"), "date", "left_anti")


@query("set03_strike_intersection", "symbol:l snap_date:d expiry:d common:l",
       "select symbol, snap_date, expiry, count(*) as common from (select symbol, snap_date, expiry, strike from chain where option_type='CE' intersect select symbol, snap_date, expiry, strike from chain where option_type='PE') z group by 1,2,3")
def _set03(t):
    return both_legs(t.chain).groupBy("symbol", "snap_date", "expiry").agg(F.count(F.lit(1)).alias("common"))


@query("set04_outer_completion", "scheme_category:i n:l target:2",
       """with c as (select scheme_category, count(*) as n from funds group by 1), g as (select n_nationkey + 5 as scheme_category, n_regionkey * 2.5 as target from nation)
       select coalesce(c.scheme_category, g.scheme_category) as scheme_category, coalesce(n,0) as n, coalesce(target,0) as target from c full join g on c.scheme_category = g.scheme_category""")
def _set04(t):
    c = t.funds.groupBy("scheme_category").agg(F.count(F.lit(1)).alias("n"))
    g = t.raw("nation").select((F.col("n_nationkey") + 5).alias("scheme_category"), (F.col("n_regionkey") * 2.5).alias("target"))
    return ST.complete_groups(c, g, "scheme_category", {"n": 0, "target": 0.0})


@query("set05_pooled_one_hot", "trade_id:l sym_0:1 sym_1:1 sym_2:1 sym_3:1",
       "select trade_id, " + ", ".join(f"case when symbol={i} then 1.0 else 0.0 end as sym_{i}" for i in range(4)) + " from outcomes")
def _set05(t):
    return ST.one_hot(t.outcomes, "symbol", range(4), "sym_")
