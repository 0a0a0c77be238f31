"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.fragments import norm_cdf
from tidebook.catalog.registry import query
from tidebook.functions.exprs import attach_row, bucket_label, flag
from tidebook.operators import running as R
from tidebook.operators import stats as S
from tidebook.operators.rolling import change_events, period_rollup, week_ending


@query("agg01_group_basics", "symbol:s n:l lo:4 hi:4 total:2 mean:4",
       "select symbol, count(*) as n, min(low) as lo, max(high) as hi, sum(volume) as total, avg(close) as mean from bars group by 1")
def _agg01(t):
    return t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("lo"), F.max("high").alias("hi"),
                                        F.sum("volume").alias("total"), F.avg("close").alias("mean"))


@query("agg02_first_last_by", "symbol:s first_close:4 last_close:4",
       "select symbol, min_by(close, date) as first_close, max_by(close, date) as last_close from bars group by 1")
def _agg02(t):
    return t.bars.groupBy("symbol").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))


@query("agg03_conditional", "symbol:l wins:l win_sum:2 loss_avg:4 last_win:2",
       """select symbol, count(*) filter (where pnl_pts > 0) as wins, sum(pnl_pts) filter (where pnl_pts > 0) as win_sum,
       avg(pnl_pts) filter (where pnl_pts <= 0) as loss_avg, max_by(pnl_pts, trade_id) filter (where pnl_pts > 0) as last_win from outcomes group by 1""")
def _agg03(t):
    win = F.col("pnl_pts") > 0
    return t.outcomes.groupBy("symbol").agg(
        F.count_if(win).alias("wins"), F.sum(F.when(win, F.col("pnl_pts"))).alias("win_sum"),
        F.avg(F.when(~win, F.col("pnl_pts"))).alias("loss_avg"), F.max_by("pnl_pts", F.when(win, F.col("trade_id"))).alias("last_win"))


@query("agg04_distinct_count", "exit_reason:s symbols:l days:l",
       "select exit_reason, count(distinct symbol) as symbols, count(distinct exit_date) as days from outcomes group by 1")
def _agg04(t):
    return t.outcomes.groupBy("exit_reason").agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("exit_date").alias("days"))


@query("agg05_exact_median", "symbol:l n:l med:4 q25:4 q90:4",
       "select symbol, count(*) as n, median(pnl_pts) as med, quantile_cont(pnl_pts,0.25) as q25, quantile_cont(pnl_pts,0.9) as q90 from outcomes group by 1")
def _agg05(t):
    return R.exact_quantiles(t.outcomes, ["symbol"], "pnl_pts", {"med": 0.5, "q25": 0.25, "q90": 0.9})


@query("agg06_sample_and_population_std", "symbol:l sd_samp:6 sd_pop:6",
       "select symbol, stddev_samp(pnl_pts) as sd_samp, stddev_pop(pnl_pts) as sd_pop from outcomes group by 1")
def _agg06(t):
    return t.outcomes.groupBy("symbol").agg(F.stddev_samp("pnl_pts").alias("sd_samp"), F.stddev_pop("pnl_pts").alias("sd_pop"))


@query("agg07_having", "symbol:s date:d n:l",
       "select symbol, cast(ts as date) as date, count(*) as n from ticks group by 1,2 having count(*) >= 4")
def _agg07(t):
    return t.ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


@query("agg08_two_level", "oldest_latest:d newest_latest:d",
       "select min(m) as oldest_latest, max(m) as newest_latest from (select symbol, max(date) as m from bars group by 1) z")
def _agg08(t):
    g = t.bars.groupBy("symbol").agg(F.max("date").alias("m"))
    return g.agg(F.min("m").alias("oldest_latest"), F.max("m").alias("newest_latest"))


_OHLC = "min_by(open,date) as open, max(high) as high, min(low) as low, max_by(close,date) as close"


@query("agg09_monthly_ohlc", "symbol:s month:d open:4 high:4 low:4 close:4",
       f"select symbol, cast(date_trunc('month',date) as date) as month, {_OHLC} from bars group by 1,2")
def _agg09(t):
    return period_rollup(t.bars, ["symbol"], F.trunc("date", "MM"), "month")


@query("agg10_weekly_ohlc", "kind:s symbol:s week:d open:4 high:4 low:4 close:4",
       f"""select 'monday' as kind, symbol, cast(date_trunc('week',date) as date) as week, {_OHLC} from bars group by 2,3
       union all select 'thursday', symbol, cast(date_trunc('week', date + 3) as date) + 3, {_OHLC} from bars group by 2,3""")
def _agg10(t):
    a = period_rollup(t.bars, ["symbol"], F.trunc("date", "week"), "week").withColumn("kind", F.lit("monday"))
    b = period_rollup(t.bars, ["symbol"], week_ending("date", "Thu"), "week").withColumn("kind", F.lit("thursday"))
    return a.unionByName(b)


@query("agg11_guarded_correlation", "symbol:l r:6",
       "select symbol, case when count(*) >= 3 then corr(conf, pnl_pts) else 0 end as r from outcomes group by 1")
def _agg11(t):
    return t.outcomes.groupBy("symbol").agg(S.guarded_corr("conf", "pnl_pts").alias("r"))


@query("agg12_mode", "symbol:l expiry:d step:1",
       """with k as (select distinct symbol, expiry, strike from chain where option_type='CE'), d as (select symbol, expiry, strike - lag(strike) over (partition by symbol, expiry order by strike) as s from k),
       c as (select symbol, expiry, s, count(*) as n from d where s > 0 group by 1,2,3) select symbol, expiry, arg_min(s, (-n)*100000 + s) as step from c group by 1,2""")
def _agg12(t):
    from tidebook.plans.options import strike_gaps
    return R.mode_of(strike_gaps(t.chain.where("option_type = 'CE'"), ["symbol", "expiry"]), ["symbol", "expiry"], "gap", "step")


@query("agg13_pivot", "symbol:l click:l error:l purchase:l signup:l view:l",
       """select symbol, count(*) filter (where exit_reason='click') as click, count(*) filter (where exit_reason='error') as error, count(*) filter (where exit_reason='purchase') as purchase,
       count(*) filter (where exit_reason='signup') as signup, count(*) filter (where exit_reason='view') as "view" from outcomes group by 1""")
def _agg13(t):
    return t.outcomes.groupBy("symbol").pivot("exit_reason", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("agg14_top_k_share", "symbol:l snap_date:d expiry:d share:6",
       """with r as (select *, row_number() over (partition by symbol, snap_date, expiry order by oi desc) as k from chain where option_type='CE')
       select symbol, snap_date, expiry, sum(oi) filter (where k<=3)/greatest(sum(oi),1)::double as share from r group by 1,2,3""")
def _agg14(t):
    return S.top_k_share(t.chain.where("option_type = 'CE'"), ["symbol", "snap_date", "expiry"], "oi", 3, "share")


@query("agg15_arg_extreme", "symbol:l snap_date:d expiry:d option_type:s wall:1",
       "select symbol, snap_date, expiry, option_type, arg_max(strike, oi*1000000.0 - strike) as wall from chain group by 1,2,3,4")
def _agg15(t):
    return t.chain.groupBy("symbol", "snap_date", "expiry", "option_type").agg(F.max_by("strike", F.struct("oi", -F.col("strike"))).alias("wall"))


_BUNDLE = """count(*) as n, avg(case when pnl_pts>0 then 1 else 0 end)*100 as win_rate, avg(pnl_pts) as avg_ret, max(pnl_pts) as best, min(pnl_pts) as worst,
       stddev_samp(pnl_pts) as std, avg(pnl_pts)/stddev_samp(pnl_pts) as sharpe"""
_BUNDLE_OUT = "n:l win_rate:4 avg_ret:4 best:2 worst:2 std:4 sharpe:6"


@query("agg16_stat_bundle", f"symbol:l {_BUNDLE_OUT} median:4", f"select symbol, {_BUNDLE}, median(pnl_pts) as median from outcomes group by 1")
def _agg16(t):
    g = t.outcomes.groupBy("symbol").agg(*S.summary_exprs("pnl_pts"))
    return g.join(R.exact_quantiles(t.outcomes, ["symbol"], "pnl_pts", {"median": 0.5}).drop("n"), "symbol")


@query("agg17_split_bundle", f"symbol:l period:s {_BUNDLE_OUT}",
       f"""with s as (select *, 'full' as period from outcomes union all select *, case when exit_date <= date '2024-01-20' then 'train' else 'test' end from outcomes)
       select symbol, period, {_BUNDLE} from s group by 1,2""")
def _agg17(t):
    d = S.split_label(t.outcomes, "exit_date", F.to_date(F.lit("2024-01-20")))
    return d.groupBy("symbol", "period").agg(*S.summary_exprs("pnl_pts"))


@query("agg18_calendar_filled_sharpe", "months:l mean_ret:6 std_ret:6 sharpe:6",
       """with m as (select cast(date_trunc('month',date) as date) as month, avg(close) as r from bars where extract(month from date) % 3 = 0 group by 1),
       a as (select cast(unnest(generate_series((select min(month) from m), (select max(month) from m), interval 1 month)) as date) as month),
       f as (select coalesce(r,0) as r from a left join m using (month)) select count(*) as months, avg(r) as mean_ret, stddev_samp(r) as std_ret, avg(r)/stddev_samp(r)*sqrt(12) as sharpe from f""")
def _agg18(t):
    return S.monthly_filled_sharpe(t.bars.where(F.month("date") % 3 == 0), "date", "close")


@query("agg19_quantile_split_welch", "diff:4 t_stat:4 p_value:4",
       f"""with q as (select quantile_cont(conf,0.33) as lo, quantile_cont(conf,0.66) as hi from outcomes), b as (select pnl_pts, case when conf>=hi then 'buy' when conf<=lo then 'sell' end as k from outcomes, q),
       s as (select avg(pnl_pts) filter (where k='buy') as ma, avg(pnl_pts) filter (where k='sell') as mb, var_samp(pnl_pts) filter (where k='buy')/count(*) filter (where k='buy') as va,
       var_samp(pnl_pts) filter (where k='sell')/count(*) filter (where k='sell') as vb from b), x as (select ma-mb as diff, (ma-mb)/sqrt(va+vb) as t_stat from s)
       select *, 2*(1-{norm_cdf('abs(t_stat)')}) as p_value from x""")
def _agg19(t):
    q = R.exact_quantiles(t.outcomes, [], "conf", {"lo": 0.33, "hi": 0.66})
    b = attach_row(t.outcomes, q).withColumn("bucket", F.when(F.col("conf") >= F.col("hi"), "buy").when(F.col("conf") <= F.col("lo"), "sell"))
    return S.welch(b, "pnl_pts", "buy", "sell")


@query("agg20_one_sample_t", "symbol:l t_stat:6 p_value:6",
       f"with s as (select symbol, avg(pnl_pts)/(stddev_samp(pnl_pts)/sqrt(count(*))) as t_stat from outcomes group by 1) select *, 2*(1-{norm_cdf('abs(t_stat)')}) as p_value from s")
def _agg20(t):
    return t.outcomes.groupBy("symbol").agg(S.one_sample_t("pnl_pts").alias("t_stat")).withColumn("p_value", S.two_sided_p("t_stat"))


@query("agg21_expectancy_by_bucket", "bucket:s n:l win_rate:4 expectancy:4",
       """with b as (select case when conf < 25 then 'q1' when conf < 50 then 'q2' when conf < 75 then 'q3' else 'q4' end as bucket, pnl_pts, case when pnl_pts>0 then 1 else 0 end as w from outcomes)
       select bucket, count(*) as n, avg(w)*100 as win_rate, avg(w)*coalesce(avg(pnl_pts) filter (where w=1),0) + (1-avg(w))*coalesce(avg(pnl_pts) filter (where w=0),0) as expectancy
       from b group by 1 having count(*) >= 3""")
def _agg21(t):
    d = t.outcomes.withColumn("bucket", bucket_label("conf", [25, 50, 75], ["q1", "q2", "q3", "q4"])).withColumn("win", flag(F.col("pnl_pts") > 0))
    return d.groupBy("bucket").agg(*S.expectancy("pnl_pts", "win")).where("n >= 3")


@query("agg22_threshold_sweep", "symbol:l threshold:0 hit_rate:4",
       "select symbol, x.threshold, avg(case when conf >= x.threshold then 1 else 0 end)*100 as hit_rate from outcomes, (values (50),(55),(60),(65),(70),(75),(80),(85),(90),(95)) x(threshold) group by 1,2")
def _agg22(t):
    return S.threshold_sweep(t.outcomes, ["symbol"], "conf", range(50, 96, 5))


@query("agg23_kpi_rollup", "service:s runs:l ok:l errors:l total_rows:l last_run:t",
       """select service, count(*) as runs, count(*) filter (where status='success') as ok, count(*) filter (where status='failed') as errors, sum(rows_written) as total_rows, max(started_at) as last_run
       from runs where run_date >= date '2024-01-30' - 30 group by 1""")
def _agg23(t):
    d = t.runs.where(F.col("run_date") >= F.date_sub(F.to_date(F.lit("2024-01-30")), 30))
    return d.groupBy("service").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "success").alias("ok"),
                                    F.count_if(F.col("status") == "failed").alias("errors"), F.sum("rows_written").alias("total_rows"), F.max("started_at").alias("last_run"))


@query("agg24_effective_lot_changes", "symbol:l date:d lot:l",
       """with m as (select symbol, snap_date as date, min(oi) as lot from chain where oi > 0 group by 1,2), l as (select *, lag(lot) over (partition by symbol order by date) as p from m)
       select symbol, date, lot from l where p is null or p <> lot""")
def _agg24(t):
    daily = t.chain.where("oi > 0").groupBy("symbol", F.col("snap_date").alias("date")).agg(F.min("oi").alias("lot"))
    return change_events(daily, ["symbol"], "date", "lot")
