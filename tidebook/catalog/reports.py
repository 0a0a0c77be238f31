"""Data-quality and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.functions.exprs import attach_row, bucket_label
from tidebook.operators.dedup import latest_by
from tidebook.plans import quality as Q
from tidebook.plans import reports as R


def day(s):
    return F.to_date(F.lit(s))


@query("dq01_freshness", "label:s last_date:d days_stale:i stale:i", "select symbol as label, max(date) as last_date, date '2001-12-31'-max(date) as days_stale, case when date '2001-12-31'-max(date) > 3 then 1 else 0 end as stale from bars group by 1")
def _dq01(t):
    return Q.freshness(t.bars, "symbol", "date", day("2001-12-31"), 3)


@query("dq02_symbol_staleness", "market:s symbol:s last_date:d days_behind:i",
       """with s as (select 'm'||scheme_category as market, scheme_code as symbol, max(date) as last_date from nav join funds using (scheme_code) group by 1,2), m as (select market, max(last_date) as mm from s group by 1)
       select market, symbol, last_date, mm-last_date as days_behind from s join m using (market) where mm-last_date > 2""")
def _dq02(t):
    d = t.nav.join(t.funds, "scheme_code").select(F.concat(F.lit("m"), F.col("scheme_category").cast("string")).alias("market"), F.col("scheme_code").alias("symbol"), "date")
    return Q.lag_behind_market(d, 2)


EXPECTED = [("click", "02:00"), ("error", "04:30"), ("backup", "03:00"), ("late_job", "23:50")]


@query("dq03_run_issues", "service:s issue:s",
       """with e(service, hh) as (values ('click','02:00'),('error','04:30'),('backup','03:00'),('late_job','23:50')), l as (select service, max_by(status, version) as status from runs where run_date=date '2024-01-15' group by 1)
       select e.service, case when status='failed' then 'failed' when status is null and cast(substr(hh,1,2) as int)*60+cast(substr(hh,4,2) as int)+30 <= 20*60 then 'missing' end as issue from e left join l using (service)
       where status='failed' or (status is null and cast(substr(hh,1,2) as int)*60+cast(substr(hh,4,2) as int)+30 <= 20*60)""")
def _dq03(t):
    exp = t.spark.createDataFrame(EXPECTED, "service string, hhmm string")
    return Q.run_issues(t.runs, exp, F.to_timestamp(F.lit("2024-01-15 20:00:00")))


@query("dq04_recurring_failures", "service:s failures:l", "select service, count(*) as failures from runs where status='failed' and run_date between date '2024-01-30'-7 and date '2024-01-30' group by 1 having count(*)>=3")
def _dq04(t):
    return Q.recurring_failures(t.runs, day("2024-01-30"), 7, 3)


@query("dq05_readiness", "check_name:s ok:i detail:s",
       """select 'bars' as check_name, case when max(date) >= date '2001-10-01' then 1 else 0 end as ok, cast(max(date) as varchar) as detail from bars union all select 'runs', case when count(*) filter (where status='failed') = 0 then 1 else 0 end, cast(count(*) filter (where status='failed') as varchar) from runs
       union all select 'outcomes', case when count(*) > 0 then 1 else 0 end, cast(count(*) as varchar) from outcomes""")
def _dq05(t):
    return Q.readiness({
        "bars": (t.bars, F.max("date") >= day("2001-10-01"), F.max("date")),
        "runs": (t.runs, F.count_if(F.col("status") == "failed") == 0, F.count_if(F.col("status") == "failed")),
        "outcomes": (t.outcomes, F.count(F.lit(1)) > 0, F.count(F.lit(1)))})


@query("dq06_upstream_ready", "service:s status:s ready:i",
       """with r as (select service, max_by(status, started_at) as status, max_by(rows_written, started_at) as n from runs where run_date between date '2024-01-30'-3 and date '2024-01-30' group by 1), w(service) as (values ('click'),('view'),('nightly'))
       select w.service, status, case when status='success' and n>0 then 1 else 0 end as ready from w left join r using (service)""")
def _dq06(t):
    return Q.upstream_ready(t.runs, ["click", "view", "nightly"], day("2024-01-30"))


@query("dq07_traffic_light", "label:s age:i light:s", "with a as (select scheme_code as label, date '2001-12-31'-max(date) as age from nav group by 1) select *, case when age<=1 then 'green' when age<=4 then 'yellow' else 'red' end as light from a")
def _dq07(t):
    f = Q.freshness(t.nav, "scheme_code", "date", day("2001-12-31"), 4)
    return f.select("label", F.col("days_stale").alias("age"), Q.traffic_light(F.col("days_stale")).alias("light"))


@query("rpt01_daily_pnl", "symbol:l exit_date:d pnl:2 trades:l cum_pnl:2 drawdown:2",
       """with d as (select symbol, exit_date, sum(pnl_pts) as pnl, count(*) as trades from outcomes group by 1,2), c as (select *, sum(pnl) over (partition by symbol order by exit_date) as cum_pnl from d)
       select *, max(cum_pnl) over (partition by symbol order by exit_date)-cum_pnl as drawdown from c""")
def _rpt01(t):
    return R.daily_pnl(t.outcomes)


@query("rpt02_by_days_to_expiry", "dte:i s0:4 s1:4 s2:4 s3:4",
       "select expiry-entry_date as dte, " + ", ".join(f"avg(pnl_pts) filter (where symbol={i}) as s{i}" for i in range(4)) + " from outcomes group by 1")
def _rpt02(t):
    return R.pivot_dte(R.by_days_to_expiry(t.outcomes), [0, 1, 2, 3]).withColumnsRenamed({str(i): f"s{i}" for i in range(4)})


@query("rpt03_net_by_period", "period:s trades:l gross:2 cost:2 net:2",
       """with c as (select exit_date, pnl_pts*lot_size*lots as g, floor((floor(4*20*1.18::double*100.0::double+0.5)/100.0::double+floor(entry_premium*0.0005::double*lot_size*lots*2*100.0::double+0.5)/100.0::double+floor((entry_premium+0.0::double)*lot_size*lots*0.0005::double*2*100.0::double+0.5)/100.0::double)*100.0::double+0.5)/100.0::double as k from outcomes),
       p as (select 'all' as period, * from c union all select 'today', * from c where exit_date=date '2024-01-25' union all select 'week', * from c where exit_date>date '2024-01-25'-7 union all select 'month', * from c where exit_date>=date '2024-01-01')
       select period, count(*) as trades, sum(g) as gross, sum(k) as cost, sum(g)-sum(k) as net from p group by 1""")
def _rpt03(t):
    return R.net_by_period(t.outcomes, day("2024-01-25"))


@query("rpt04_breakdown", "dimension:s value:s trades:l win_rate:4 pnl:2",
       """select 'exit_reason' as dimension, exit_reason as value, count(*) as trades, avg(case when pnl_pts>0 then 1 else 0 end)*100 as win_rate, sum(pnl_pts) as pnl from outcomes group by 2
       union all select 'symbol', cast(symbol as varchar), count(*), avg(case when pnl_pts>0 then 1 else 0 end)*100, sum(pnl_pts) from outcomes group by 2""")
def _rpt04(t):
    return R.breakdown(t.outcomes, "exit_reason").unionByName(R.breakdown(t.outcomes, "symbol"))


@query("rpt05_regime_split", "symbol:l bull:l bear:l sideways:l",
       """with b as (select date + 9131 as date, close from bench), r as (select date, close/lag(close,20) over (order by date)-1 as r from b)
       select symbol, count(*) filter (where r>0.03) as bull, count(*) filter (where r < -0.03) as bear, count(*) filter (where r between -0.03 and 0.03) as sideways from outcomes left join r on r.date=entry_date group by 1""")
def _rpt05(t):
    # The bars end before the trades begin; shift them onto the same days.
    return R.regime_split(t.outcomes, t.bench.withColumn("date", F.date_add("date", 9131)))


@query("rpt06_drift_table", "feature_name:s symbol:l corr_30d:2 corr_60d:2 corr_90d:2 baseline:2 drifted:i",
       """with p as (select exit_reason as feature_name, symbol, (trade_id%3+1)*30 as w, trade_id as c, pnl_pts as r, conf as b, case when trade_id%97=0 then 1 else 0 end as d from outcomes)
       select feature_name, symbol, max_by(r,c) filter (where w=30) as corr_30d, max_by(r,c) filter (where w=60) as corr_60d, max_by(r,c) filter (where w=90) as corr_90d, max_by(b,c) filter (where w=90) as baseline, max(d) as drifted from p group by 1,2""")
def _rpt06(t):
    p = t.outcomes.select(F.col("exit_reason").alias("feature_name"), "symbol", ((F.col("trade_id") % 3 + 1) * 30).alias("window_days"), F.col("trade_id").alias("computed_at"),
                          F.col("pnl_pts").alias("correlation"), F.col("conf").alias("baseline_corr"), F.when(F.col("trade_id") % 97 == 0, 1).otherwise(0).alias("drift_detected"))
    return R.drift_table(p)


@query("rpt07_rolling_win_rate", "symbol:l exit_date:d wins:l total:l rolling_wr:6",
       """with d as (select symbol, exit_date, count(*) filter (where pnl_pts>=0) as wins, count(*) as total from outcomes group by 1,2) select *, sum(wins) over v/(sum(total) over v)::double as rolling_wr from d window v as (partition by symbol order by exit_date rows 9 preceding)""")
def _rpt07(t):
    return R.rolling_win_rate(t.outcomes)


@query("rpt08_edge_summaries", "dimension:s value:s n:l avg_pnl:4 win_rate:4",
       """with q as (select quantile_cont(conf,0.25) as a, quantile_cont(conf,0.5) as b, quantile_cont(conf,0.75) as c from outcomes), d as (select *, 'Q'||(1+(conf>a)::int+(conf>b)::int+(conf>c)::int) as qq, dayname(exit_date)[1:3] as wd from outcomes, q)
       select 'quartile' as dimension, qq as value, count(*) as n, avg(pnl_pts) as avg_pnl, avg(case when pnl_pts>0 then 1 else 0 end)*100 as win_rate from d group by 2 union all select 'weekday', wd, count(*), avg(pnl_pts), avg(case when pnl_pts>0 then 1 else 0 end)*100 from d group by 2""")
def _rpt08(t):
    from tidebook.operators.running import exact_quantiles
    q = exact_quantiles(t.outcomes, [], "conf", {"a": 0.25, "b": 0.5, "c": 0.75})
    d = attach_row(t.outcomes, q)
    up = sum(((F.col("conf") > F.col(x)).cast("int") for x in "abc"), F.lit(1))
    d = d.withColumn("quartile", F.concat(F.lit("Q"), up.cast("string"))).withColumn("weekday", F.date_format("exit_date", "EEE"))
    def one(dim):
        return d.groupBy(F.lit(dim).alias("dimension"), F.col(dim).alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("pnl_pts").alias("avg_pnl"), (F.avg(F.when(F.col("pnl_pts") > 0, 1).otherwise(0)) * 100).alias("win_rate"))
    return one("quartile").unionByName(one("weekday"))


@query("rpt09_latest_per_symbol", "symbol:s date:d close:4 band:s",
       "select symbol, max(date) as date, max_by(close,date) as close, case when max_by(close,date)<2000 then 'low' when max_by(close,date)<6000 then 'mid' else 'high' end as band from bars group by 1")
def _rpt09(t):
    return latest_by(t.bars, ["symbol"], ["date"]).withColumn("band", bucket_label("close", [2000, 6000], ["low", "mid", "high"]))


@query("rpt10_daily_levels", "date:d vix:1 spot:2", "select date, max(vix) as vix, max(spot) as spot from vix where date > date '2001-06-30'-365 group by 1")
def _rpt10(t):
    return R.daily_levels(t.vix, day("2001-06-30"))


@query("rpt11_stage_counts", "symbol:l backtest:l holdout:l live:l",
       "select symbol, count(*) filter (where exit_date<date '2024-01-11') as backtest, count(*) filter (where exit_date>=date '2024-01-11' and exit_date<date '2024-01-21') as holdout, count(*) filter (where exit_date>=date '2024-01-21') as live from outcomes group by 1")
def _rpt11(t):
    return R.stage_counts(t.outcomes, day("2024-01-11"), day("2024-01-21"))


@query("rpt12_top_attributions", "trade_id:l feature_name:s attribution:2 rank:i",
       """with a as (select trade_id, unnest(['k','premium','pnl']) as feature_name, unnest([conf-50, entry_premium-60, pnl_pts]) as attribution from outcomes where pnl_pts<0) select * from (select *, row_number() over (partition by trade_id order by abs(attribution) desc, feature_name) as rank from a) q where rank<=2""")
def _rpt12(t):
    s = lambda n, c: F.struct(F.lit(n).alias("feature_name"), c.alias("attribution"))
    a = t.outcomes.where("pnl_pts < 0").select("trade_id", F.explode(F.array(s("k", F.col("conf") - 50), s("premium", F.col("entry_premium") - 60), s("pnl", F.col("pnl_pts")))).alias("_s")).select("trade_id", "_s.*")
    return R.top_attributions(a, 2)


@query("rpt13_run_history", "service:s started_at:t status:s duration_s:l runs:l avg_duration_s:4",
       "with d as (select *, version % 600 as ds from runs) select service, max(started_at) as started_at, max_by(status,started_at) as status, max_by(ds,started_at) as duration_s, count(*) as runs, avg(ds) as avg_duration_s from d group by 1")
def _rpt13(t):
    return R.run_history(t.runs)


