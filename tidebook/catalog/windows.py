"""Window-function queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.catalog.fragments import RSI_EMA
from tidebook.catalog.registry import query
from tidebook.functions.exprs import flag, pct_change
from tidebook.operators import recursive as RC
from tidebook.operators import rolling as RO
from tidebook.operators import running as RU
from tidebook.operators.asof import asof_join
from tidebook.operators.stats import minmax_norm, quantile_bins, top_n
from tidebook.plans import funds as FU

S = RO.Series(["symbol"])
W_ = "window w as (partition by symbol order by date)"


def win(name, out, sql):
    return query(name, f"symbol:s date:d {out}", sql)


@win("win01_lag_change", "prev_close:4 pct:4",
     f"select symbol, date, lag(close) over w as prev_close, (close-lag(close) over w)/lag(close) over w*100 as pct from bars {W_}")
def _win01(t):
    return t.bars.withColumn("prev_close", S.lag("close")).withColumn("pct", pct_change("close", "prev_close"))


@win("win02_lead_label", "c1:4 c3:4 c5:4", f"select symbol, date, lead(close,1) over w as c1, lead(close,3) over w as c3, lead(close,5) over w as c5 from bars {W_}")
def _win02(t):
    return t.bars.withColumns({f"c{n}": S.lead("close", n) for n in (1, 3, 5)})


@query("win03_lag20_regime", "date:d ret20:6", "select date, close/lag(close,20) over (order by date) - 1 as ret20 from bench")
def _win03(t):
    w = W.partitionBy(F.lit(0)).orderBy("date")
    return t.bench.select("date", (F.col("close") / F.lag("close", 20).over(w) - 1).alias("ret20"))


@query("win04_row_number_best", "symbol:s date:d close:4", "select symbol, date, close from (select *, row_number() over (partition by symbol order by close desc, date) as k from bars) z where k = 1")
def _win04(t):
    return top_n(t.bars, ["symbol"], [F.col("close").desc(), F.col("date")], 1)


@win("win05_sma", "sma_20:7 sma_50:7 sma_200:7",
     "select symbol, date, " + ", ".join(f"case when count(*) over (partition by symbol order by date rows {n-1} preceding) >= {n} then avg(close) over (partition by symbol order by date rows {n-1} preceding) end as sma_{n}" for n in (20, 50, 200)) + " from bars")
def _win05(t):
    return t.bars.withColumns({f"sma_{n}": S.sma("close", n) for n in (20, 50, 200)})


@win("win06_ema", "ema_20:4", f"with recursive {RSI_EMA} select b0.symbol, b0.date, case when b0.rn >= 20 then em.ema20 end as ema_20 from b0 join em using (symbol, rn)")
def _win06(t):
    return RC.ema(t.bars, ["symbol"], "date", "close", [20])


@win("win07_rsi", "rsi_14:4 rsi_5:4",
     f"""with recursive {RSI_EMA} select b0.symbol, b0.date, case when b0.rn >= 15 and al14 > 0 then 100-100/(1+ag14/al14) else 0 end as rsi_14,
     case when b0.rn >= 6 and al5 > 0 then 100-100/(1+ag5/al5) else 0 end as rsi_5 from b0 left join rs using (symbol, rn)""")
def _win07(t):
    return RC.rsi(t.bars, ["symbol"], "date", "close", [14, 5])


@win("win08_crossover", "cross_20:i",
     f"""with d as (select symbol, date, close - case when count(*) over v >= 20 then avg(close) over v end as x from bars window v as (partition by symbol order by date rows 19 preceding))
     select symbol, date, case when lag(x) over w < 0 and x >= 0 then 1 when lag(x) over w > 0 and x <= 0 then -1 else 0 end as cross_20 from d {W_}""")
def _win08(t):
    return RO.crossover(t.bars.withColumn("_m", S.sma("close", 20)), S, "close", "_m", "cross_20")


@win("win09_distance_from_sma", "dist:4",
     "select symbol, date, case when count(*) over v >= 50 then (close-avg(close) over v)/avg(close) over v*100 else 0 end as dist from bars window v as (partition by symbol order by date rows 49 preceding)")
def _win09(t):
    return t.bars.withColumn("dist", S.vs_sma("close", 50))


@win("win10_volume_zscore", "z20:4",
     """select symbol, date, case when row_number() over w >= 21 and stddev_samp(volume) over v > 0 then (volume-avg(volume) over v)/stddev_samp(volume) over v else 0 end as z20
     from bars window v as (partition by symbol order by date rows 19 preceding), w as (partition by symbol order by date)""")
def _win10(t):
    return t.bars.withColumn("z20", S.zscore("volume", 20))


@win("win11_volume_trend", "trend:s",
     """select symbol, date, case when row_number() over w < 20 then 'flat' when avg(volume) over v5/avg(volume) over v > 1.1 then 'expanding' when avg(volume) over v5/avg(volume) over v < 0.9 then 'contracting' else 'flat' end as trend
     from bars window v as (partition by symbol order by date rows 19 preceding), v5 as (partition by symbol order by date rows 4 preceding), w as (partition by symbol order by date)""")
def _win11(t):
    return t.bars.withColumn("trend", RO.volume_trend(S, "volume"))


_TR = f"tr as (select *, greatest(high-low, abs(high-lag(close) over w), abs(low-lag(close) over w)) as tr, row_number() over w as rn from bars {W_})"


@win("win12_atr", "true_range:4 atr_14:4",
     f"with {_TR} select symbol, date, tr as true_range, case when rn >= 15 then avg(tr) over (partition by symbol order by date rows 13 preceding) else 0 end as atr_14 from tr")
def _win12(t):
    d = t.bars.withColumn("true_range", S.true_range())
    return d.withColumn("atr_14", F.when(S.row_number() >= 15, F.avg("true_range").over(S.rows(14))).otherwise(0.0))


@win("win13_bollinger", "pos:4",
     """select symbol, date, case when count(*) over v >= 20 and stddev_samp(close) over v > 0 then greatest(0.0,least(1.0,(close-(avg(close) over v-2*stddev_samp(close) over v))/(4*stddev_samp(close) over v))) else 0.5 end as pos
     from bars window v as (partition by symbol order by date rows 19 preceding)""")
def _win13(t):
    return t.bars.withColumn("pos", S.bollinger("close"))


@win("win14_n_row_return", "r5:4 r20:4", f"select symbol, date, (close-lag(close,5) over w)/lag(close,5) over w*100 as r5, (close-lag(close,20) over w)/lag(close,20) over w*100 as r20 from bars {W_}")
def _win14(t):
    return t.bars.withColumns({"r5": S.ret("close", 5), "r20": S.ret("close", 20)})


@win("win15_drawdown_252", "dd:4", "select symbol, date, (max(close) over v-close)/max(close) over v*100 as dd from bars window v as (partition by symbol order by date rows 251 preceding)")
def _win15(t):
    return t.bars.withColumn("dd", S.drawdown("close"))


@win("win16_all_time_high", "ath:4 dd:4", f"select symbol, date, max(close) over w as ath, (max(close) over w-close)/max(close) over w*100 as dd from bars {W_}")
def _win16(t):
    d = t.bars.withColumn("ath", F.max("close").over(S.all_before()))
    return d.withColumn("dd", (F.col("ath") - F.col("close")) / F.col("ath") * 100)


@query("win17_running_max_drawdown", "scheme_code:l date:d max_dd:4",
       """with d as (select *, (max(nav) over (partition by scheme_code order by date)-nav)/max(nav) over (partition by scheme_code order by date)*100 as dd from nav)
       select scheme_code, date, max(dd) over (partition by scheme_code order by date) as max_dd from d""")
def _win17(t):
    return FU.risk(t.nav, t.bench).withColumnRenamed("max_drawdown_pct", "max_dd")


@win("win18_iv_rank_percentile", "rank:4 pctile:4",
     """with l as (select symbol, date, close, list(close) over v as a, min(close) over v as lo, max(close) over v as hi from bars window v as (partition by symbol order by date rows 251 preceding))
     select symbol, date, case when hi>lo then (close-lo)/(hi-lo)*100 else 50 end as rank, len(list_filter(a, lambda x: x < close))/len(a)::double*100 as pctile from l""")
def _win18(t):
    return t.bars.withColumns({"rank": S.minmax_rank("close"), "pctile": S.share_below("close")})


@win("win19_percentile_rank", "pr:4",
     """with l as (select symbol, date, close, list(close) over v as a from bars window v as (partition by symbol order by date rows 251 preceding))
     select symbol, date, case when len(a) >= 20 then (len(list_filter(a, lambda x: x < close)) + (len(list_filter(a, lambda x: x = close))+1)/2.0::double)/len(a)*100 end as pr from l""")
def _win19(t):
    return t.bars.withColumn("pr", S.pct_rank("close"))


@win("win20_historical_volatility", "hv5:3 hv20:3 ratio:4",
     f"""with r as (select symbol, date, close/lag(close) over w-1 as r from bars {W_}), h as (select symbol, date, case when count(r) over a >= 5 then stddev_samp(r) over a*sqrt(252)*100 end as hv5,
     case when count(r) over b >= 20 then stddev_samp(r) over b*sqrt(252)*100 end as hv20 from r window a as (partition by symbol order by date rows 4 preceding), b as (partition by symbol order by date rows 19 preceding))
     select *, hv5/nullif(hv20,0) as ratio from h""")
def _win20(t):
    d = t.bars.withColumn("_r", F.col("close") / S.lag("close") - 1)
    k = 252**0.5 * 100
    d = d.withColumn("hv5", S.std("_r", 5) * k).withColumn("hv20", S.std("_r", 20) * k)
    return d.withColumn("ratio", F.col("hv5") / F.nullif("hv20", F.lit(0.0)))


RISK_SQL = """rb as (select n.*, b.close as bc from nav n left join bench b using (date)),
r0 as (select scheme_code, date, nav, ln(nav/lag(nav) over w) as r, ln(bc/lag(bc) over w) as b, row_number() over w as rn, nav > lag(nav,252) over w as up from rb window w as (partition by scheme_code order by date)),
r1 as (select *, r-(pow(1.065,1.0/252)-1) as x from r0),
rk as (select scheme_code, date, case when count(r) over v >= 252 then stddev_samp(r) over v*sqrt(252)*100 else 0 end as volatility_1y,
  case when count(x) over v >= 252 then avg(x) over v/nullif(stddev_samp(x) over v,0)*sqrt(252) else 0 end as sharpe_1y,
  coalesce(case when count(x) over v >= 252 then avg(x) over v/nullif(stddev_samp(case when x<0 then x end) over v,0)*sqrt(252) end,0) as sortino_1y,
  case when rn > 252 and count(case when r is not null then b end) over p >= 126 and var_samp(case when r is not null then b end) over p >= 1e-12 then covar_samp(r,b) over p/var_samp(case when r is not null then b end) over p else 0 end as beta_vs_nifty,
  case when rn >= 252 then avg(case when up then 1.0::double else 0 end) over c*100 else 0 end as consistency_score
  from r1 window v as (partition by scheme_code order by date rows 251 preceding), p as (partition by scheme_code order by date rows between 252 preceding and 1 preceding), c as (partition by scheme_code order by date rows 755 preceding))"""


@query("win21_rolling_sharpe_sortino", "scheme_code:l date:d volatility_1y:4 sharpe_1y:4 sortino_1y:4", f"with {RISK_SQL} select * from rk")
def _win21(t):
    return FU.risk(t.nav, t.bench)


@query("win22_rolling_beta", "scheme_code:l date:d beta_vs_nifty:4", f"with {RISK_SQL} select * from rk")
def _win22(t):
    return FU.risk(t.nav, t.bench)


@query("win23_consistency", "scheme_code:l date:d consistency_score:4", f"with {RISK_SQL} select * from rk")
def _win23(t):
    return FU.risk(t.nav, t.bench)


_ST = f"""{_TR},
aw as (select symbol, rn, tr as a7, tr as a14 from tr where rn = 1 union all
       select tr.symbol, tr.rn, aw.a7+(tr.tr-aw.a7)/7.0, aw.a14+(tr.tr-aw.a14)/14.0 from aw join tr on tr.symbol=aw.symbol and tr.rn=aw.rn+1),
bd as (select tr.symbol, tr.rn, tr.date, tr.close, (high+low)/2+3*a7 as bu, (high+low)/2-3*a7 as bl from tr join aw using (symbol, rn)),
st as (select symbol, rn, date, close, bu as up, bl as dn, 1.0::double as side from bd where rn = 1 union all
       select bd.symbol, bd.rn, bd.date, bd.close, case when bd.bu < st.up or st.close > st.up then bd.bu else st.up end, case when bd.bl > st.dn or st.close < st.dn then bd.bl else st.dn end,
       case when bd.close > st.up then 1.0::double when bd.close < st.dn then -1.0::double else st.side end from st join bd on bd.symbol=st.symbol and bd.rn=st.rn+1)"""


@win("win24_supertrend", "supertrend_dir:0", f"with recursive {_ST} select symbol, date, side as supertrend_dir from st")
def _win24(t):
    d = t.bars.withColumn("_tr", S.true_range())
    d = RC.ewm_mean(d, ["symbol"], "date", {"_a7": ("_tr", 1.0 / 7, 1)})
    return RC.supertrend(d.select("symbol", "date", "high", "low", "close", "_a7"), ["symbol"], "date", "_a7")


@win("win25_adx", "adx14:4",
     f"""with recursive {_TR},
     dm as (select *, case when high-lag(high) over w > lag(low) over w-low and high-lag(high) over w > 0 then high-lag(high) over w else 0 end as dp,
            case when lag(low) over w-low > high-lag(high) over w and lag(low) over w-low > 0 then lag(low) over w-low else 0 end as dn from tr {W_}),
     e as (select symbol, rn, tr as a, dp::double as p, dn::double as n from dm where rn = 1 union all
           select dm.symbol, dm.rn, e.a+(dm.tr-e.a)/14.0, e.p+(dm.dp-e.p)/14.0, e.n+(dm.dn-e.n)/14.0 from e join dm on dm.symbol=e.symbol and dm.rn=e.rn+1),
     x as (select symbol, rn, case when a > 0 and p+n > 0 then 100*abs(p-n)/(p+n) end as dx from e),
     y as (select symbol, rn, dx as v from x where rn = 1 union all
           select x.symbol, x.rn, case when y.v is null then x.dx else y.v*(1-1/14.0::double)+x.dx*(1/14.0::double) end from y join x on x.symbol=y.symbol and x.rn=y.rn+1)
     select tr.symbol, tr.date, case when v is not null then greatest(0.0,least(100.0,v)) end as adx14 from tr join y using (symbol, rn)""")
def _win25(t):
    return RC.adx(t.bars, ["symbol"], "date")


_WK = """wk as (select symbol, cast(date_trunc('week', date+3) as date)+3 as week, max(high) as h, min(low) as l, max_by(close,date) as c from bars group by 1,2),
cp as (select symbol, week, lag((h-l)/2/((h+l+c)/3)*100) over (partition by symbol order by week) as cpr from wk)"""


@win("win26_prev_week_pivot_width", "cpr:4", f"with {_WK} select b.symbol, b.date, cp.cpr from bars b asof left join cp on cp.symbol=b.symbol and b.date >= cp.week")
def _win26(t):
    from tidebook.plans.scoring import weekly_pivot_width
    return asof_join(t.bars.select("symbol", "date"), weekly_pivot_width(t.bars), ["symbol"], "date", "week", ["cpr"])


@win("win27_forward_fill", "filled:2",
     f"with z as (select symbol, date, case when extract(day from date) % 3 = 0 then volume else 0 end as v from bars) select symbol, date, coalesce(last_value(nullif(v,0) ignore nulls) over w,0) as filled from z {W_}")
def _win27(t):
    d = t.bars.withColumn("_v", F.when(F.dayofmonth("date") % 3 == 0, F.col("volume")).otherwise(0.0))
    return RO.fill_forward(d, ["symbol"], "date", "_v", "filled")


@query("win28_year_to_date", "scheme_code:l date:d ytd:4",
       "select scheme_code, date, (nav-first_value(nav) over w)/first_value(nav) over w*100 as ytd from nav window w as (partition by scheme_code, extract(year from date) order by date)")
def _win28(t):
    y = W.partitionBy("scheme_code", F.year("date")).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return t.nav.withColumn("ytd", pct_change("nav", F.first("nav").over(y)))


@query("win29_equity_curve", "symbol:l trade_id:l cum:2 peak:2 drawdown:2",
       """with c as (select symbol, trade_id, sum(pnl_pts) over (partition by symbol order by trade_id) as cum from outcomes), p as (select *, max(cum) over (partition by symbol order by trade_id) as peak from c)
       select *, peak-cum as drawdown from p""")
def _win29(t):
    return RU.equity_curve(t.outcomes.select("symbol", "trade_id", "exit_date", "pnl_pts"), ["symbol"], ["trade_id"], "exit_date", "pnl_pts")


@query("win30_streaks", "symbol:l longest_loss:l streak_type:s streak:l",
       """with f as (select symbol, trade_id, case when pnl_pts > 0 then 1 else 0 end as w, row_number() over (partition by symbol order by trade_id) as r from outcomes),
       g as (select *, r - row_number() over (partition by symbol, w order by trade_id) as grp from f), l as (select symbol, w, grp, count(*) as n, max(r) as last from g group by 1,2,3)
       select symbol, max(n) filter (where w=0) as longest_loss, case when arg_max(w,last)=1 then 'W' else 'L' end as streak_type, arg_max(n,last) as streak from l group by 1""")
def _win30(t):
    d = t.outcomes.withColumn("win", flag(F.col("pnl_pts") > 0))
    a = RU.longest_run(d, ["symbol"], ["trade_id"], "exit_date", F.col("win") == 0, "longest_loss")
    return a.join(RU.current_streak(d, ["symbol"], ["trade_id"], "win"), "symbol")


@query("win31_flow_sums", "entity:s date:d s3:1 s5:1 s10:1 prev3:1",
       """select entity, date, sum(net_value) over (partition by entity order by date rows 2 preceding) as s3, sum(net_value) over (partition by entity order by date rows 4 preceding) as s5,
       sum(net_value) over (partition by entity order by date rows 9 preceding) as s10, sum(net_value) over (partition by entity order by date rows between 3 preceding and 1 preceding) as prev3 from flows""")
def _win31(t):
    s = RO.Series(["entity"])
    return t.flows.withColumns({**{f"s{n}": F.sum("net_value").over(s.rows(n)) for n in (3, 5, 10)}, "prev3": F.sum("net_value").over(s.w.rowsBetween(-3, -1))})


_RW = """with d as (select symbol, exit_date, count(*) filter (where pnl_pts >= 0) as wins, count(*) as total from outcomes group by 1,2)
    select symbol, exit_date, sum(wins) over v/sum(total) over v::double as rolling_wr from d window v as (partition by symbol order by exit_date rows 9 preceding)"""


@query("win32_rolling_win_rate", "symbol:l exit_date:d rolling_wr:6", _RW)
def _win32(t):
    from tidebook.plans.reports import rolling_win_rate
    return rolling_win_rate(t.outcomes)


@query("win33_vix_zscore", "date:d z:4",
       """select date, case when count(*) over v >= 20 then (vix-avg(vix) over v)/coalesce(nullif(stddev_samp(vix) over v,0),1) end as z from vix window v as (order by date rows 19 preceding)""")
def _win33(t):
    s = RO.Series(["_k"])
    v = t.vix.withColumn("_k", F.lit(0))
    sd = F.coalesce(F.nullif(s.std("vix", 20), F.lit(0.0)), F.lit(1.0))
    return v.withColumn("z", (F.col("vix") - s.sma("vix", 20)) / sd)


@query("win34_change_events", "symbol:s effective_from:d lot_size:i",
       "select * from (select *, lag(lot_size) over (partition by symbol order by effective_from) as p from lots) z where p is null or p <> lot_size")
def _win34(t):
    return RO.change_events(t.lots, ["symbol"], "effective_from", "lot_size")


@query("win35_index_to_100", "scheme_code:l date:d idx:4", "select scheme_code, date, nav/first_value(nav) over (partition by scheme_code order by date)*100 as idx from nav")
def _win35(t):
    return t.nav.withColumn("idx", F.col("nav") / F.first("nav").over(FU.S.all_before()) * 100)


@query("win36_quintiles", "date:d symbol:s quintile:i",
       """with e as (select date, quantile_cont(close,[0.2,0.4,0.6,0.8]) as q from bars group by 1 having count(*) >= 10)
       select b.date, b.symbol, 1+len(list_filter(q, lambda x: x < b.close)) as quintile from bars b join e using (date)""")
def _win36(t):
    n = t.bars.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 10")
    return quantile_bins(t.bars.join(n, "date", "left_semi"), ["date"], "close", 5, "quintile")


@query("win37_minmax_normalise", "date:d symbol:s n_close:6 n_volume:6",
       """select date, symbol, coalesce((close-min(close) over w)/nullif(max(close) over w-min(close) over w,0),0.5) as n_close,
       coalesce((volume-min(volume) over w)/nullif(max(volume) over w-min(volume) over w,0),0.5) as n_volume from bars window w as (partition by date)""")
def _win37(t):
    return minmax_norm(t.bars, ["date"], ["close", "volume"])
