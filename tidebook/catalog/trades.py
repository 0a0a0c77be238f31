"""Strategy trade tables and feedback on closed trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.fragments import norm_cdf
from tidebook.catalog.options import G, legs, signals_sql
from tidebook.catalog.registry import query
from tidebook.functions.exprs import bucket_label
from tidebook.operators import stats as ST
from tidebook.plans import backtests as B
from tidebook.plans import feedback as FB
from tidebook.plans import options as O
from tidebook.plans import patterns as P

STEP, MIN_OI = 50.0, 1000


def liquid_sql(src: str, p: str) -> str:
    """Liquid at-the-money strike of every snapshot, as CTE ``{p}lq``."""
    return f"""{p}lg as (select symbol, snap_date, expiry, strike, max(ltp) filter (where option_type='CE') as ce, max(ltp) filter (where option_type='PE') as pe, max(oi) filter (where option_type='CE') as co, max(oi) filter (where option_type='PE') as po from {src} group by 1,2,3,4),
{p}sp as (select symbol, snap_date, expiry, arg_min(strike+ce-pe, abs(ce-pe)*1000000+strike) as spot from {p}lg where ce is not null and pe is not null group by 1,2,3),
{p}th as (select l.symbol, l.snap_date, l.expiry, any_value(spot) as spot, coalesce(max(case when strike = round_even(spot/50,0)*50 then strike end), arg_min(strike, abs(strike-spot)*1000000+strike)) as theo from {p}lg l join {p}sp using ({G}) group by 1,2,3),
{p}cand as (select l.*, t.theo, (l.strike-theo)/50 as off, row_number() over (partition by l.symbol, l.snap_date, l.expiry order by co+po desc, case when l.strike > theo then 2*(l.strike-theo)/50-1 else -2*(l.strike-theo)/50 end) as z from {p}lg l join {p}th t using ({G})
  where abs(l.strike-theo) <= 150 and co >= {MIN_OI} and po >= {MIN_OI}),
{p}lq as (select t.symbol, t.snap_date, t.expiry, t.spot, coalesce(c.strike, t.theo) as atm_strike, coalesce(case when c.strike is not null then c.ce+c.pe else f.ce+f.pe end, 0) as straddle,
  coalesce(case when c.strike is not null then c.co else f.co end,0)::double as oi_ce, coalesce(case when c.strike is not null then c.po else f.po end,0)::double as oi_pe, case when c.strike is not null then 1 else 0 end as liquidity_ok
  from {p}th t left join {p}cand c on c.symbol=t.symbol and c.snap_date=t.snap_date and c.expiry=t.expiry and c.z=1 left join {p}lg f on f.symbol=t.symbol and f.snap_date=t.snap_date and f.expiry=t.expiry and f.strike=t.theo)"""


EDGE_SQL = "t1 as (select symbol, expiry, max(snap_date) as snap_date from chain_d where snap_date < expiry group by 1,2), d1 as (select c.* from chain_d c join t1 using (symbol, expiry, snap_date)), " + liquid_sql("d1", "a") + """,
xl as (select symbol, expiry, strike, max(ltp) filter (where option_type='CE') + max(ltp) filter (where option_type='PE') as px from chain_d where snap_date=expiry group by 1,2,3),
e0 as (select q.*, coalesce(s.spot_expiry,0) as se, x.px from alq q left join settle_d s on s.symbol=q.symbol and s.expiry=q.expiry left join xl x on x.symbol=q.symbol and x.expiry=q.expiry and x.strike=q.atm_strike),
e1 as (select *, case when se>0 then coalesce(px, abs(se-atm_strike)) else 0 end as exit_1dte from e0),
bs as (select symbol, expiry, arg_max(strike, pct*1000000-strike/1000000) as best_strike, max(pct) as best_profit_pct from (select l.symbol, l.expiry, l.strike, (ce+pe-abs(l.strike-case when se>0 then se else spot end))/(ce+pe)*100 as pct
  from alg l join e1 on e1.symbol=l.symbol and e1.expiry=l.expiry and e1.snap_date=l.snap_date where ce+pe >= 5 and abs(l.strike-round_even(spot/50,0)*50) <= 300) z group by 1,2),
ee as (select e1.*, straddle-exit_1dte as profit_1dte_pts, coalesce((straddle-exit_1dte)*100/nullif(straddle,0),0) as profit_1dte_pct, straddle/spot*100 as implied_move_pct, case when se>0 then abs(se-spot)/spot*100 else 0 end as realized_move_pct,
  case when straddle-exit_1dte > 0 then 1 else 0 end as win_1dte, coalesce(best_strike, round_even(spot/50,0)*50) as best_strike, coalesce(best_profit_pct,0) as best_profit_pct from e1 left join bs using (symbol, expiry))"""


def _edge(t):
    return B.expiry_edge(t.chain_d, t.settle_d, STEP, MIN_OI)


@query("bkt01_expiry_edge", "symbol:l expiry:d t1_date:d spot:2 atm_strike:1 straddle:2 exit_1dte:2 profit_1dte_pts:2 profit_1dte_pct:3 win_1dte:i implied_move_pct:5 realized_move_pct:5 vrp:5 best_strike:1 best_profit_pct:3 liquidity_ok:i",
       f"with {EDGE_SQL} select *, snap_date as t1_date, implied_move_pct-realized_move_pct as vrp from ee")
def _bkt01(t):
    return _edge(t)


@query("bkt02_liquid_atm", "symbol:l snap_date:d expiry:d spot:2 atm_strike:1 straddle:2 oi_ce:0 oi_pe:0 liquidity_ok:i", f"with {liquid_sql('chain_d', 'a')} select * from alq")
def _bkt02(t):
    return B.liquid_atm(t.chain_d, STEP, MIN_OI)


@query("bkt03_weekend_decay", "symbol:l expiry:d friday:d monday:d atm_strike:1 entry:2 exit_mon:2 profit_mon_pts:2 profit_mon_pct:3 win_mon:i exit_exp:2 profit_exp_pts:2 win_exp:i gap_pct:5",
       f"""with {liquid_sql('chain_d', 'a')}, tp as (select expiry, cast(date_trunc('week', expiry-1) as date)-3 as friday, cast(date_trunc('week', expiry-1) as date) as monday from (select distinct expiry from chain_d) z)
       select f.symbol, f.expiry, tp.friday, tp.monday, f.atm_strike, f.straddle as entry, m.straddle as exit_mon, f.straddle-m.straddle as profit_mon_pts, (f.straddle-m.straddle)/f.straddle*100 as profit_mon_pct, case when f.straddle>m.straddle then 1 else 0 end as win_mon,
       case when coalesce(spot_expiry,0)>0 then abs(spot_expiry-f.atm_strike) else m.straddle end as exit_exp, f.straddle-case when coalesce(spot_expiry,0)>0 then abs(spot_expiry-f.atm_strike) else m.straddle end as profit_exp_pts,
       case when f.straddle>case when coalesce(spot_expiry,0)>0 then abs(spot_expiry-f.atm_strike) else m.straddle end then 1 else 0 end as win_exp, (m.spot-f.spot)/f.spot*100 as gap_pct
       from tp join alq f on f.snap_date=tp.friday and f.expiry=tp.expiry join alq m on m.symbol=f.symbol and m.snap_date=tp.monday and m.expiry=tp.expiry left join settle_d s on s.symbol=f.symbol and s.expiry=f.expiry where f.straddle>0 and m.straddle>0""")
def _bkt03(t):
    return B.weekend_decay(t.chain_d, t.settle_d, STEP, MIN_OI)


@query("bkt04_weekly_straddle", "symbol:l expiry:d entry_date:d strike:1 entry_premium:2 exit_date:d exit_reason:s exit_cost:2 pnl_points:2 hold_days:i",
       f"""with {legs('chain_d')}, ex as (select *, lag(expiry) over (partition by symbol order by expiry) as prev from (select distinct symbol, expiry from chain_d) z), dy as (select distinct symbol, snap_date, expiry from chain_d),
       en as (select d.symbol, d.expiry, min(snap_date) as snap_date from dy d join ex on ex.symbol=d.symbol and ex.expiry=d.expiry and prev is not null and snap_date > prev group by 1,2),
       pk as (select c.symbol, c.snap_date, c.expiry, any_value(spot) as spot, arg_min(strike, abs(strike-spot)*1000000+strike) as strike from chain_d c join en using ({G}) join sp using ({G}) group by 1,2,3),
       e as (select pk.*, ce+pe as prem from pk join bl using ({G}, strike)),
       h as (select e.symbol, e.expiry, e.snap_date as entry_date, e.strike, e.prem, d.snap_date as day, b.ce+b.pe as v, coalesce(s.spot, e.spot) as sx from e join dy d on d.symbol=e.symbol and d.expiry=e.expiry and d.snap_date > e.snap_date
         left join bl b on b.symbol=e.symbol and b.expiry=e.expiry and b.snap_date=d.snap_date and b.strike=e.strike left join sp s on s.symbol=e.symbol and s.expiry=e.expiry and s.snap_date=d.snap_date),
       r as (select *, case when day>=expiry then 'expiry' when v<=prem*0.5 then 'target' when v>=prem*2 then 'stop_loss' end as exit_reason, case when day>=expiry then abs(sx-strike) else v end as exit_cost from h),
       x as (select * from (select *, row_number() over (partition by symbol, expiry order by day) as z from r where exit_reason is not null) q where z=1)
       select symbol, expiry, entry_date, strike, prem as entry_premium, day as exit_date, exit_reason, exit_cost, prem-exit_cost as pnl_points, day-entry_date as hold_days from x""")
def _bkt04(t):
    return B.weekly_straddle(t.chain_d)


MONTHLY_SQL = """mb as (select symbol, cast(date_trunc('month',date) as date) as month, min_by(open,date) as o, max(high) as h, min(low) as l, max_by(close,date) as c from bars group by 1,2),
ms as (select *, row_number() over w as rn, count(*) over (partition by symbol) as n, coalesce(lag(c) over w > max(h) over (partition by symbol order by month rows between 4 preceding and 2 preceding), false) as sig_in, coalesce(lag(c) over w < lag(l,2) over w, false) as sig_out from mb window w as (partition by symbol order by month)),
wk as (select symbol, rn, month, o, c, sig_in, sig_out, n, case when sig_in then 'enter' else 'flat' end as st, null::date as em, null::double as ep, null::date as xm, null::double as xp, null::date as tm, null::double as tp from ms where rn = 5 and n >= 6
  union all
  select m.symbol, m.rn, m.month, m.o, m.c, m.sig_in, m.sig_out, m.n,
   case when wk.st='enter' then (case when m.sig_out then 'leave' else 'in' end) when wk.st='leave' then (case when m.sig_in then 'enter' else 'flat' end) when wk.st='in' then (case when m.sig_out then 'leave' else 'in' end) else (case when m.sig_in then 'enter' else 'flat' end) end,
   case when wk.st='enter' then m.month when wk.st='leave' then null else wk.em end, case when wk.st='enter' then m.o when wk.st='leave' then null else wk.ep end,
   case when wk.st='leave' then m.month end, case when wk.st='leave' then m.o end, case when wk.st='leave' then wk.em end, case when wk.st='leave' then wk.ep end from wk join ms m on m.symbol=wk.symbol and m.rn=wk.rn+1),
bt as (select symbol, tm as entry_month, xm as exit_month, tp as entry_px, xp as exit_px, 0 as is_open from wk where xm is not null union all select symbol, em, month, ep, c, 1 from wk where rn=n and st in ('in','leave'))"""


@query("bkt05_monthly_breakout", "symbol:s entry_month:d exit_month:d hold_months:i entry_px:4 exit_px:4 raw_ret:6 net_ret:6 is_open:i",
       f"with recursive {MONTHLY_SQL} select *, date_diff('month', entry_month, exit_month) as hold_months, exit_px/entry_px-1 as raw_ret, exit_px/entry_px-1-0.002::double as net_ret from bt")
def _bkt05(t):
    return B.monthly_breakout(t.bars)


ENDB_SQL = """mb as (select symbol, cast(date_trunc('month',date) as date) as month, max_by(close,date) as c, max(high) as h, max(date) as date from bars group by 1,2),
ms as (select symbol, date, c from (select *, max(h) over (partition by symbol order by month rows between 3 preceding and 1 preceding) as p, count(*) over (partition by symbol order by month rows between 3 preceding and 1 preceding) as k from mb) z where k>=3 and c>p),
wl as (select symbol, week, lag(l) over (partition by symbol order by week) as pl from (select symbol, cast(date_trunc('week',date) as date) as week, min(low) as l from bars group by 1,2) z),
dd as (select b.symbol, b.date, b.close, pl from bars b join wl on wl.symbol=b.symbol and wl.week=cast(date_trunc('week',b.date) as date)),
cd as (select ms.symbol, ms.date as entry_date, ms.c as entry_price, min(dd.date) as exit_date from ms join dd on dd.symbol=ms.symbol and dd.date>ms.date and (dd.close>=2*ms.c or dd.close<dd.pl) group by 1,2,3),
ch as (select * from (select *, row_number() over (partition by symbol order by entry_date) as z from cd) q where z=1 union all
  select symbol, entry_date, entry_price, exit_date, z from (select c.*, row_number() over (partition by c.symbol order by c.entry_date) as z from ch join cd c on c.symbol=ch.symbol and c.entry_date>=ch.exit_date) q where z=1),
eb as (select ch.*, dd.close as exit_price, case when dd.close>=2*entry_price then 'target' else 'stop' end as exit_reason from ch join dd on dd.symbol=ch.symbol and dd.date=ch.exit_date)"""


@query("bkt06_month_end_breakout", "symbol:s entry_date:d exit_date:d entry_price:4 exit_price:4 exit_reason:s holding_days:i return_pct:4 xirr_annualized:4",
       f"""with recursive {ENDB_SQL} select *, exit_date-entry_date as holding_days, (exit_price/entry_price-1)*100 as return_pct,
       case when exit_price/entry_price <= 0 then -1 else greatest(-1.0::double,least(10.0::double,pow(exit_price/entry_price, 1/(greatest(exit_date-entry_date,7)/365.25::double))-1)) end as xirr_annualized from eb""")
def _bkt06(t):
    return B.month_end_breakout(t.bars)


@query("bkt07_momentum_quintiles", "month:d quintile:i n_stocks:l raw_return:5 median_ret:5 std:5 net_return:5 log_wealth:4",
       """with m as (select symbol, cast(date_trunc('month',date) as date) as month, max_by(close,date) as c from bars group by 1,2), j as (select a.symbol, a.month, c2.c/c12.c-1 as mom, a.c/c1.c-1 as fwd from m a
         join m c1 on c1.symbol=a.symbol and c1.month=a.month-interval 1 month join m c2 on c2.symbol=a.symbol and c2.month=a.month-interval 2 month join m c12 on c12.symbol=a.symbol and c12.month=a.month-interval 12 month where a.month >= (select min(month) from m) + interval 13 month),
       q as (select month, quantile_cont(mom,[0.2,0.4,0.6,0.8]) as e from j group by 1 having count(*) >= 20), k as (select j.*, 1+len(list_filter(e, lambda x: x < mom)) as quintile from j join q using (month)),
       g as (select month, quintile, count(*) as n_stocks, avg(fwd) as raw_return, median(fwd) as median_ret, stddev_samp(fwd) as std, avg(fwd)-0.002::double as net_return from k group by 1,2)
       select *, sum(ln(1+net_return)) over (partition by quintile order by month) as log_wealth from g""")
def _bkt07(t):
    return B.momentum_quintiles(t.bars)


@query("bkt08_option_signals", "symbol:l signal_date:d expiry:d vix:1 vix_rank:3 pcr:5 bias:s atm_strike:1 entry_type:s entry_price:2 exit_date:d exit_price:2 pnl:4 pnl_pct:3 hit:i",
       f"""with ne as (select c.* from chain_d c join (select symbol, snap_date, min(expiry) as expiry from chain_d where expiry > snap_date group by 1,2) m using (symbol, snap_date, expiry)), {legs('ne')},
       vr as (select date, vix, list(vix) over (order by date rows 251 preceding) as a from vix where vix > 0), v2 as (select date, vix, case when len(a)>=20 then (len(list_filter(a, lambda x: x<vix))+(len(list_filter(a, lambda x: x=vix))+1)/2.0::double)/len(a)*100 else 0 end as vix_rank from vr),
       dy as (select symbol, snap_date, row_number() over w as i, coalesce(lead(snap_date,3) over w, max(snap_date) over (partition by symbol)) as x from (select distinct symbol, snap_date from chain_d) z window w as (partition by symbol order by snap_date)),
       pc as (select symbol, snap_date, expiry, sum(oi) filter (where option_type='CE') as tc, coalesce(sum(oi) filter (where option_type='PE'),0) as tp from ne group by 1,2,3 having sum(oi) filter (where option_type='CE') > 0),
       b as (select pc.*, tp/tc::double as pcr, vix, vix_rank, x, case when tp/tc::double>1.3 then 'bullish' when tp/tc::double<0.7 then 'bearish' when vix<18 and vix_rank<50 then 'bullish' when vix>22 then 'bearish' else 'neutral' end as bias
         from pc join v2 on v2.date=pc.snap_date join dy on dy.symbol=pc.symbol and dy.snap_date=pc.snap_date where vix_rank<>0 or i>20),
       o as (select *, case when bias='bullish' then 'CE' else 'PE' end as entry_type from b where bias<>'neutral'),
       a as (select symbol, snap_date, expiry, option_type as entry_type, arg_min(strike,o) as atm_strike, arg_min(ltp,o) as entry_price from (select c.*, case (strike-round_even(spot/50,0)*50)/50 when 0 then 0 when 1 then 1 when -1 then 2 when 2 then 3 when -2 then 4 end as o from ne c join sp using ({G}) where ltp>0) z where o is not null group by 1,2,3,4),
       s as (select o.*, atm_strike, entry_price, least(x, o.expiry) as exit_date from o join a using (symbol, snap_date, expiry, entry_type) where x > snap_date),
       f as (select s.*, coalesce(c.ltp,0) as exit_price from s join dy d2 on d2.symbol=s.symbol and d2.snap_date=s.exit_date left join chain_d c on c.symbol=s.symbol and c.snap_date=s.exit_date and c.expiry=s.expiry and c.strike=s.atm_strike and c.option_type=s.entry_type),
       g as (select *, exit_price-entry_price-floor((40*1.18::double+(entry_price+exit_price)*0.0005::double+exit_price*0.0005::double)/50*10000.0::double+0.5)/10000.0::double as pnl from f)
       select *, snap_date as signal_date, pnl/entry_price*100 as pnl_pct, case when pnl>0 then 1 else 0 end as hit from g""")
def _bkt08(t):
    return B.option_signals(t.chain_d, t.vix, 50)


@query("bkt09_run_summary", "period:s n:l win_rate:4 avg_ret:6 best:5 worst:5 sharpe:5 bm_monthly_ret:6 alpha_monthly:6",
       f"""with recursive {MONTHLY_SQL}, r as (select *, exit_px/entry_px-1-0.002::double as net from bt), p as (select *, 'full' as period from r union all select *, case when entry_month <= date '1998-06-30' then 'train' else 'test' end from r),
       b as (select avg(x) as bm from (select c/lag(c) over (order by month)-1 as x from (select cast(date_trunc('month',date) as date) as month, max_by(close,date) as c from bench group by 1) z) y)
       select period, count(*) as n, avg(case when net>0 then 1.0::double else 0 end)*100 as win_rate, avg(net) as avg_ret, max(net) as best, min(net) as worst, coalesce(avg(net)/stddev_samp(net)*sqrt(12),0) as sharpe, any_value(bm) as bm_monthly_ret, avg(net)-any_value(bm) as alpha_monthly
       from p, b group by 1""")
def _bkt09(t):
    return B.run_summary(B.monthly_breakout(t.bars), t.bench, "entry_month", "net_ret", F.to_date(F.lit("1998-06-30")))


@query("bkt10_bucketed_edge", "bucket:s n:l win_rate:3 expectancy:4 avg_profit:4",
       f"""with {EDGE_SQL}, k as (select *, case when implied_move_pct<0.15 then 'low' when implied_move_pct<0.3 then 'mid' else 'high' end as bucket from ee)
       select bucket, count(*) as n, avg(win_1dte)*100 as win_rate, avg(win_1dte)*coalesce(avg(profit_1dte_pts) filter (where win_1dte=1),0)+(1-avg(win_1dte))*coalesce(avg(profit_1dte_pts) filter (where win_1dte=0),0) as expectancy, avg(profit_1dte_pts) as avg_profit from k group by 1 having count(*)>=3""")
def _bkt10(t):
    d = _edge(t).withColumn("bucket", bucket_label("implied_move_pct", [0.15, 0.3], ["low", "mid", "high"]))
    return d.groupBy("bucket").agg(*ST.expectancy("profit_1dte_pts", "win_1dte"), F.avg("profit_1dte_pts").alias("avg_profit")).where("n >= 3")


def _buckets_sql(col: str) -> str:
    edges, labels = B.EDGE_BUCKETS[col]
    return "case " + " ".join(f"when {col}<{e} then '{x}'" for e, x in zip(edges, labels, strict=False)) + f" else '{labels[-1]}' end"


EDGE_CONTEXT_SQL = signals_sql("chain") + ", " + EDGE_SQL.replace("chain_d", "chain").replace("settle_d", "settle") + """,
ir as (select *, (high-low)/close*100 as rg, row_number() over w as rn, cast(date_trunc('week',date) as date) as wk from index_bars window w as (order by date)),
ix as (select *, lag(rg) over w as pr, avg(rg) over (order by date rows between 20 preceding and 1 preceding) as atr, avg(close) over (order by date rows 19 preceding) as m20,
  max(high) over (partition by wk order by date) as wh, min(low) over (partition by wk order by date) as wlo from ir window w as (order by date)),
iw as (select wk, lag(h) over (order by wk) as ph, lag(l) over (order by wk) as pl from (select wk, max(high) as h, min(low) as l from ir group by 1) z),
ip as (select date, coalesce(pr/nullif(atr,0),0) as range_vs_atr, case when wh<ph and wlo>pl then 1 else 0 end as inside_bar, case when close>m20 then 1 else 0 end as above_ma20 from ix join iw using (wk) where rn >= 22),
ec as (select ee.symbol, ee.expiry, ee.snap_date, win_1dte, profit_1dte_pts, coalesce(g.iv_rank,0) as iv_rank, coalesce(g.atm_iv,0) as atm_iv, coalesce(g.pcr,0) as pcr, coalesce(g.term_slope,0) as term_slope, coalesce(g.skew_2pct,0) as skew_2pct,
  range_vs_atr, inside_bar, above_ma20 from ee left join sgm g on g.symbol=ee.symbol and g.snap_date=ee.snap_date left join ip on ip.date=ee.snap_date)"""
_DIMENSIONS_SQL = {
    **{n: _buckets_sql(n) for n in B.EDGE_BUCKETS},
    "weekday": "case when isodow(expiry) < 6 then dayname(expiry) end",
    "inside_bar": "case inside_bar when 1 then 'inside' when 0 then 'not inside' end",
    "above_ma20": "case above_ma20 when 1 then 'above' when 0 then 'below' end",
    "conditions": "case when iv_rank between 20 and 70 and atm_iv between 12 and 22 and pcr between 0.7 and 1.3 then 'trade' else 'skip' end",
}
_SECTION_SQL = {"term_slope": "term_slope<>0", "skew_2pct": "term_slope<>0 and skew_2pct<>0", "range_vs_atr": "range_vs_atr is not null"}
EDGE_REPORT_SQL = "eu as (" + " union all ".join(
    f"select symbol, '{n}' as dimension, {e} as bucket, win_1dte, profit_1dte_pts from ec where {_SECTION_SQL.get(n, 'true')}" for n, e in _DIMENSIONS_SQL.items()) + """),
eg as (select symbol, dimension, bucket, count(*) as n, avg(win_1dte)*100 as win_rate, avg(win_1dte)*coalesce(avg(profit_1dte_pts) filter (where win_1dte=1),0)+(1-avg(win_1dte))*coalesce(avg(profit_1dte_pts) filter (where win_1dte=0),0) as expectancy,
  avg(profit_1dte_pts) as avg_profit from eu where bucket is not null group by 1,2,3),
er as (select * from (select *, sum(n) over (partition by symbol, dimension) as whole from eg) q
  where n >= case dimension when 'conditions' then 1 else 3 end and whole >= case when dimension in ('term_slope','skew_2pct') then 10 when dimension in ('range_vs_atr','inside_bar','above_ma20') then 6 else 0 end)"""


def _edge_context(t):
    return B.edge_context(B.expiry_edge(t.stored("chain"), t.settle, STEP, MIN_OI), O.measured_signals(t.stored("chain"), t.vix), P.price_action(t.index_bars))


@query("bkt10c_edge_report", "symbol:l dimension:s bucket:s n:l win_rate:3 expectancy:3 avg_profit:3", f"with recursive {EDGE_CONTEXT_SQL}, {EDGE_REPORT_SQL} select * from er")
def _bkt10c(t):
    return B.edge_report(_edge_context(t), ["symbol"])


@query("bkt10b_edge_tests", "vrp_mean:5 t_stat:4 p_value:4",
       f"with {EDGE_SQL}, s as (select avg(implied_move_pct-realized_move_pct) as vrp_mean, avg(implied_move_pct-realized_move_pct)/(stddev_samp(implied_move_pct-realized_move_pct)/sqrt(count(*))) as t_stat from ee) select *, 2*(1-{norm_cdf('abs(t_stat)')}) as p_value from s")
def _bkt10b(t):
    return _edge(t).agg(F.avg("vrp").alias("vrp_mean"), ST.one_sample_t("vrp").alias("t_stat")).withColumn("p_value", ST.two_sided_p("t_stat"))


# Feedback on closed trades. Live trades are the outcomes; the history is the
# same population one feature richer.
def _live(t):
    return t.outcomes


def _hist(t):
    f = F.to_json(F.struct(F.col("conf").alias("k"), F.col("entry_premium").alias("premium"), F.when(F.col("trade_id") % 4 != 0, F.col("lots").cast("double")).alias("lots")))
    return t.outcomes.withColumn("features_json", f)


@query("fb01_feature_json", "trade_id:l n_features:i k:2 premium:2",
       "select trade_id, case when trade_id % 4 <> 0 then 3 else 2 end as n_features, conf as k, entry_premium as premium from outcomes")
def _fb01(t):
    from tidebook.functions.text import feature_map
    d = t.outcomes.withColumns({"k": F.col("conf"), "premium": F.col("entry_premium"), "lots": F.when(F.col("trade_id") % 4 != 0, F.col("lots").cast("double"))})
    r = FB.feature_rows(d, ["trade_id"], ["k", "premium", "lots"])
    m = feature_map("features_json")
    return r.select("trade_id", F.size(m).alias("n_features"), F.try_element_at(m, F.lit("k")).alias("k"), F.try_element_at(m, F.lit("premium")).alias("premium"))


_PAIRS = """lv as (select symbol, exit_date, pnl_pts, 'k' as f, conf as v from outcomes where conf is not null),
hs as (select symbol, exit_date, pnl_pts, 'k' as f, conf as v from outcomes where conf is not null union all select symbol, exit_date, pnl_pts, 'premium', entry_premium from outcomes union all select symbol, exit_date, pnl_pts, 'lots', lots from outcomes where trade_id % 4 <> 0),
ba as (select symbol, f, case when count(*)>=10 then corr(v, case when pnl_pts>=0 then 1 else 0 end) else 0 end as b from (select * from lv union all select * from hs) z where exit_date between date '2024-01-30'-20 and date '2024-01-30' group by 1,2),
wn(w) as (values (3),(7),(14)), cu as (select symbol, f, w, count(*) as n, corr(v, case when pnl_pts>=0 then 1 else 0 end) as c from lv, wn where exit_date between date '2024-01-30'-w and date '2024-01-30' group by 1,2,3 having count(*)>=10),
dr as (select cu.symbol, cu.f as feature_name, w as window_days, n as n_trades, c as correlation, b as baseline_corr, case when abs(b)>=1e-6 and abs(c-b)>0.15 then 1 else 0 end as drift_detected from cu join ba using (symbol, f))"""


def _drift(t):
    # Windows are scaled to the 30 days these trades span.
    return FB.feature_drift(_live(t), _hist(t), F.to_date(F.lit("2024-01-30")), windows=(3, 7, 14), baseline_days=20)


@query("fb02_feature_drift", "symbol:l feature_name:s window_days:i n_trades:l correlation:6 baseline_corr:6 drift_detected:i", f"with {_PAIRS} select * from dr")
def _fb02(t):
    return _drift(t)


@query("fb02b_retrain_triggers", "symbol:l drifted_features:s n_drifted:i",
       f"with {_PAIRS} select symbol, string_agg(feature_name, ', ' order by feature_name) as drifted_features, count(*) as n_drifted from dr where window_days=3 and drift_detected=1 group by 1 having count(*)>=1")
def _fb02b(t):
    return FB.retrain_triggers(_drift(t), window=3, minimum=1)


@query("fb03_loss_attribution", "trade_id:l symbol:l feature_name:s feature_value:2 win_mean:5 attribution:5",
       """with w as (select avg(conf) as m, stddev_pop(conf) as s from outcomes where pnl_pts>=0), w2 as (select avg(entry_premium) as m, stddev_pop(entry_premium) as s from outcomes where pnl_pts>=0), w3 as (select avg(lots) as m, stddev_pop(lots) as s from outcomes where pnl_pts>=0 and trade_id%4<>0)
       select trade_id, symbol, 'k' as feature_name, conf as feature_value, m as win_mean, (conf-m)/s as attribution from outcomes, w where pnl_pts<0 union all select trade_id, symbol, 'premium', entry_premium, m, (entry_premium-m)/s from outcomes, w2 where pnl_pts<0
       union all select trade_id, symbol, 'lots', lots, m, (lots-m)/s from outcomes, w3 where pnl_pts<0 and trade_id%4<>0""")
def _fb03(t):
    h = _hist(t)
    return FB.loss_attribution(h.where("pnl_pts < 0").select("trade_id", "symbol", "exit_date", "features_json"), h.where("pnl_pts >= 0"))


@query("fb04_graduation", "exit_reason:s bt_oos_trades:l bt_win_rate:5 bt_sharpe:5 bt_years:5 paper_trades:l paper_net_pnl:2 micro_trades:l bt_gate_trades:i bt_gate_win_rate:i bt_gate_sharpe:i paper_gate_win_rate:i paper_gate_pnl:i micro_gate_trades:i stage:i stage_label:s",
       """with b as (select exit_reason, count(*) as n, avg(case when pnl_pts>-25 then 1.0::double else 0 end) as wr, avg(pnl_pts+30)/stddev_samp(pnl_pts+30) as sh, (max(exit_date)-min(exit_date))/365.0::double as yr from outcomes group by 1),
       p as (select exit_reason, count(*) as n, avg(case when pnl_pts>0 then 1.0::double else 0 end) as wr, sum(pnl_pts) as s from outcomes where trade_id%5=0 group by 1), m as (select exit_reason, count(*) as n, avg(case when pnl_pts>0 then 1.0::double else 0 end) as wr, sum(pnl_pts) as s from outcomes where trade_id%50=0 group by 1),
       g as (select b.exit_reason, b.n as bt_oos_trades, b.wr as bt_win_rate, b.sh as bt_sharpe, b.yr as bt_years, coalesce(p.n,0) as paper_trades, coalesce(p.s,0) as paper_net_pnl, coalesce(m.n,0) as micro_trades, coalesce(m.s,0) as ms,
         case when b.n>=50 then 1 else 0 end as bt_gate_trades, case when b.wr>=0.55 then 1 else 0 end as bt_gate_win_rate, case when b.sh>=0.1 then 1 else 0 end as bt_gate_sharpe, case when b.yr>=0.05 then 1 else 0 end as gy, case when coalesce(p.n,0)>=30 then 1 else 0 end as gp,
         case when coalesce(p.wr,0)-b.wr>-0.10 then 1 else 0 end as paper_gate_win_rate, case when coalesce(p.s,0)>0 then 1 else 0 end as paper_gate_pnl, case when coalesce(m.n,0)>=20 then 1 else 0 end as micro_gate_trades from b left join p using (exit_reason) left join m using (exit_reason)),
       s as (select *, case when least(bt_gate_trades,bt_gate_win_rate,bt_gate_sharpe,gy)=0 then 1 when least(gp,paper_gate_win_rate,paper_gate_pnl)=0 then 2 when micro_gate_trades=0 or ms<=0 then 3 else 4 end as stage from g)
       select *, case stage when 1 then 'BACKTEST' when 2 then 'PAPER' when 3 then 'MICRO_LIVE' else 'FULL_LIVE' end as stage_label from s""")
def _fb04(t):
    o = t.outcomes.withColumn("p30", F.col("pnl_pts") + 30)
    bt = FB.backtest_metrics(o, "exit_reason", "p30", "exit_date", F.col("pnl_pts") > -25)
    paper = FB.stage_metrics(o.where("trade_id % 5 = 0"), "exit_reason", "pnl_pts", "paper")
    micro = FB.stage_metrics(o.where("trade_id % 50 = 0"), "exit_reason", "pnl_pts", "micro")
    # The gate on years is scaled to the 30 days these trades span.
    return FB.graduation(bt, paper, micro, "exit_reason", min_years=0.05)


@query("fb05_trade_statistics", "symbol:l n:l wins:l win_rate:4 total_pnl:2 avg_pnl:4 best_trade:l best_pnl:2 worst_trade:l worst_pnl:2 hi_n:l hi_wins:l lo_n:l lo_wins:l streak_type:s streak:l",
       """with f as (select *, case when pnl_pts>0 then 1 else 0 end as w from outcomes), lo as (select symbol, max(trade_id) filter (where w=1) as lw, max(trade_id) filter (where w=0) as ll from f group by 1),
       s as (select f.symbol, case when any_value(lw)>any_value(ll) then 'W' else 'L' end as streak_type, count(*) filter (where trade_id > least(lw,ll)) as streak from f join lo using (symbol) group by 1)
       select f.symbol, count(*) as n, sum(w) as wins, avg(w)*100 as win_rate, sum(pnl_pts) as total_pnl, avg(pnl_pts) as avg_pnl, arg_max(trade_id, pnl_pts*1000000000-trade_id) as best_trade, max(pnl_pts) as best_pnl, arg_min(trade_id, pnl_pts*1000000000+trade_id) as worst_trade, min(pnl_pts) as worst_pnl,
       count(*) filter (where conf>=70) as hi_n, count(*) filter (where conf>=70 and w=1) as hi_wins, count(*) filter (where conf<50) as lo_n, count(*) filter (where conf<50 and w=1) as lo_wins, any_value(streak_type) as streak_type, any_value(streak) as streak
       from f join s using (symbol) group by 1""")
def _fb05(t):
    return FB.trade_statistics(t.outcomes, ["symbol"], "pnl_pts", ["trade_id"], "conf")


@query("fb06_position_sizing", "trade_id:l avg_win:4 lots:i",
       """with w as (select symbol, avg(pnl_pts) as a from (select *, row_number() over (partition by symbol order by trade_id desc) as z from outcomes where pnl_pts>0) q where z<=30 group by 1), n as (select symbol, count(*) as n from outcomes group by 1)
       select trade_id, case when n>=10 then a end as avg_win, least(case when entry_premium>0 then greatest(1, floor(floor(1000000*0.02::double/(entry_premium*50))*(0.5::double+conf/100))) else greatest(1, floor(1*(0.5::double+conf/100))) end, case when a*100>0 and entry_premium>0 then greatest(1,floor(a*100/(entry_premium*50))) end) as lots
       from outcomes left join w using (symbol) left join n using (symbol)""")
def _fb06(t):
    from tidebook.functions.market import position_lots
    w = FB.recent_win_average(t.outcomes, ["symbol"], ["trade_id"], "pnl_pts")
    j = t.outcomes.join(w, "symbol", "left")
    return j.withColumn("lots", position_lots(F.lit(1_000_000.0), "entry_premium", F.lit(50), "conf", F.col("avg_win") * 100))


