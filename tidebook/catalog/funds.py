"""Fund queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.catalog.windows import RISK_SQL
from tidebook.functions.exprs import attach_row
from tidebook.plans import funds as FU
from tidebook.plans.funds import ALLOCATION

D = "scheme_code:l date:d"
AS_OF = "2001-12-31"
W_ = "window w as (partition by scheme_code order by date)"

NAV_REC = """n0 as (select *, row_number() over (partition by scheme_code order by date) as rn, nav-lag(nav) over (partition by scheme_code order by date) as dl from nav),
nr as (select scheme_code, rn, greatest(dl,0.0) as g, greatest(-dl,0.0) as l from n0 where rn=2 union all select n0.scheme_code, n0.rn, nr.g+(greatest(n0.dl,0.0)-nr.g)/14.0, nr.l+(greatest(-n0.dl,0.0)-nr.l)/14.0 from nr join n0 on n0.scheme_code=nr.scheme_code and n0.rn=nr.rn+1),
ne as (select scheme_code, rn, nav as e20, nav as e50 from n0 where rn=1 union all select n0.scheme_code, n0.rn, ne.e20+(n0.nav-ne.e20)*2.0/21.0, ne.e50+(n0.nav-ne.e50)*2.0/51.0 from ne join n0 on n0.scheme_code=ne.scheme_code and n0.rn=ne.rn+1)"""


@query("mf01_technical", f"{D} sma_20:7 sma_50:7 ema_20:4 ema_50:4 rsi_14:4 atr_14:6 high_52w:4 low_52w:4 ytd_return_pct:4 all_time_high:4 drawdown_pct:4",
       f"""with recursive {NAV_REC}, x as (select n0.*, case when n0.rn>=20 then e20 else 0 end as ema_20, case when n0.rn>=50 then e50 else 0 end as ema_50, case when n0.rn>=15 and l>0 then 100-100/(1+g/l) else 0 end as rsi_14
         from n0 join ne using (scheme_code, rn) left join nr using (scheme_code, rn))
       select scheme_code, date, case when rn>=20 then avg(nav) over (partition by scheme_code order by date rows 19 preceding) else 0 end as sma_20, case when rn>=50 then avg(nav) over (partition by scheme_code order by date rows 49 preceding) else 0 end as sma_50, ema_20, ema_50, rsi_14,
       case when rn>=15 then avg(abs(dl)) over (partition by scheme_code order by date rows 13 preceding) else 0 end as atr_14, max(nav) over v as high_52w, min(nav) over v as low_52w,
       (nav-first_value(nav) over (partition by scheme_code, extract(year from date) order by date))/first_value(nav) over (partition by scheme_code, extract(year from date) order by date)*100 as ytd_return_pct,
       max(nav) over w as all_time_high, (max(nav) over w-nav)/max(nav) over w*100 as drawdown_pct from x {W_}, v as (partition by scheme_code order by date rows 251 preceding)""")
def _mf01(t):
    return FU.technical(t.nav)


@query("mf01b_rollups", f"{D} week_open:4 week_high:4 week_low:4 week_close:4 week_return_pct:4 month_open:4 month_close:4 month_return_pct:4",
       """with k as (select scheme_code, cast(date_trunc('week',date) as date) as p, min_by(nav,date) as o, max(nav) as h, min(nav) as l, max_by(nav,date) as c from nav group by 1,2), m as (select scheme_code, cast(date_trunc('month',date) as date) as p, min_by(nav,date) as o, max_by(nav,date) as c from nav group by 1,2)
       select n.scheme_code, n.date, k.o as week_open, k.h as week_high, k.l as week_low, k.c as week_close, (k.c-k.o)/k.o*100 as week_return_pct, m.o as month_open, m.c as month_close, (m.c-m.o)/m.o*100 as month_return_pct
       from nav n join k on k.scheme_code=n.scheme_code and k.p=cast(date_trunc('week',n.date) as date) join m on m.scheme_code=n.scheme_code and m.p=cast(date_trunc('month',n.date) as date)""")
def _mf01b(t):
    return FU.rollups(t.nav)


def _lag_ret(days):
    n = FU.shift_rows(days)
    return f"coalesce((nav-lag(nav,{n}) over w)/lag(nav,{n}) over w*100,0)"


RET_SQL = ", ".join(f"{_lag_ret(d)} as {c}" for c, d in FU.RETURN_DAYS.items()) + ", " + ", ".join(
    f"coalesce((pow(nav/lag(nav,{FU.shift_rows(y * 365)}) over w, 1.0::double/{y})-1)*100,0) as cagr_{y}y" for y in (1, 3, 5, 10))


@query("mf02_period_returns", f"{D} " + " ".join(f"{c}:4" for c in [*FU.RETURN_DAYS, "cagr_1y", "cagr_3y", "cagr_5y", "cagr_10y"]), f"select scheme_code, date, {RET_SQL} from nav {W_}")
def _mf02(t):
    return FU.period_returns(t.nav)


def sip_sql(p: str, n: int) -> str:
    return f"""{p}m as (select scheme_code, cast(date_trunc('month',date) as date) as month, max(date) as ed, max_by(nav,date) as en from nav group by 1,2),
{p}i as (select m.scheme_code, m.month, cast(m.month - to_months(cast(x.i as int)) as date) as ms, ed, en from {p}m m, (select unnest(range({n})) as i) x),
{p}j as (select a.*, n.date as d, n.nav as v from {p}i a asof join nav n on a.scheme_code=n.scheme_code and a.ms <= n.date),
{p}c as (select scheme_code, month, ed, min(d) as t0, list((d-date '1990-01-01')::int) as ds, sum(1000/v)*any_value(en) as fv, any_value(ed) as e2 from {p}j where d <= ed group by 1,2,3),
{p}y as (select scheme_code, month, list_transform(ds, lambda q: (q-(t0-date '1990-01-01'))/365.0::double) as ys, (ed-t0)/365.0::double as te, fv from {p}c),
{p}r as (select scheme_code, month, ys, te, fv, 0.1::double as rate, false as done, 0 as k from {p}y union all
  select scheme_code, month, ys, te, fv, case when rate <= -1 or abs(sl)<1e-12 then 0 when abs(nw-rate)<1e-6 then (case when nw>-1 and nw<10 then nw else 0 end) else nw end, rate <= -1 or abs(sl)<1e-12 or abs(nw-rate)<1e-6, k+1 from
   (select *, rate-npv/sl as nw from (select *, fv/pow(1+rate,te)-list_sum(list_transform(ys, lambda q: 1000/pow(1+rate,q))) as npv, list_sum(list_transform(ys, lambda q: q*1000/pow(1+rate,q+1)))-te*fv/pow(1+rate,te+1) as sl from {p}r where not done and k<100 and rate > -1) a) b),
{p}f as (select scheme_code, month, case when arg_max(done,k) then arg_max(rate,k) else 0 end*100 as v from {p}r group by 1,2)"""


@query("mf03_sip_xirr", "scheme_code:l month:d sip_return_1y:3 sip_return_3y:3 sip_return_5y:3",
       f"with recursive {sip_sql('xa', 12)}, {sip_sql('xb', 36)}, {sip_sql('xc', 60)} select scheme_code, month, xaf.v as sip_return_1y, xbf.v as sip_return_3y, xcf.v as sip_return_5y from xaf join xbf using (scheme_code, month) join xcf using (scheme_code, month)")
def _mf03(t):
    return FU.sip_monthly(t.nav, FU.SIP_COLUMNS)


@query("mf04_risk_columns", f"{D} volatility_1y:4 sharpe_1y:4 sortino_1y:4 beta_vs_nifty:4 consistency_score:4 max_drawdown_pct:4 days_since_peak:i",
       f"""with {RISK_SQL}, pk as (select scheme_code, date, nav, max(nav) over w as p from nav {W_}), px as (select *, max(case when nav=p then date end) over w as pd, (p-nav)/p*100 as dd from pk {W_})
       select rk.*, max(dd) over (partition by px.scheme_code order by px.date) as max_drawdown_pct, px.date-pd as days_since_peak from rk join px using (scheme_code, date)""")
def _mf04(t):
    return FU.risk(t.nav, t.bench)


@query("mf05_incremental_enrichment", f"{D} nav:4 return_1m:4 sma_20:7 volatility_1y:4 sip_return_1y:3 week_return_pct:4 ema_20:4",
       f"""with recursive {NAV_REC}, {RISK_SQL}, {sip_sql('xa', 12)}, sf as (select scheme_code, month, coalesce(last_value(nullif(v,0) ignore nulls) over (partition by scheme_code order by month),0) as s from xaf),
       k as (select scheme_code, cast(date_trunc('week',date) as date) as p, min_by(nav,date) as o, max_by(nav,date) as c from nav group by 1,2),
       b as (select n0.scheme_code, n0.date, n0.nav, coalesce((nav-lag(nav,20) over w)/lag(nav,20) over w*100,0) as return_1m, case when n0.rn>=20 then avg(nav) over (partition by scheme_code order by date rows 19 preceding) else 0 end as sma_20, case when n0.rn>=20 then e20 else 0 end as ema_20
         from n0 join ne using (scheme_code, rn) {W_})
       select b.*, volatility_1y, s as sip_return_1y, (k.c-k.o)/k.o*100 as week_return_pct from b join rk using (scheme_code, date) join sf on sf.scheme_code=b.scheme_code and sf.month=cast(date_trunc('month',b.date) as date)
       join k on k.scheme_code=b.scheme_code and k.p=cast(date_trunc('week',b.date) as date) where b.date > date '2001-06-30'""")
def _mf05(t):
    return FU.enrich(t.nav, t.bench, F.to_date(F.lit("2001-06-30")), t.tasks("lineitem"))


LATEST = "lr as (select scheme_code, max_by(return_1y,date) as return_1y, max_by(return_6m,date) as return_6m, max_by(return_3m,date) as return_3m, max_by(return_1m,date) as return_1m from (select scheme_code, date, " + RET_SQL + f" from nav {W_}) z group by 1)"


@query("mf06_category_heat", "scheme_category:i n_funds:l return_1y:4 return_6m:4 return_3m:4 return_1m:4",
       f"with {LATEST} select scheme_category, count(*) as n_funds, median(return_1y) as return_1y, median(return_6m) as return_6m, median(return_3m) as return_3m, median(return_1m) as return_1m from lr join funds using (scheme_code) where is_active=1 group by 1 having count(*)>=3")
def _mf06(t):
    return FU.category_heat(FU.period_returns(t.nav), t.funds)


@query("mf07_trend_arrow", "scheme_code:l trend:s",
       f"with {LATEST} select scheme_code, case when return_1m-return_3m/3>1 then 'up' when return_1m-return_3m/3>0.3 then 'rising' when return_1m-return_3m/3>-0.3 then 'flat' when return_1m-return_3m/3>-1 then 'falling' else 'down' end as trend from lr")
def _mf07(t):
    from tidebook.functions.market import trend_arrow
    return FU.latest_returns(FU.period_returns(t.nav), ["return_1m", "return_3m"]).withColumn("trend", trend_arrow("return_1m", "return_3m"))


CAP_SQL = """fm as (select scheme_code, cast(date_trunc('month',date) as date) as month, (max_by(nav,date)-min_by(nav,date))/min_by(nav,date)*100 as fr from nav where date between date '1997-01-01' and date '2001-12-31' group by 1,2), bm as (select cast(date_trunc('month',date) as date) as month, (max_by(close,date)-min_by(close,date))/min_by(close,date)*100 as nr from bench where date between date '1997-01-01' and date '2001-12-31' group by 1),
cp as (select scheme_code, coalesce(avg(fr/nr*100) filter (where nr>0),0) as upside_capture, coalesce(avg(fr/nr*100) filter (where nr<0),0) as downside_capture from fm join bm using (month) where nr<>0 group by 1)"""


@query("mf08_capture_ratios", "scheme_code:l upside_capture:3 downside_capture:3", f"with {CAP_SQL} select * from cp")
def _mf08(t):
    return FU.captures(t.nav, t.bench, F.to_date(F.lit(AS_OF)))


QCOLS = ["cagr_5y", "consistency_score", "sip_return_5y", "sortino_1y", "sharpe_1y", "max_drawdown_pct", "volatility_1y", "beta_vs_nifty"]


def _score_sql(name, src, weights):
    norm = ", ".join(f"coalesce(({c}-min({c}) over g)/nullif(max({c}) over g-min({c}) over g,0),0.5) as z_{c}" for c in weights)
    raw = "+".join(f"({w}::double)*z_{c}" for c, w in weights.items())
    return f"""{name}n as (select *, {norm} from {src} window g as (partition by scheme_category)), {name}r as (select *, {raw} as raw from {name}n),
{name} as (select * exclude (raw, {', '.join('z_' + c for c in weights)}), coalesce((raw-min(raw) over g)/nullif(max(raw) over g-min(raw) over g,0),0.5)*100 as {name}_score from {name}r window g as (partition by scheme_category))"""


_W9 = {c: w for c, w in FU.WEIGHTS_11.items() if c not in FU.LATE_COLUMNS}


@query("mf09_quality_score", "scheme_category:i scheme_code:l first_score:3 quality_score:3",
       f"""with recursive {RISK_SQL}, {CAP_SQL}, {sip_sql('xc', 60)}, pk as (select scheme_code, date, nav, max(nav) over w as p from nav {W_}), px as (select scheme_code, max((p-nav)/p*100) as max_drawdown_pct from pk group by 1),
       sx as (select scheme_code, coalesce(max_by(nullif(v,0), month),0) as sip_return_5y from xcf where v<>0 group by 1),
       lt as (select f.scheme_category, f.scheme_code, coalesce((pow(n.nav/n.past,1.0::double)-1)*100,0) as cagr_5y, coalesce(sip_return_5y,0) as sip_return_5y, max_drawdown_pct, r.* exclude (scheme_code, date) from funds f
         join (select scheme_code, max_by(nav,date) as nav, max_by(past,date) as past from (select scheme_code, date, nav, lag(nav,252) over w as past from nav {W_}) z group by 1) n using (scheme_code)
         join (select scheme_code, max(date) as date from nav group by 1) q using (scheme_code) join rk r on r.scheme_code=q.scheme_code and r.date=q.date join px on px.scheme_code=f.scheme_code left join sx on sx.scheme_code=f.scheme_code),
       {_score_sql('first', 'lt', _W9)}, b30 as (select scheme_code from (select *, row_number() over (partition by scheme_category order by first_score desc, scheme_code) as z from first) q where z<=30),
       bc as (select (pow(max_by(close,date)/min_by(close,date), 365.0::double/(max(date)-min(date)))-1)*100 as bench_cagr from bench),
       l2 as (select first.*, coalesce(case when b30.scheme_code is not null then upside_capture end,0) as upside_capture, coalesce(case when b30.scheme_code is not null then downside_capture end,0) as downside_capture, cagr_5y-beta_vs_nifty*bench_cagr as alpha
         from first left join b30 on b30.scheme_code=first.scheme_code left join cp on cp.scheme_code=first.scheme_code, bc), {_score_sql('quality', 'l2', FU.WEIGHTS_11)} select * from quality""")
def _mf09(t):
    # The series span about two years, so the one-year growth rate stands in
    # for the five-year column; the formula is the same.
    bench = t.stored("bench")  # one row per day, read three times below
    e = FU.risk(FU.sip_returns(FU.period_returns(t.nav), t.tasks("lineitem")), bench).withColumn("cagr_5y", F.col("cagr_1y"))
    last = FU.latest_returns(e, QCOLS).join(t.funds, "scheme_code")
    b = bench.agg(((F.pow(F.max_by("close", "date") / F.min_by("close", "date"), 365.0 / F.datediff(F.max("date"), F.min("date"))) - 1) * 100).alias("bench_cagr"))
    return FU.quality_score(last, FU.captures(t.nav, bench, F.to_date(F.lit(AS_OF))), b)


HOLD_SQL = f"""{LATEST}, cn as (select scheme_code, max_by(nav,date) as current_nav from nav group by 1), bb as (select (max_by(close,date)-max_by(close,date) filter (where date <= (select max(date) from bench) - interval 1 year))/(max_by(close,date) filter (where date <= (select max(date) from bench) - interval 1 year))*100 as b1 from bench),
ho as (select c_nationkey as investor, c_custkey % (select count(*) from supplier) as scheme_code, sum(abs(c_acctbal))/100 as units, avg(c_acctbal)+20000 as avg_nav from customer group by 1,2),
hr as (select investor, ho.scheme_code, scheme_category, units*current_nav as current_value, units*avg_nav as invested_value, (current_nav-avg_nav)/avg_nav*100 as return_pct, return_1y-b1 as alpha_1y from ho left join funds using (scheme_code) left join cn using (scheme_code) left join lr using (scheme_code), bb)"""


def _holdings(t):
    n = t.raw("supplier").agg(F.count(F.lit(1)).alias("_n"))
    h = attach_row(t.raw("customer"), n).groupBy(F.col("c_nationkey").alias("investor"), (F.col("c_custkey") % F.col("_n")).alias("scheme_code")).agg(
        (F.sum(F.abs("c_acctbal")) / 100).alias("units"), (F.avg("c_acctbal") + 20000).alias("avg_nav"))
    last = t.nav.groupBy("scheme_code").agg(F.max_by("nav", "date").alias("current_nav"))
    ret = FU.latest_returns(FU.period_returns(t.nav), ["return_1y"]).drop("date")
    info = t.funds.join(last, "scheme_code").join(ret, "scheme_code").select("scheme_code", "scheme_category", "current_nav", "return_1y")
    end = t.bench.agg(F.max("date").alias("_e"))
    past = F.max_by("close", F.when(F.col("date") <= F.add_months("_e", -12), F.col("date")))
    b = attach_row(t.bench, end).agg(((F.max_by("close", "date") - past) / past * 100).alias("bench_1y"))
    return FU.holdings_report(h, info, b)


@query("mf10_holdings_report", "investor:i scheme_code:l scheme_category:i current_value:2 invested_value:2 return_pct:4 alpha_1y:3", f"with {HOLD_SQL} select * from hr")
def _mf10(t):
    return _holdings(t)


@query("mf10b_allocation_drift", "investor:i scheme_category:i current_value:2 current_pct:4 target_pct:2 delta_pct:4 action:s",
       f"""with {HOLD_SQL}, c as (select investor, scheme_category, sum(current_value) as current_value from hr group by 1,2), tg as (select n_nationkey as investor, s.x as scheme_category, 20.0 as target_pct from nation, (values (1),(3),(5),(8),(30)) s(x)),
       tt as (select investor, sum(current_value) as t from c group by 1), j as (select coalesce(c.investor,tg.investor) as investor, coalesce(c.scheme_category,tg.scheme_category) as scheme_category, coalesce(current_value,0) as current_value, coalesce(target_pct,0) as target_pct from c full join tg on c.investor=tg.investor and c.scheme_category=tg.scheme_category),
       k as (select j.*, coalesce(current_value*100/t,0) as current_pct, coalesce(current_value*100/t,0)-target_pct as delta_pct from j left join tt using (investor)) select *, case when delta_pct>5 then 'REDUCE' when delta_pct<-5 then 'ADD' else 'OK' end as action from k""")
def _mf10b(t):
    tg = t.raw("nation").select(F.col("n_nationkey").alias("investor"), F.explode(F.array(*[F.lit(x) for x in (1, 3, 5, 8, 30)])).alias("scheme_category"), F.lit(20.0).alias("target_pct"))
    return FU.allocation_drift(_holdings(t), tg)


def _alloc_sql():
    base = ", ".join(f"('{r}','{h}','{c}',{w}::double)" for (r, h), ws in ALLOCATION.items() for c, w in ws.items())
    fb = "case " + " ".join(f"when list_contains(cats,'{c}') then '{c}'" for c in FU.OVERFLOW_ORDER) + " end"
    return f"""with iv as (select c_custkey as investor, (['Conservative','Moderate','Aggressive','Very Aggressive'])[cast(c_custkey%4 as int)+1] as risk, (['short','mid','long'])[cast(c_custkey%3 as int)+1] as hz, case when c_custkey%5=0 then 1 else 0 end as tax, abs(c_acctbal)*20 as amt,
      case when c_custkey%7=0 then ['Large Cap'] when c_custkey%11=0 then ['ELSS'] else []::varchar[] end as ex from customer),
    bs(risk, h, category, weight) as (values {base}), ky as (select iv.*, case when exists (select 1 from bs where bs.risk=iv.risk and h='any') then 'any' when exists (select 1 from bs where bs.risk=iv.risk and h=iv.hz) then hz else 'long' end as key from iv),
    a as (select ky.*, category, weight from ky join bs on bs.risk=ky.risk and bs.h=ky.key where not list_contains(ex, category)),
    p as (select investor, list(category) as cats, coalesce(sum(weight) filter (where category='ELSS'),0) as tw from a group by 1), f as (select *, {fb} as fb from p),
    b as (select a.investor, tax, amt, category, case when tax=0 and category=fb then weight+tw else weight end as weight from a join f using (investor) where tax=1 or category<>'ELSS'
      union all select investor, tax, amt, 'ELSS', 0.10::double from ky where tax=1 and not list_contains(ex,'ELSS') and investor not in (select investor from a where category='ELSS')),
    n as (select b.*, weight/sum(weight) over (partition by investor) as w2 from b), m as (select *, amt*w2 as am, case when tax=1 and category='ELSS' and amt*w2>12500 then amt*w2-12500 else 0 end as ov from n),
    q as (select investor, list(category) as cats, sum(ov) as sp from m group by 1), g as (select *, {fb} as fb from q)
    select m.investor, category, w2 as weight, am-ov+case when category=fb then sp else 0 end as amount from m join g using (investor)"""


@query("mf11_allocation", "investor:l category:s weight:6 amount:4", _alloc_sql())
def _mf11(t):
    k = F.col("c_custkey")
    pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (k % len(vals) + 1).cast("int"))
    inv = t.raw("customer").select(
        k.alias("investor"), pick(["Conservative", "Moderate", "Aggressive", "Very Aggressive"]).alias("risk"), pick(["short", "mid", "long"]).alias("horizon"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("tax_goal"), (F.abs("c_acctbal") * 20).alias("sip_amount"),
        F.when(k % 7 == 0, F.array(F.lit("Large Cap"))).when(k % 11 == 0, F.array(F.lit("ELSS"))).otherwise(F.array().cast("array<string>")).alias("excluded"))
    return FU.allocation(inv)


@query("mf12_deactivate_irrelevant", "is_active:i n:l", """with n as (select case when upper(p_name) like '%ETF%' or p_partkey % 3 = 0 then 1 else 0 end as is_active from part) select is_active, count(*) as n from n group by 1""")
def _mf12(t):
    named = t.raw("part").select(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "Direct Growth").otherwise("Regular")).alias("scheme_name"), F.lit(1).alias("is_active"))
    return FU.deactivate_irrelevant(named).groupBy("is_active").agg(F.count(F.lit(1)).alias("n"))
