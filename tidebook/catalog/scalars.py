"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.fragments import norm_cdf
from tidebook.catalog.registry import query
from tidebook.functions import blackscholes as BS
from tidebook.functions import market as M
from tidebook.functions import text as T
from tidebook.functions.exprs import clip, flag, round_half_even, safe_div
from tidebook.operators import calendar as C


@query("fn01_dates", "trade_id:l day:d month:d yyyymm:i hour:i dow:i gap:i back:d",
       """select trade_id, cast(exit_time as date) as day, date_trunc('month',exit_time) as month, extract(year from exit_time)*100+extract(month from exit_time) as yyyymm, extract(hour from exit_time) as hour,
       (extract(isodow from exit_time)-1) as dow, expiry-entry_date as gap, cast(exit_time as date)-30 as back from outcomes""")
def _fn01(t):
    x = F.col("exit_time")
    return t.outcomes.select("trade_id", F.to_date(x).alias("day"), F.trunc(x, "MM").alias("month"), F.date_format(x, "yyyyMM").alias("yyyymm"),
                             F.hour(x).alias("hour"), F.weekday(x).alias("dow"), F.datediff("expiry", "entry_date").alias("gap"), F.date_sub(F.to_date(x), 30).alias("back"))


def _cal(t):
    b = t.flows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return C.calendar(b, t.holidays)


_CAL = """dy as (select cast(unnest(generate_series((select min(date) from flows), (select max(date) from flows), interval 1 day)) as date) as day),
cl as (select day, case when extract(isodow from day) < 6 and h.holiday_date is null then 1 else 0 end as is_trading from dy left join holidays h on h.holiday_date=day),
cx as (select *, sum(is_trading) over (order by day) as trading_index, min(case when is_trading=1 then day end) over (order by day rows between 1 following and unbounded following) as next_trading,
  max(case when is_trading=1 then day end) over (order by day rows between unbounded preceding and 1 preceding) as prev_trading from cl)"""


@query("fn02_trading_calendar", "day:d is_trading:i trading_index:l next_trading:d prev_trading:d", f"with {_CAL} select * from cx")
def _fn02(t):
    return _cal(t)


@query("fn02b_trading_days_between", "snap_date:d expiry:d n:l",
       f"with {_CAL}, k as (select distinct snap_date, expiry from chain) select snap_date, expiry, count(*) filter (where is_trading=1) as n from k join cx on day between snap_date and expiry group by 1,2 having max(day)=expiry and min(day)=snap_date")
def _fn02b(t):
    k = t.chain.select("snap_date", "expiry").distinct()
    return C.trading_days_between(k, _cal(t), "snap_date", "expiry", "n").where("n is not null")


@query("fn03_week_of_month", "expiry:d dow:i wom:i", "select distinct expiry, extract(isodow from expiry)-1 as dow, (extract(day from expiry)-1)//7+1 as wom from chain")
def _fn03(t):
    return t.chain.select("expiry").distinct().select("expiry", F.weekday("expiry").alias("dow"), C.week_of_month("expiry").alias("wom"))


@query("fn04_weekend_triplets", "friday:d monday:d expiry:d",
       """with d as (select distinct snap_date from chain_d), e as (select distinct expiry, cast(date_trunc('week', expiry-1) as date) as monday from chain_d)
       select monday-3 as friday, monday, expiry from e where monday in (select snap_date from d) and monday-3 in (select snap_date from d)""")
def _fn04(t):
    return C.weekend_triplets(t.chain_d.select(F.col("snap_date").alias("date")), t.chain_d.select("expiry"))


@query("fn05_null_handling", "trade_id:l nz:2 filled:2 ratio:4",
       "select trade_id, nullif(lots,1) as nz, coalesce(nullif(lots,1),0) as filled, pnl_pts/nullif(lots-2,0) as ratio from outcomes")
def _fn05(t):
    nz = F.nullif("lots", F.lit(1))
    return t.outcomes.select("trade_id", nz.alias("nz"), F.coalesce(nz, F.lit(0)).alias("filled"), safe_div("pnl_pts", F.col("lots") - 2).alias("ratio"))


@query("fn06_strings", "p_partkey:l up:s low:s len:i head:s first:s tag:s hit:i",
       """select p_partkey, upper(p_name) as up, lower(p_brand) as low, length(trim(p_name)) as len, substring(p_name,1,3) as head, split_part(p_name,' ',1) as first, concat(p_brand,'/',p_type) as tag,
       case when p_name like '%ring' then 1 else 0 end as hit from part""")
def _fn06(t):
    n = F.col("p_name")
    return t.raw("part").select("p_partkey", F.upper(n).alias("up"), F.lower("p_brand").alias("low"), F.length(F.trim(n)).alias("len"), F.substring(n, 1, 3).alias("head"),
                                F.split(n, " ")[0].alias("first"), F.concat_ws("/", "p_brand", "p_type").alias("tag"), flag(n.like("%ring")).alias("hit"))


@query("fn07_number_cleaning", "o_orderkey:l v:2",
       "select o_orderkey, case when o_orderkey % 7 = 0 then 0 when o_orderkey % 11 = 0 then 0 when o_orderkey % 13 = 0 then 0 else o_totalprice end as v from orders")
def _fn07(t):
    k, p = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    raw = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, "").when(k % 13 == 0, "NaN").otherwise(F.concat(F.lit(" "), p))
    return t.raw("orders").select("o_orderkey", T.clean_number(raw).alias("v"))


@query("fn08_json_round_trip", "event_id:l k:1 bad:i", "select event_id, case when event_id % 5 = 0 then null else cast(json_extract_string(props,'$.k') as double) end as k, case when event_id % 5 = 0 then 1 else 0 end as bad from events")
def _fn08(t):
    raw = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    m = T.feature_map(raw)
    k = F.try_element_at(m, F.lit("k"))
    return t.raw("events").select("event_id", k.alias("k"), flag(k.isNull()).alias("bad"))


@query("fn09_normal_cdf", "trade_id:l cdf:7 pdf:7",
       f"select trade_id, {norm_cdf('(pnl_pts/25.0)')} as cdf, exp(-0.5*(pnl_pts/25.0)*(pnl_pts/25.0))/sqrt(2*pi()) as pdf from outcomes")
def _fn09(t):
    x = F.col("pnl_pts") / 25.0
    return t.outcomes.select("trade_id", BS.norm_cdf(x).alias("cdf"), BS.norm_pdf(x).alias("pdf"))


@query("fn10_math", "trade_id:l ln:6 ex:4 sq:6 pw:4 ab:2 cl:2 even:0 fl:0",
       """select trade_id, ln(entry_premium+1) as ln, exp(pnl_pts/50) as ex, sqrt(entry_premium) as sq, pow(entry_premium,1.5) as pw, abs(pnl_pts) as ab, greatest(-10.0::double,least(10.0::double,pnl_pts)) as cl,
       round_even(floor(pnl_pts)+0.5,0) as even, floor(pnl_pts) as fl from outcomes""")
def _fn10(t):
    p, e = F.col("pnl_pts"), F.col("entry_premium")
    return t.outcomes.select("trade_id", F.log(e + 1).alias("ln"), F.exp(p / 50).alias("ex"), F.sqrt(e).alias("sq"), F.pow(e, F.lit(1.5)).alias("pw"), F.abs(p).alias("ab"),
                             clip(p, -10, 10).alias("cl"), round_half_even(F.floor(p).cast("double") + 0.5).alias("even"), F.floor(p).alias("fl"))


@query("fn11_vix_regime", "date:d vix:1 regime:s", "select date, vix, case when vix<13 then 'low' when vix<=18 then 'normal' when vix<=25 then 'elevated' else 'extreme' end as regime from vix")
def _fn11(t):
    return t.vix.withColumn("regime", M.vix_regime("vix"))


@query("fn12_opportunity", "date:d score:i ok:i",
       """with r as (select date, case when vix<13 then 75 when vix<=18 then 60 when vix<=25 then 40 else 25 end + case when extract(day from date)%3=0 then 10 when extract(day from date)%3=1 then -10 else 0 end as score from vix)
       select *, case when score>=50 then 1 else 0 end as ok from r""")
def _fn12(t):
    m = F.dayofmonth("date") % 3
    d = t.vix.withColumn("score", M.opportunity_score(M.vix_regime("vix"), F.when(m == 0, "up").when(m == 1, "down").otherwise("flat")))
    return d.withColumn("ok", flag(F.col("score") >= 50))


@query("fn13_trade_costs", "trade_id:l buy:4 sell:4 brok:2 stt:2 exch:2 total_cost:2",
       """with c as (select *, greatest(entry_premium-pnl_pts/2,0) as ex from outcomes), d as (select *, floor((case when lots=3 then 8 else 4 end*20.0::double*1.18::double)*100.0::double+0.5)/100.0::double as b, floor((entry_premium*0.0005::double*lot_size*lots*2)*100.0::double+0.5)/100.0::double as s, floor(((entry_premium+5)*lot_size*lots*0.0005::double*2)*100.0::double+0.5)/100.0::double as x from c)
       select trade_id, (40*1.18::double+(entry_premium+ex)*0.0005::double+ex*0.0005::double)/lot_size as buy, (40*1.18::double+(entry_premium+ex)*0.0005::double+entry_premium*0.0005::double)/lot_size as sell, b as brok, s as stt, x as exch, b+s+x as total_cost from d""")
def _fn13(t):
    d = t.outcomes.withColumn("ex", F.greatest(F.col("entry_premium") - F.col("pnl_pts") / 2, F.lit(0.0)))
    c = M.itemised_cost(F.col("entry_premium"), F.lit(5.0), F.col("lot_size"), F.col("lots"), F.col("lots") == 3)
    return d.select("trade_id", M.round_trip_cost("entry_premium", "ex", "buy", "lot_size").alias("buy"), M.round_trip_cost("entry_premium", "ex", "sell", "lot_size").alias("sell"),
                    *[v.alias(k) for k, v in c.items()])


@query("fn14_margin_estimate", "trade_id:l margin:2",
       """select trade_id, case when conf > 40 then (conf/100*2)/2*24000*sqrt(1/252.0::double)*lot_size*3 when lots > 1 then lots/100.0::double*24000*lot_size*2*0.30::double else 0 end as margin from outcomes""")
def _fn14(t):
    iv = F.when(F.col("conf") > 40, F.col("conf") / 100)
    pct = F.when(F.col("lots") > 1, F.col("lots").cast("double"))
    return t.outcomes.select("trade_id", M.margin_estimate(iv, iv, F.lit(24000.0), F.col("lot_size"), pct).alias("margin"))


@query("fn15_annualised_return", "trade_id:l xirr:5",
       "select trade_id, case when 1+pnl_pts*2.5/100<=0 then -1 else greatest(-1.0::double,least(10.0::double,pow(1+pnl_pts*2.5/100,1/(greatest(expiry-entry_date,7)/365.25::double))-1)) end as xirr from outcomes")
def _fn15(t):
    return t.outcomes.withColumn("r", F.col("pnl_pts") * 2.5).select("trade_id", M.annualised_return("entry_date", "expiry", "r").alias("xirr"))


@query("fn16_display_labels", "trade_id:l age:s size:s money:s",
       """with d as (select trade_id, cast(epoch(timestamp '2024-02-01') as bigint)-cast(epoch(date_trunc('second',exit_time)) as bigint) as s, lots*trade_id*1024+512 as n, trade_id*12.5 as m from outcomes)
       select trade_id, case when s<60 then s||'s ago' when s<3600 then (s//60)||'m ago' when s<86400 then (s//3600)||'h ago' else (s//86400)||'d ago' end as age,
       case when n<1024 then n||' B' when n<1048576 then printf('%.1f KiB', n/1024.0::double) when n<1073741824 then printf('%.1f MiB', n/1048576.0::double) else printf('%.1f GiB', n/1073741824.0::double) end as size, format('{:,.1f}', m) as money from d""")
def _fn16(t):
    s = F.unix_timestamp(F.to_timestamp(F.lit("2024-02-01 00:00:00"))) - F.unix_timestamp("exit_time")
    n = F.col("lots") * F.col("trade_id") * 1024 + 512
    return t.outcomes.select("trade_id", M.age_label(s).alias("age"), M.size_label(n).alias("size"), F.format_number(F.col("trade_id") * 12.5, 1).alias("money"))
