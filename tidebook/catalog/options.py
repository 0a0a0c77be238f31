"""Option-chain queries. The implied-volatility checks solve the same price
equation with a set-based recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.fragments import norm_cdf
from tidebook.catalog.registry import query
from tidebook.plans import options as O
from tidebook.plans import spreads as SP
from tidebook.session import cut_lineage

K = "symbol:l snap_date:d expiry:d"
G = "symbol, snap_date, expiry"

LEGS = """lg as (select symbol, snap_date, expiry, strike, max(ltp) filter (where option_type='CE') as ce, max(ltp) filter (where option_type='PE') as pe,
    max(oi) filter (where option_type='CE') as co, max(oi) filter (where option_type='PE') as po from {c} group by 1,2,3,4),
bl as (select * from lg where ce is not null and pe is not null),
sp as (select symbol, snap_date, expiry, arg_min(strike+ce-pe, abs(ce-pe)*1000000+strike) as spot from bl group by 1,2,3)"""


def legs(c="chain"):
    return LEGS.format(c=c)


def iv_sql(variant: str, rows: str, name: str = "iv") -> str:
    """IV of ``rows`` (columns id, s, k, t, p, call) by recursion over steps, as CTE ``{name}f``."""
    start, steps, tol, vmin, lo, hi, floor, margin, unsolved = {
        "greeks": (0.25, 60, 0.01, "1e-8", 0.001, 10.0, "p > 0", "p > greatest(case when call then s-k else k-s end, 0)*1.001", "0"),
        "historical": (0.3, 50, 1e-6, "1e-10", 1e-4, 2.0, "p >= 0.05", "p >= greatest(case when call then s-k else k-s end, 0)", "null"),
        "skew": (0.25, 50, 1e-6, "1e-10", 1e-4, 2.0, "p >= 0.5", "true", "null"),
    }[variant]
    sg = "case when call then 1 else -1 end"
    d1 = "(ln(s/k)+(0.065+0.5*sig*sig)*t)/(sig*sqrt(t))"
    keep = "sig" if unsolved == "0" else f"case when (done and not dead) or (not dead and sig > 0 and sig < {hi}) then sig end"
    return f"""{name}r as (select id, s, k, t, p, call, {start}::double as sig, false as done, false as dead, 0 as i from {rows} where t > 0 and s > 0 and {floor} and {margin}
    union all select id, s, k, t, p, call, case when dead2 then sig else greatest({lo}::double, least({hi}::double, sig - df/vg)) end, dead2 or abs(df) < {tol}, dead2, i+1 from
      (select *, vg < {vmin} as dead2 from (select *, ({sg})*(s*{norm_cdf(f'(({sg})*d1)')} - k*exp(-0.065*t)*{norm_cdf(f'(({sg})*(d1-sig*sqrt(t)))')}) - p as df, s*sqrt(t)*exp(-0.5*d1*d1)/sqrt(2*pi()) as vg
        from (select *, {d1} as d1 from {name}r where not done and i < {steps}) a) b) c),
{name}f as (select id, {keep} as iv from (select *, row_number() over (partition by id order by i desc) as z from {name}r) q where z = 1)"""


@query("opt01_spot_by_parity", f"{K} spot:2", f"with {legs()} select * from sp")
def _opt01(t):
    return O.spot_by_parity(t.chain)


@query("opt02_atm_variants", f"{K} atm_nearest:1 atm_gap:1 atm_rounded:1 entry_price:2",
       f"""with {legs()}, nr as (select c.symbol, c.snap_date, c.expiry, arg_min(strike, abs(strike-spot)*1000000+strike) as a from chain c join sp using ({G}) group by 1,2,3),
       gp as (select symbol, snap_date, expiry, arg_min(strike, abs(ce-pe)*1000000+strike) as a from bl where ce>0.5 and pe>0.5 group by 1,2,3 having count(*) >= 2),
       rd as (select c.symbol, c.snap_date, c.expiry, arg_min(strike, o) as a, arg_min(ltp, o) as px from
         (select c.*, case (strike - round_even(spot/50,0)*50)/50 when 0 then 0 when 1 then 1 when -1 then 2 when 2 then 3 when -2 then 4 end as o from chain c join sp using ({G}) where option_type='CE' and ltp>0) c where o is not null group by 1,2,3)
       select symbol, snap_date, expiry, nr.a as atm_nearest, gp.a as atm_gap, rd.a as atm_rounded, rd.px as entry_price from nr left join gp using ({G}) left join rd using ({G})""")
def _opt02(t):
    sp = O.spot_by_parity(t.chain)
    d = O.atm_nearest(t.chain, sp).withColumnRenamed("atm_strike", "atm_nearest")
    d = d.join(O.atm_min_gap(t.chain).withColumnRenamed("atm_strike", "atm_gap"), O.SNAP, "left")
    return d.join(O.atm_rounded(t.chain, sp, 50.0, "CE").withColumnRenamed("atm_strike", "atm_rounded"), O.SNAP, "left")


_PCR = "select symbol, snap_date, expiry, coalesce(sum(oi) filter (where option_type='CE'),0) as total_ce_oi, coalesce(sum(oi) filter (where option_type='PE'),0) as total_pe_oi from {c} group by 1,2,3"


@query("opt03_put_call_ratio", f"{K} total_ce_oi:l total_pe_oi:l pcr:6",
       f"with p as ({_PCR.format(c='chain')}) select *, case when total_ce_oi > 0 then total_pe_oi/total_ce_oi::double else 0 end as pcr from p")
def _opt03(t):
    return O.put_call_ratio(t.chain)


_PAIN = f"""kk as (select symbol, snap_date, expiry, strike, sum(case when option_type='CE' then oi else 0 end)::double as c, sum(case when option_type='PE' then oi else 0 end)::double as p from {{c}} group by 1,2,3,4),
pay as (select a.symbol, a.snap_date, a.expiry, a.strike, sum(greatest(a.strike-b.strike,0)*b.c + greatest(b.strike-a.strike,0)*b.p) as payout from kk a join kk b using ({G}) group by 1,2,3,4),
mp as (select symbol, snap_date, expiry, strike as max_pain_strike from (select *, row_number() over (partition by {G} order by payout, strike) as z from pay) q where z = 1)"""


@query("opt04_max_pain", f"{K} max_pain_strike:1", f"with {_PAIN.format(c='chain')} select * from mp")
def _opt04(t):
    return O.max_pain(t.chain)


_WALL = "wl as (select symbol, snap_date, expiry, coalesce(arg_max(strike, oi*1000000.0-strike) filter (where option_type='CE'),0) as ce_wall_strike, coalesce(arg_max(strike, oi*1000000.0-strike) filter (where option_type='PE'),0) as pe_wall_strike from {c} group by 1,2,3)"
NEAR = "ne as (select c.* from {c} c join (select symbol, snap_date, min(expiry) as expiry from {c} where expiry >= snap_date group by 1,2) m using (symbol, snap_date, expiry))"
EOD_PARTS_SQL = _PAIN + ", " + _WALL
EOD_SQL = NEAR.format(c="chain") + ", " + legs("ne") + ", " + _PAIN.format(c="ne") + ", " + _WALL.format(c="ne") + f""",
an as (select c.symbol, c.snap_date, c.expiry, arg_min(strike, abs(strike-spot)*1000000+strike) as atm_strike from ne c join sp using ({G}) group by 1,2,3),
pr as ({_PCR.format(c='ne')}),
eod as (select pr.symbol, pr.snap_date, pr.expiry, total_ce_oi, total_pe_oi, case when total_ce_oi > 0 then total_pe_oi/total_ce_oi::double else 0 end as pcr, coalesce(spot,0) as spot, coalesce(atm_strike,0) as atm_strike,
  max_pain_strike, ce_wall_strike, pe_wall_strike from pr left join sp using ({G}) left join an using ({G}) left join mp using ({G}) left join wl using ({G}))"""


@query("opt05_eod_summary", f"{K} spot:2 total_ce_oi:l total_pe_oi:l pcr:6 max_pain_strike:1 atm_strike:1 ce_wall_strike:1 pe_wall_strike:1", f"with {EOD_SQL} select * from eod")
def _opt05(t):
    return O.eod_summary(t.chain)


@query("opt06_oi_walls", f"{K} ce_wall_strike:1 pe_wall_strike:1", f"with {_WALL.format(c='chain')} select * from wl")
def _opt06(t):
    return O.oi_walls(t.chain)


IV_IN = f"""cr as (select c.*, spot, row_number() over (order by symbol, snap_date, expiry, strike, option_type) as id, spot as s, strike as k, (expiry-snap_date)/365.0::double as t, ltp as p, option_type='CE' as call from {{c}} c join sp using ({G}))"""


@query("opt07_implied_vol", f"{K} strike:1 option_type:s iv:5",
       f"with recursive {legs()}, {IV_IN.format(c='chain')}, {iv_sql('greeks', 'cr')} select cr.*, coalesce(ivf.iv,0) as iv from cr left join ivf using (id)")
def _opt07(t):
    from tidebook.functions import blackscholes as BS
    return O.implied_vols(t.chain, BS.GREEKS)


D1 = "(ln(s/k)+(0.065+0.5*iv*iv)*t)/(iv*sqrt(t))"
GREEKS_SQL = f"""gi as (select cr.*, coalesce(ivf.iv,0) as iv from cr left join ivf using (id)), gd as (select *, case when iv > 0 then {D1} end as d1, case when iv > 0 then {D1}-iv*sqrt(t) end as d2 from gi),
gk as (select *, case when iv > 0 then (case when call then {norm_cdf('d1')} else {norm_cdf('d1')}-1 end) when call then 0.5 else -0.5 end as delta,
  case when iv > 0 then (-(s*exp(-0.5*d1*d1)/sqrt(2*pi())*iv)/(2*sqrt(t)) - 0.065*k*exp(-0.065*t)*(case when call then {norm_cdf('d2')} else {norm_cdf('(-d2)')} end) + (case when call then 0 else 0.065*k*exp(-0.065*t) end))/365 else 0 end as theta from gd)"""


@query("opt08_greeks", f"{K} strike:1 option_type:s delta:4 theta:4",
       f"with recursive {legs()}, {IV_IN.format(c='chain')}, {iv_sql('greeks', 'cr')}, {GREEKS_SQL} select * from gk")
def _opt08(t):
    return O.greeks(t.chain)


ATM_IV_SQL = f"""{NEAR.format(c='chain')}, {legs('ne')}, {IV_IN.format(c='ne')}, nb as (select * from cr where abs(strike-spot) <= spot*0.02), {iv_sql('historical', 'nb')},
am as (select symbol, snap_date, expiry, coalesce(median(iv) filter (where option_type='CE'),0)*100 as atm_ce_iv, coalesce(median(iv) filter (where option_type='PE'),0)*100 as atm_pe_iv from nb left join ivf using (id) group by 1,2,3),
ai as (select *, case when atm_ce_iv > 0 then atm_ce_iv else atm_pe_iv end as atm_iv from am where atm_ce_iv > 0 or atm_pe_iv > 0),
aj as (select *, list(atm_iv) over w as a, min(atm_iv) over w as lo, max(atm_iv) over w as hi from ai window w as (partition by symbol order by snap_date rows 251 preceding))"""


@query("opt09_atm_iv_daily", f"{K} atm_ce_iv:3 atm_pe_iv:3 iv_rank:2 iv_percentile:2",
       f"with recursive {ATM_IV_SQL} select *, case when hi>lo then (atm_iv-lo)/(hi-lo)*100 else 50 end as iv_rank, len(list_filter(a, lambda x: x < atm_iv))/len(a)::double*100 as iv_percentile from aj")
def _opt09(t):
    return O.atm_iv_daily(t.chain)


@query("opt10_iv_skew", f"{K} iv_skew:3",
       f"""with recursive {legs()}, {IV_IN.format(c='chain')}, ot as (select * from cr where t > 0 and ((option_type='PE' and strike >= spot*0.97 and strike < spot) or (option_type='CE' and strike > spot and strike <= spot*1.03))), {iv_sql('skew', 'ot')}
       select symbol, snap_date, expiry, coalesce((median(iv) filter (where option_type='PE') - median(iv) filter (where option_type='CE'))*100,0) as iv_skew from ot left join ivf using (id) group by 1,2,3""")
def _opt10(t):
    return O.iv_skew(t.chain)


SURF_SQL = f"""{legs()}, {IV_IN.format(c='chain')}, {iv_sql('greeks', 'cr')}, {GREEKS_SQL},
sf as (select *, expiry-snap_date as dte, strike/spot as moneyness from gk where iv > 0 and ltp >= 5 and strike/spot between 0.8 and 1.2)"""


@query("opt11_vol_surface", f"{K} dte:i strike:1 moneyness:6 option_type:s iv:5 ltp:2 oi:l", f"with recursive {SURF_SQL} select * from sf")
def _opt11(t):
    return O.vol_surface(t.chain)


@query("opt12_term_structure", "symbol:l snap_date:d atm_iv_7d:5 atm_iv_14d:5 atm_iv_30d:5 atm_iv_60d:5 atm_iv_90d:5 term_slope:5",
       f"""with recursive {SURF_SQL}, kn as (select symbol, snap_date, dte, avg(iv) as iv from sf where moneyness between 0.99 and 1.01 group by 1,2,3),
       tg(x) as (values (7),(14),(30),(60),(90)), ip as (select symbol, snap_date, x, count(*) as n, max(dte) filter (where dte <= x) as l, arg_max(iv, dte) filter (where dte <= x) as li,
         min(dte) filter (where dte >= x) as h, arg_min(iv, dte) filter (where dte >= x) as hi from kn, tg group by 1,2,3),
       v as (select *, case when l is null then hi when h is null then li when l = h then li else li*(1-(x-l)/(h-l)::double)+hi*(x-l)/(h-l)::double end as iv from ip where n >= 2)
       select symbol, snap_date, max(iv) filter (where x=7) as atm_iv_7d, max(iv) filter (where x=14) as atm_iv_14d, max(iv) filter (where x=30) as atm_iv_30d, max(iv) filter (where x=60) as atm_iv_60d,
       max(iv) filter (where x=90) as atm_iv_90d, max(iv) filter (where x=30) - max(iv) filter (where x=7) as term_slope from v group by 1,2""")
def _opt12(t):
    return O.term_structure(O.vol_surface(t.chain))


def _skew(m):
    return f"coalesce(avg(iv) filter (where option_type='PE' and moneyness between {m}::double-0.015::double and {m}::double+0.015::double) - avg(iv) filter (where option_type='CE' and moneyness between 2.0::double-{m}::double-0.015::double and 2.0::double-{m}::double+0.015::double),0)"


@query("opt13_skew_at_moneyness", "symbol:l snap_date:d skew_1pct:5 skew_2pct:5 skew_3pct:5 skew_5pct:5",
       f"with recursive {SURF_SQL} select symbol, snap_date, {_skew(0.99)} as skew_1pct, {_skew(0.98)} as skew_2pct, {_skew(0.97)} as skew_3pct, {_skew(0.95)} as skew_5pct from sf group by 1,2")
def _opt13(t):
    return O.skews(O.vol_surface(t.chain), ["symbol", "snap_date"])


CF_SQL = f"""{{legs}}, ag as (select symbol, snap_date, expiry, arg_min(strike, abs(ce-pe)*1000000+strike) as atm_strike from bl where ce>0.5 and pe>0.5 group by 1,2,3 having count(*) >= 2),
tt as (select symbol, snap_date, expiry, coalesce(sum(oi) filter (where option_type='CE'),0)::double as tc, coalesce(sum(oi) filter (where option_type='PE'),0)::double as tp,
  list_sum(list_sort(list(oi) filter (where option_type='CE'),'DESC')[1:3])::double as c3, list_sum(list_sort(list(oi) filter (where option_type='PE'),'DESC')[1:3])::double as p3 from {{c}} group by 1,2,3),
cf as (select ag.symbol, ag.snap_date, ag.expiry, atm_strike, ce+pe as straddle_premium, (ce+pe)/atm_strike*100 as straddle_pct, ce/greatest(pe,0.01) as ce_pe_ratio, tp/greatest(tc,1) as pcr_oi,
  c3/greatest(tc,1) as oi_conc_ce, p3/greatest(tp,1) as oi_conc_pe, co/greatest(po::double,1) as atm_oi_ratio from ag join lg on lg.symbol=ag.symbol and lg.snap_date=ag.snap_date and lg.expiry=ag.expiry and lg.strike=ag.atm_strike
  join tt on tt.symbol=ag.symbol and tt.snap_date=ag.snap_date and tt.expiry=ag.expiry where ce+pe >= 1)"""


@query("opt14_chain_features", f"{K} atm_strike:1 straddle_premium:2 straddle_pct:6 ce_pe_ratio:4 pcr_oi:5 oi_conc_ce:5 oi_conc_pe:5 atm_oi_ratio:4",
       f"with {CF_SQL.format(legs=legs(), c='chain')} select * from cf")
def _opt14(t):
    return O.chain_features(t.chain)


STEP_SQL = """lq as (select * from {c} where option_type='CE' and oi > {oi}), lc as (select symbol, expiry, count(*) as n from lq group by 1,2),
sg as (select symbol, expiry, strike-lag(strike) over (partition by symbol, expiry order by strike) as g from (select distinct symbol, expiry, strike from lq) z),
sm as (select symbol, expiry, arg_min(g, (-n)*1000000+g) as g from (select symbol, expiry, g, count(*) as n from sg where g > 0 group by 1,2,3) z group by 1,2),
ss as (select k.symbol, k.expiry, case when n >= 3 then coalesce(sm.g,50.0::double) else 50.0::double end as strike_step from (select distinct symbol, expiry from {c}) k left join lc using (symbol, expiry) left join sm using (symbol, expiry))"""


@query("opt15_strike_step", "symbol:l expiry:d strike_step:1", f"with {STEP_SQL.format(c='chain', oi=1000)} select * from ss")
def _opt15(t):
    return O.strike_step(t.chain)


SPREAD_SQL = "ch as (select * from {c} where ltp > 0.05), " + legs("ch") + ", " + STEP_SQL.format(c="ch", oi=1000) + f""",
ag as (select symbol, snap_date, expiry, arg_min(strike, abs(ce-pe)*1000000+strike) as atm from bl where ce>0.5 and pe>0.5 group by 1,2,3 having count(*) >= 2),
pd as (select symbol, snap_date as cur, lag(snap_date) over (partition by symbol order by snap_date) as prev from (select distinct symbol, snap_date from ch) z),
gr(strategy, short_n, wing_m) as (select s, a, b from (values ('iron_condor'),('bull_put'),('bear_call')) x(s), (values (1),(2),(3),(4)) y(a), (values (1),(2),(3),(4)) z(b) union all select 'iron_fly', 0, 4),
jj as (select ag.symbol, ag.expiry, ag.snap_date as entry_date, pd.cur as exit_date, atm, strike_step as st, gr.*, strategy <> 'bull_put' as hc, strategy <> 'bear_call' as hp,
  atm+short_n*strike_step as k1, atm-short_n*strike_step as k2, atm+(short_n+wing_m)*strike_step as k3, atm-(short_n+wing_m)*strike_step as k4
  from ag join pd on pd.symbol=ag.symbol and pd.prev=ag.snap_date join ss on ss.symbol=ag.symbol and ss.expiry=ag.expiry, gr where pd.cur <= ag.expiry and ag.expiry-pd.cur <= {{dte}}),
lj as (select jj.*, e1.ltp as a1, e2.ltp as a2, e3.ltp as a3, e4.ltp as a4, x1.ltp as b1, x2.ltp as b2, x3.ltp as b3, x4.ltp as b4, strategy='iron_fly' and exit_date=jj.expiry as fd from jj
""" + "".join(
    f" left join ch {p}{i} on {p}{i}.symbol=jj.symbol and {p}{i}.expiry=jj.expiry and {p}{i}.snap_date=jj.{d} and {p}{i}.strike=jj.k{i} and {p}{i}.option_type='{o}'"
    for p, d in (("e", "entry_date"), ("x", "exit_date")) for i, o in ((1, "CE"), (2, "PE"), (3, "CE"), (4, "PE"))) + """),
lf as (select *, case when hc then a1 else 0 end as e1, case when hp then a2 else 0 end as e2, case when hc then a3 else 0 end as e3, case when hp then a4 else 0 end as e4,
  case when not hc then 0 when fd then coalesce(b1,0) else b1 end as x1, case when not hp then 0 when fd then coalesce(b2,0) else b2 end as x2, case when not hc then 0 when fd then coalesce(b3,0) else b3 end as x3,
  case when not hp then 0 when fd then coalesce(b4,0) else b4 end as x4 from lj),
tr as (select *, e1+e2-(e3+e4) as net_credit, x1+x2-(x3+x4) as exit_cost, wing_m*st-(e1+e2-(e3+e4)) as max_loss from lf where (not hc or (a1>=0.05 and a3>=0.05)) and (not hp or (a2>=0.05 and a4>=0.05)) and x1+x2+x3+x4 is not null and e1+e2-(e3+e4) > 0),
sb as (select *, case when max_loss > 0 then greatest(net_credit-exit_cost, -max_loss) else net_credit-exit_cost end as pnl_pts from tr)"""


def _spreads(t):
    return SP.price_spreads(t.stored("chain_w"), max_dte=100)


@query("opt16_spread_pricing", "symbol:l expiry:d entry_date:d exit_date:d strategy:s short_n:i wing_m:i strike_step:1 atm_strike:1 short_ce_entry:2 short_pe_entry:2 long_ce_entry:2 long_pe_entry:2 net_credit:2 max_loss:2 exit_cost:2 pnl_pts:2 pnl_pct:4 target:i",
       f"""with {SPREAD_SQL.format(c='chain_w', dte=100)} select *, st as strike_step, atm as atm_strike, e1 as short_ce_entry, e2 as short_pe_entry, e3 as long_ce_entry, e4 as long_pe_entry,
       pnl_pts/(wing_m*st)*100 as pnl_pct, case when pnl_pts > 0 then 1 else 0 end as target from sb""")
def _opt16(t):
    return _spreads(t)


@query("opt16b_spread_pricing_daily", "symbol:l expiry:d entry_date:d strategy:s short_n:i wing_m:i net_credit:2 max_loss:2 exit_cost:2 pnl_pts:2",
       f"with {SPREAD_SQL.format(c='chain_d', dte=5)} select * from sb")
def _opt16b(t):
    return SP.price_spreads(t.chain_d)


OPTIMAL_SQL = """op as (select symbol, strategy, short_n, wing_m, count(*) as n_trades, avg(case when pnl_pts > 0 then 1.0::double else 0 end) as win_rate, avg(pnl_pts) as avg_pnl_pts, coalesce(avg(nullif(pnl_pts,0)/(wing_m*st)*100),0) as avg_pnl_pct,
  avg(pnl_pts)/(stddev_pop(pnl_pts)+1e-9) as sharpe_pct, avg(net_credit) as avg_net_credit, avg(max_loss) as avg_max_loss, avg(net_credit)*100/(wing_m*any_value(st)) as premium_to_risk from sb group by 1,2,3,4 having count(*) >= 5)"""


@query("opt17_optimal_params", "symbol:l strategy:s short_n:i wing_m:i n_trades:l win_rate:4 avg_pnl_pts:4 avg_pnl_pct:4 sharpe_pct:4 avg_net_credit:4 avg_max_loss:4 premium_to_risk:4",
       f"with {SPREAD_SQL.format(c='chain_w', dte=100)}, {OPTIMAL_SQL} select * from op")
def _opt17(t):
    return SP.optimal_params(_spreads(t))


@query("opt18_bias_and_suggestion", "symbol:l snap_date:d bias:s strategy:s rec_call:1 rec_put:1",
       f"""with {EOD_SQL}, pv as (select *, last_value(nullif(spot,0) ignore nulls) over (order by date rows between unbounded preceding and 1 preceding) as q from vix), rg as (select date, case when q>0 and spot>0 and spot>q then 'up' when q>0 and spot>0 then 'down' else 'flat' end as trend from pv),
       sk as (select symbol, snap_date, pcr, spot, list(pcr) over w as a, min(pcr) over w as lo, max(pcr) over w as hi from eod window w as (partition by symbol order by snap_date rows 251 preceding)),
       b as (select s.*, case when hi>lo then (pcr-lo)/(hi-lo)*100 else 50 end > 60 as rich, round_even(spot/50,0)*50 as atm, case when pcr>1.3 then 'bullish' when pcr<0.7 then 'bearish' when trend='up' then 'bullish' when trend='down' then 'bearish' else 'neutral' end as bias
         from sk s left join rg on rg.date=s.snap_date)
       select symbol, snap_date, bias, case when bias='bullish' and rich then 'bull_put_spread' when bias='bullish' then 'buy_call' when rich then 'bear_call_spread' else 'buy_put' end as strategy,
       case when bias='bullish' and not rich then atm when bias='bearish' and rich then atm+50 else 0 end as rec_call, case when bias='bullish' and rich then atm-50 when bias='bearish' and not rich then atm else 0 end as rec_put from b where bias <> 'neutral'""")
def _opt18(t):
    from tidebook.operators.rolling import Series
    from tidebook.plans.patterns import regime_table
    eod = O.eod_summary(t.chain)
    s = Series(["symbol"], "snap_date")
    rank = eod.select("symbol", "snap_date", s.minmax_rank("pcr").alias("iv_rank"))
    return O.suggestions(eod, regime_table(t.vix), rank)


def signals_sql(c: str) -> str:
    """The measured signals of a chain's nearest expiry, as CTE ``sgm``; needs a recursive WITH."""
    put, call = "filter (where option_type='PE')", "filter (where option_type='CE')"
    return f"""ml as (select symbol, snap_date, expiry, strike, max(ltp) {call} as ce, max(ltp) {put} as pe from {c} group by 1,2,3,4),
mx as (select symbol, snap_date, expiry, arg_min(strike+ce-pe, abs(ce-pe)*1000000+strike) as spot from ml where ce is not null and pe is not null group by 1,2,3),
mk as (select symbol, snap_date, min(expiry) as expiry from {c} where expiry >= snap_date group by 1,2), mn as (select c.* from {c} c join mk using ({G})),
mc as (select c.*, spot, row_number() over (order by symbol, snap_date, expiry, strike, option_type) as id, spot as s, strike as k, (expiry-snap_date)/365.0::double as t, ltp as p, option_type='CE' as call from {c} c join mx using ({G})),
mb as (select mc.* from mc join mk using ({G}) where abs(strike-spot) <= spot*0.02), {iv_sql('historical', 'mb', 'mh')},
ma as (select symbol, snap_date, expiry, coalesce(median(iv) {call},0)*100 as c, coalesce(median(iv) {put},0)*100 as p from mb left join mhf using (id) group by 1,2,3),
mi as (select symbol, snap_date, expiry, case when c > 0 then c else p end as atm_iv from ma where c > 0 or p > 0),
mj as (select *, min(atm_iv) over w as lo, max(atm_iv) over w as hi from mi window w as (partition by symbol order by snap_date rows 251 preceding)),
mo as (select mc.* from mc join mk using ({G}) where t > 0 and ((option_type='PE' and strike >= spot*0.97 and strike < spot) or (option_type='CE' and strike > spot and strike <= spot*1.03))), {iv_sql('skew', 'mo', 'mw')},
ms as (select symbol, snap_date, expiry, coalesce((median(iv) {put} - median(iv) {call})*100,0) as iv_skew from mo left join mwf using (id) group by 1,2,3),
{iv_sql('greeks', 'mc', 'mg')},
mf as (select mc.*, iv, expiry-snap_date as dte, strike/spot as moneyness from mc join mgf using (id) where iv > 0 and ltp >= 5 and expiry >= snap_date and strike/spot between 0.8 and 1.2),
mq as (select symbol, snap_date, dte, avg(iv) as iv from mf where moneyness between 0.99 and 1.01 group by 1,2,3),
mt as (select symbol, snap_date, x, count(*) as n, max(dte) filter (where dte <= x) as l, arg_max(iv, dte) filter (where dte <= x) as li, min(dte) filter (where dte >= x) as h, arg_min(iv, dte) filter (where dte >= x) as hi
  from mq, (values (7),(30)) tg(x) group by 1,2,3 having count(*) >= 2),
mv as (select symbol, snap_date, x, case when l is null then hi when h is null then li when l = h then li else li*(1-(x-l)/(h-l)::double)+hi*(x-l)/(h-l)::double end as iv from mt),
md as (select symbol, snap_date, max(iv) filter (where x=30) - max(iv) filter (where x=7) as term_slope from mv group by 1,2),
me as (select symbol, snap_date, {_skew(0.98)} as skew_2pct from mf group by 1,2),
mp_ as ({_PCR.format(c='mn')}), {_WALL.format(c='mn').replace('wl as', 'mwl as', 1)},
sgm as (select q.*, case when total_ce_oi > 0 then total_pe_oi/total_ce_oi::double else 0 end as pcr, ce_wall_strike, pe_wall_strike, mx.spot, atm_iv, case when hi > lo then (atm_iv-lo)/(hi-lo)*100 when hi is not null then 50 end as iv_rank,
  iv_skew, term_slope, case when term_slope is not null then skew_2pct end as skew_2pct, v.vix
  from mp_ q left join mwl using ({G}) left join mx using ({G}) left join mj using ({G}) left join ms using ({G}) left join md on md.symbol=q.symbol and md.snap_date=q.snap_date
  left join me on me.symbol=q.symbol and me.snap_date=q.snap_date left join vix v on v.date=q.snap_date)"""


#: Signals as a decision reads them (``sgn``): an unknown rank is the middle, an unknown skew or slope flat.
NEUTRAL_SQL = "sgn as (select * replace (coalesce(iv_rank,50) as iv_rank, coalesce(iv_skew,0) as iv_skew, coalesce(term_slope,0) as term_slope, coalesce(skew_2pct,0) as skew_2pct) from sgm)"
#: The rule scorecard with the inputs that a chain and the volatility index show; all others are neutral.
RULE_CONF_SQL = "100*greatest(0.0::double,least(1.0::double,(50 + case when iv_rank>70 then 12 when iv_rank>50 then 6 when iv_rank<25 then -8 else 0 end + case when vix is null then 4 when vix<=0 then 0 when vix<13 then 10 when vix<17 then 4 when vix>28 then -16 when vix>22 then -8 else 0 end)/100.0::double))"


def _signals(t):
    return O.neutral_signals(O.measured_signals(t.stored("chain"), t.vix))


@query("opt19_structure_choice", "symbol:l snap_date:d pcr:6 iv_skew:3 skew_2pct:5 strategy:s",
       f"""with recursive {signals_sql('chain')}, {NEUTRAL_SQL} select *, case when pcr>1.2 and not iv_skew < -2 then 'bull_put' when pcr<0.8 and not iv_skew > 2 then 'bear_call' when skew_2pct>0.02 and not iv_skew < -2 then 'bull_put' else 'iron_condor' end as strategy from sgn""")
def _opt19(t):
    from tidebook.functions.market import pick_structure
    return _signals(t).withColumn("strategy", pick_structure("pcr", "iv_skew", "skew_2pct"))


SCORE_SQL = """sc as (select *, least(conf,100)/100*40 as s_confidence, case when vix is null then 10 when vix between 14 and 22 then 20 when vix between 11 and 28 then 10 else 0 end as s_vix, least(iv_rank,100)/100*20 as s_iv_rank,
  case when (pcr>1.2 and iv_skew>2) or (pcr<0.8 and iv_skew < -2) then 20 when pcr>1.2 or pcr<0.8 then 10 else 0 end as s_alignment, case when term_slope between -0.04::double and -0.01::double then 3 else 0 end as s_term_slope from {src}),
so as (select *, s_confidence+s_vix+s_iv_rank+s_alignment+s_term_slope as score from sc)"""


@query("opt20_trade_score", "symbol:l snap_date:d s_confidence:3 s_vix:1 s_iv_rank:3 s_alignment:1 s_term_slope:1 score:3 tradable:i",
       f"""with recursive {signals_sql('chain')}, {NEUTRAL_SQL}, si as (select *, {RULE_CONF_SQL} as conf from sgn), {SCORE_SQL.format(src='si')} select *, case when score >= 65 and (vix is null or vix between 11 and 28) then 1 else 0 end as tradable from so""")
def _opt20(t):
    """The confidence is the rule scorecard's, from the signals themselves."""
    from tidebook.functions.exprs import flag
    from tidebook.functions.market import SCORE_THRESHOLD, scorecard, trade_score
    n = F.lit
    d = _signals(t).withColumn("conf", scorecard("iv_rank", F.coalesce("vix", n(15.0)), n(50.0), n(1.0), n(1.2), n(0)) * 100)
    d = d.withColumns(trade_score("conf", "vix", "iv_rank", "pcr", "iv_skew", "term_slope"))
    return d.withColumn("tradable", flag((F.col("score") >= SCORE_THRESHOLD) & (F.col("vix").isNull() | F.col("vix").between(11, 28))))


def _recommend_inputs(t):
    """Recommendations are made on Thursdays, from Monday's snapshots."""
    chain = t.stored("chain_w")
    days = chain.select("symbol", F.date_add("snap_date", 3).alias("rec_date"), "expiry").distinct()
    trades = cut_lineage(_spreads(t), "spreads")
    return days, SP.track_record(trades, 50), chain, O.neutral_signals(O.measured_signals(chain, t.vix)), trades


REC_SQL = SPREAD_SQL.format(c="chain_w", dte=100) + ", " + OPTIMAL_SQL + f""", {signals_sql('chain_w')}, {NEUTRAL_SQL},
bp as (select * from (select *, row_number() over (partition by symbol, strategy order by sharpe_pct desc, short_n, wing_m) as z from op where n_trades >= 10) q where z = 1),
dt as (select symbol, strategy, exit_date, sum(case when pnl_pts > 0 then 1 else 0 end) as w, count(*) as n, sum(pnl_pts) filter (where pnl_pts > 0) as p from sb group by 1,2,3),
dw as (select symbol, exit_date, sum(w) as w, sum(p) as p from dt group by 1,2),
cd as (select dt.symbol, dt.exit_date as score_date, strategy as strategy_type, (select sum(w)*100 from dt x where x.symbol=dt.symbol and x.strategy=dt.strategy and x.exit_date<=dt.exit_date)::double
    / (select sum(n) from dt x where x.symbol=dt.symbol and x.strategy=dt.strategy and x.exit_date<=dt.exit_date) as confidence,
  (select sum(p)*50/nullif(sum(w),0) from dw x where x.symbol=dt.symbol and x.exit_date<=dt.exit_date) as avg_win from dt),
rd as (select distinct symbol, snap_date+3 as rec_date, expiry from chain_w where snap_date+3 <= expiry),
rn as (select rd.*, (select max(snap_date) from chain_w c where c.symbol=rd.symbol and c.expiry=rd.expiry and c.ltp > 0.05 and c.snap_date <= rd.rec_date) as snap_date from rd),
wt as (select rn.*, k as strategy_type from rn, (values ('iron_condor'),('bull_put'),('bear_call'),('iron_fly')) q(k) where snap_date is not null),
ws as (select wt.*, cd.confidence, cd.score_date, cd.avg_win from wt asof left join cd on wt.symbol=cd.symbol and wt.strategy_type=cd.strategy_type and wt.rec_date >= cd.score_date),
wb as (select * from (select *, row_number() over (partition by symbol, rec_date, expiry order by confidence desc, strategy_type desc) as z from ws where rec_date-score_date <= 7 and confidence is not null) q where z=1),
wv as (select wb.symbol, rec_date, wb.expiry, wb.snap_date, strategy_type, confidence, avg_win, confidence as conf, pcr, vix, iv_skew, skew_2pct, iv_rank, term_slope, ce_wall_strike, pe_wall_strike from wb join sgn on sgn.symbol=wb.symbol and sgn.snap_date=wb.snap_date and sgn.expiry=wb.expiry),
{SCORE_SQL.format(src='wv')},
rs as (select *, case when confidence >= 60 then strategy_type when pcr>1.2 and not iv_skew < -2 then 'bull_put' when pcr<0.8 and not iv_skew > 2 then 'bear_call' when skew_2pct>0.02 and not iv_skew < -2 then 'bull_put' else 'iron_condor' end as strat
  from so where score >= 65 and (vix is null or vix between 11 and 28)),
rp as (select rs.*, rs.strat as strategy, bp.short_n, bp.wing_m, avg_max_loss, case when avg_max_loss>0 then floor(1000000*0.02/(avg_max_loss*50)) else 1 end as bl0 from rs join bp on bp.symbol=rs.symbol and bp.strategy=rs.strat),
a2 as (select symbol, snap_date, expiry, arg_min(strike, abs(ce-pe)*1000000+strike) as atm from bl where ce>0 and pe>0 group by 1,2,3),
zs as (select symbol, expiry, arg_min(g, (-n)*1000000+g) as g from (select symbol, expiry, g, count(*) as n from (select symbol, expiry, strike-lag(strike) over (partition by symbol, expiry order by strike) as g from (select distinct symbol, expiry, strike from ch where option_type='CE') a) b where g > 0 group by 1,2,3) c group by 1,2),
zn as (select symbol, expiry, count(*) as n from ch where option_type='CE' group by 1,2),
rq as (select rp.*, atm, case when zn.n >= 3 then coalesce(zs.g,50) else 50 end as st, least(greatest(1,floor(bl0*(0.5+iv_rank/100))), case when avg_max_loss>0 and avg_win>0 then greatest(1,floor(avg_win/(avg_max_loss*50))) end) as lots,
  strategy in ('iron_condor','bear_call') as cside, strategy in ('iron_condor','bull_put') as pside from rp join a2 on a2.symbol=rp.symbol and a2.snap_date=rp.snap_date and a2.expiry=rp.expiry
  left join zn on zn.symbol=rp.symbol and zn.expiry=rp.expiry left join zs on zs.symbol=rp.symbol and zs.expiry=rp.expiry),
ru as (select *, atm+short_n*st as sce, atm-short_n*st as spe from rq),
rr as (select ru.*, coalesce(p1.ltp,0)+coalesce(p2.ltp,0)-(case when cside then coalesce(p3.ltp,0) else 0 end)-(case when pside then coalesce(p4.ltp,0) else 0 end) as net_credit from ru
  left join ch p1 on p1.symbol=ru.symbol and p1.snap_date=ru.snap_date and p1.expiry=ru.expiry and p1.strike=sce and p1.option_type='CE' left join ch p2 on p2.symbol=ru.symbol and p2.snap_date=ru.snap_date and p2.expiry=ru.expiry and p2.strike=spe and p2.option_type='PE'
  left join ch p3 on p3.symbol=ru.symbol and p3.snap_date=ru.snap_date and p3.expiry=ru.expiry and p3.strike=sce+wing_m*st and p3.option_type='CE' left join ch p4 on p4.symbol=ru.symbol and p4.snap_date=ru.snap_date and p4.expiry=ru.expiry and p4.strike=spe-wing_m*st and p4.option_type='PE'
  where not ((cside and ce_wall_strike > 0 and sce < ce_wall_strike) or (pside and pe_wall_strike > 0 and spe > pe_wall_strike)))"""


def _recommend(t):
    """Recommendations and the priced trades they rest on."""
    days, scores, chain, signals, trades = _recommend_inputs(t)
    return SP.recommend(days, scores, chain, signals, SP.optimal_params(trades), capital=1_000_000.0, lot_size=50), trades


@query("opt21_recommendations", "symbol:l rec_date:d snap_date:d expiry:d strategy:s short_n:i wing_m:i confidence:1 score:3 atm_strike:1 short_ce_strike:1 short_pe_strike:1 net_credit:2 lots:i",
       f"with recursive {REC_SQL} select *, atm as atm_strike, sce as short_ce_strike, spe as short_pe_strike from rr")
def _opt21(t):
    return _recommend(t)[0]


@query("opt22_fill_outcomes", "symbol:l rec_date:d expiry:d strategy:s outcome:s pnl_pts:2 pnl_amount:2",
       f"""with recursive {REC_SQL} select rr.symbol, rec_date, rr.expiry, rr.strategy, case when sb.pnl_pts is null or rr.expiry >= date '2001-01-01' then 'pending' when sb.pnl_pts > 0 then 'win' else 'loss' end as outcome,
       case when rr.expiry < date '2001-01-01' then coalesce(sb.pnl_pts,0) else 0 end as pnl_pts, case when rr.expiry < date '2001-01-01' then coalesce(sb.pnl_pts*lots*50,0) else 0 end as pnl_amount
       from rr left join sb on sb.symbol=rr.symbol and sb.expiry=rr.expiry and sb.strategy=rr.strategy and sb.short_n=rr.short_n and sb.wing_m=rr.wing_m and sb.entry_date=rr.snap_date""")
def _opt22(t):
    return SP.fill_outcomes(*_recommend(t), F.to_date(F.lit("2001-01-01")), 50)
