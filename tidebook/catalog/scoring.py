"""Scoring queries. Model fits have no SQL twin; their inputs and the metrics
on their output do."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.options import CF_SQL, EOD_PARTS_SQL, EOD_SQL, LEGS, SPREAD_SQL, G, legs, signals_sql
from tidebook.catalog.registry import query
from tidebook.catalog.trades import ENDB_SQL
from tidebook.catalog.windows import RISK_SQL
from tidebook.functions.exprs import flag
from tidebook.plans import options as O
from tidebook.plans import patterns as P
from tidebook.plans import scoring as SC
from tidebook.plans import spreads as SP
from tidebook.plans import walkforward as WF
from tidebook.session import shared_dir


def _participants(t):
    """Flow rows in the participant-position layout."""
    v = F.abs(F.col("net_value")).cast("bigint")
    ent = F.when(F.col("entity") == "1-URGENT", "Client").when(F.col("entity") == "2-HIGH", "FII").otherwise("Pro")
    return t.flows.select("date", ent.alias("entity"), (v % 1000).alias("opt_index_call_long"), (v % 700).alias("opt_index_call_short"), (v % 900).alias("opt_index_put_long"),
                          (v % 800).alias("opt_index_put_short"))


def _day_inputs(t, chain):
    """The inputs that are known once a day."""
    from tidebook.session import cut_lineage
    surf = cut_lineage(O.vol_surface(chain), "surface")
    return (O.eod_summary(chain), O.atm_iv_daily(chain), O.iv_skew(chain), O.term_structure(surf), SC.technical_signals(t.index_bars),
            SC.participant_features(_participants(t)), t.vix, t.market_events.where("impact = 'HIGH'"))


def _features(t, strategies=("iron_fly",)):
    chain = t.stored("chain_w")
    trades = SP.price_spreads(chain, max_dte=100).where(F.col("strategy").isin(*strategies)).select("symbol", "expiry", "entry_date", "net_credit", "pnl_pts", *(["strategy", "short_n", "wing_m"] if len(strategies) > 1 else []))
    return SC.feature_table(trades, chain, *_day_inputs(t, chain))


PRICED_SQL = f"""{SPREAD_SQL.format(c='chain_w', dte=100)}, {CF_SQL.format(legs=legs('chain_w').replace('lg as', 'lg_ as').replace('bl as', 'bl_ as').replace('sp as', 'sp_ as').replace('from lg ', 'from lg_ ').replace('from bl ', 'from bl_ '), c='chain_w').replace('ag as (select symbol, snap_date, expiry, arg_min(strike', 'ag_ as (select symbol, snap_date, expiry, arg_min(strike').replace('select ag.symbol', 'select ag_.symbol').replace('ag.', 'ag_.').replace('from ag join', 'from ag_ join').replace('from bl where', 'from bl_ where').replace('join lg on', 'join lg_ on').replace('lg.', 'lg_.')}"""


@query("ml01_feature_table", "symbol:l expiry:d entry_date:d pnl_pts:2 " + " ".join(f"{c}:4" for c in SC.FEATURES))
def _ml01(t):
    return _features(t)


@query("ml01b_feature_core", "symbol:l expiry:d entry_date:d pnl_pts:2 straddle_pct:5 ce_pe_ratio:4 pcr_oi:4 oi_conc_ce:4 atm_oi_ratio:4 straddle_z:4 pcr_eod:4 ce_wall_pct:4 pe_wall_pct:4 max_pain_dist_pct:4 vix:1 vix_z20:4 day_of_week:i week_of_month:i dte:0 event_in_window:i days_to_event:i client_call_net:1 fii_pcr:4",
       f"""with {PRICED_SQL},
       {EOD_SQL.replace('chain', 'chain_w').replace('lg as', 'lg2 as').replace('bl as', 'bl2 as').replace('sp as', 'sp2 as').replace('from lg ', 'from lg2 ').replace('from bl ', 'from bl2 ').replace('join sp using', 'join sp2 using')},
       fl as (select symbol, expiry, entry_date, net_credit, pnl_pts, expiry-entry_date as dte from sb where strategy='iron_fly'), ds as (select symbol, dte, avg(net_credit) as m, stddev_pop(net_credit) as s from fl group by 1,2),
       vz as (select date, vix, case when count(*) over v >= 20 then (vix-avg(vix) over v)/coalesce(nullif(stddev_samp(vix) over v,0),1) end as z from vix window v as (order by date rows 19 preceding)),
       he as (select distinct event_date from market_events where impact='HIGH'), ev as (select fl.symbol, fl.expiry, fl.entry_date, max(case when he.event_date <= fl.expiry then 1 else 0 end) as w, coalesce(least(min(he.event_date-fl.entry_date),30),30) as d from fl left join he on he.event_date >= fl.entry_date group by 1,2,3),
       po as (select date, max(case when entity='1-URGENT' then v%1000-v%700 end) as client_call_net, max(case when entity='2-HIGH' then (v%900+v%800)/greatest(v%1000+v%700,1)::double end) as fii_pcr from (select date, entity, cast(trunc(abs(net_value)) as bigint) as v from flows) z group by 1)
       select fl.symbol, fl.expiry, fl.entry_date, fl.pnl_pts, cf.straddle_pct, cf.ce_pe_ratio, cf.pcr_oi, cf.oi_conc_ce, cf.atm_oi_ratio, case when fl.net_credit is not null then (fl.net_credit-m)/nullif(s,0) end as straddle_z, eod.pcr as pcr_eod, (eod.ce_wall_strike-eod.spot)*100/nullif(eod.spot,0) as ce_wall_pct,
       (eod.spot-eod.pe_wall_strike)*100/nullif(eod.spot,0) as pe_wall_pct, (eod.max_pain_strike-eod.spot)*100/nullif(eod.spot,0) as max_pain_dist_pct, vz.vix, vz.z as vix_z20, extract(isodow from fl.expiry)-1 as day_of_week, (extract(day from fl.expiry)-1)//7+1 as week_of_month, fl.dte,
       ev.w as event_in_window, ev.d as days_to_event, client_call_net, fii_pcr
       from fl join cf on cf.symbol=fl.symbol and cf.snap_date=fl.entry_date and cf.expiry=fl.expiry left join ds on ds.symbol=fl.symbol and ds.dte=fl.dte left join eod on eod.symbol=fl.symbol and eod.snap_date=fl.entry_date
       left join vz on vz.date=fl.entry_date left join ev on ev.symbol=fl.symbol and ev.expiry=fl.expiry and ev.entry_date=fl.entry_date left join po on po.date=fl.entry_date""")
def _ml01b(t):
    return _features(t)


@query("ml02_label", "trade_id:l margin:2 target:i",
       "with m as (select trade_id, pnl_pts, lot_size, case when conf>40 then conf/100*24000*sqrt(1/252.0::double)*lot_size*3 else 0 end as margin from outcomes) select trade_id, margin, case when margin>0 then (case when pnl_pts*lot_size >= 0.01*margin then 1 else 0 end) when pnl_pts>0 then 1 else 0 end as target from m")
def _ml02(t):
    from tidebook.functions.market import margin_estimate
    iv = F.when(F.col("conf") > 40, F.col("conf") / 100)
    d = t.outcomes.withColumn("margin", margin_estimate(iv, iv, F.lit(24000.0), F.col("lot_size"), F.lit(0.0)))
    return d.withColumn("target", SC.label(d, "pnl_pts", F.col("lot_size"), F.col("margin")))


@query("ml03_straddle_zscore", "symbol:l expiry:d entry_date:d strategy:s short_n:i wing_m:i straddle_z:4",
       f"with {SPREAD_SQL.format(c='chain_w', dte=100)}, d as (select *, expiry-entry_date as dte from sb), s as (select symbol, dte, avg(net_credit) as m, stddev_pop(net_credit) as s from d where net_credit>0 group by 1,2) select d.*, (net_credit-m)/nullif(s,0) as straddle_z from d left join s using (symbol, dte)")
def _ml03(t):
    return SC.straddle_zscore(SP.price_spreads(t.chain_w, max_dte=100))


BAR_FEATURES = ["rsi_14", "price_vs_sma20", "volume_z20", "bb_position", "return_5d", "drawdown_pct"]


def _bar_dataset(t):
    """Bar features with the next day's direction as the label."""
    f = P.price_features(t.bars)
    nxt = P.BARS.lead("close")
    return f.withColumn("target", flag(nxt > F.col("close"))).withColumn("_n", nxt).where("_n is not null and n_hist >= 30").drop("_n").select("symbol", "date", *BAR_FEATURES, "target")


def _walk(t):
    return SC.walk_forward(_bar_dataset(t), "date", BAR_FEATURES, "lr", train_months=24, test_months=24)


@query("ml04_walk_forward", "symbol:s date:d target:i fold:i confidence:4")
def _ml04(t):
    return _walk(t)


@query("ml05_final_model_scores", "symbol:s date:d target:i confidence:4")
def _ml05(t):
    """Fit, save, load and score: the stored pipeline carries its feature list."""
    from pyspark.ml import PipelineModel

    from tidebook.session import cut_lineage, shared_dir
    d = SC._ready(cut_lineage(_bar_dataset(t), "final-input"), BAR_FEATURES)
    path = shared_dir(t.spark, "model")
    SC.final_model(d, BAR_FEATURES, "lr").write().overwrite().save(path)
    return SC.score(PipelineModel.load(path), d)


@query("ml06_score_latest", "symbol:s date:d confidence:4")
def _ml06(t):
    """Pooled boosted trees with symbol columns, scored on the newest row of each symbol."""
    from tidebook.operators.dedup import latest_by
    from tidebook.session import cut_lineage
    d = cut_lineage(_bar_dataset(t), "score-input")
    p = SC._ready(d, BAR_FEATURES)
    model = SC.final_model(p, BAR_FEATURES, "gbt", category="symbol")
    return SC.score(model, latest_by(p, ["symbol"], ["date"]))


@query("ml07_rank_auc", "model:s n_pos:l n_neg:l auc:6 best:i",
       """with s as (select 'k' as model, conf/100 as c, case when pnl_pts>=0 then 1 else 0 end as y from outcomes union all select 'lots', lots/4.0::double, case when pnl_pts>=0 then 1 else 0 end from outcomes),
       r as (select *, rank() over (partition by model order by c) + (count(*) over (partition by model, c)-1)/2.0::double as ar from s), a as (select model, sum(y) as n_pos, count(*)-sum(y) as n_neg, (sum(case when y=1 then ar end)-sum(y)*(sum(y)+1)/2.0::double)/(sum(y)*(count(*)-sum(y))) as auc from r group by 1)
       select *, case when auc = (select max(auc) from a) then 1 else 0 end as best from a""")
def _ml07(t):
    y = flag(F.col("pnl_pts") >= 0).alias("target")
    a = t.outcomes.select(F.lit("k").alias("model"), (F.col("conf") / 100).alias("confidence"), y)
    return SC.compare_models(a.unionByName(t.outcomes.select(F.lit("lots").alias("model"), (F.col("lots") / 4.0).alias("confidence"), y)))


@query("ml08_scorecard", "trade_id:l confidence:4",
       """with f as (select trade_id, conf as iv, conf/3 as vix, entry_premium as atr, entry_premium/60 as hv, conf/60 as ih, trade_id%2 as ev from outcomes)
       select trade_id, greatest(0.0::double,least(1.0::double,(50 + case when iv>70 then 12 when iv>50 then 6 when iv<25 then -8 else 0 end + case when vix<=0 then 0 when vix<13 then 10 when vix<17 then 4 when vix>28 then -16 when vix>22 then -8 else 0 end
       + case when atr<30 then 8 when atr>70 then -8 else 0 end + case when hv>1.3 then -10 when hv<0.8 then 6 else 0 end + case when ih<=0 then 0 when ih>1.5 then 8 when ih<0.8 then -6 else 0 end + case when ev=1 then 4 else 0 end)/100.0::double)) as confidence from f""")
def _ml08(t):
    p, c = F.col("entry_premium"), F.col("conf")
    f = t.outcomes.select("trade_id", c.alias("iv_rank"), (c / 3).alias("vix"), p.alias("atr_percentile"), (p / 60).alias("hv_ratio"), (c / 60).alias("iv_hv5_ratio"), (F.col("trade_id") % 2).alias("event_in_window"))
    return SC.scorecard_confidence(f)


def _scored(t):
    return t.outcomes.select("symbol", "exit_date", "pnl_pts", (F.col("conf") / 100).alias("confidence"), flag(F.col("pnl_pts") >= 0).alias("target"))


@query("ml09_calibration_sweep", "symbol:l threshold:i trades:l win_rate:4 avg_pnl:4 total_pnl:2 per_year:3",
       """with s as (select symbol, exit_date, pnl_pts, conf/100*100 as c, case when pnl_pts>=0 then 1 else 0 end as y from outcomes), d as (select symbol, max(exit_date)-min(exit_date) as dd from s group by 1)
       select s.symbol, x.t as threshold, count(*) as trades, avg(y)*100 as win_rate, avg(pnl_pts) as avg_pnl, sum(pnl_pts) as total_pnl, count(*)/(any_value(dd)/365.25::double) as per_year from s join d using (symbol), (values (50),(55),(60),(65),(70),(75),(80),(85),(90),(95)) x(t) where c >= x.t group by 1,2 having count(*)>=3""")
def _ml09(t):
    return SC.calibration_sweep(_scored(t), ["symbol"], "exit_date", "pnl_pts")


@query("ml09b_calibration_buckets", "symbol:l bucket:i n:l predicted:4 actual:4",
       "select symbol, least(floor(conf/100*10),9)*10 as bucket, count(*) as n, avg(conf/100)*100 as predicted, avg(case when pnl_pts>=0 then 1 else 0 end)*100 as actual from outcomes group by 1,2")
def _ml09b(t):
    return SC.calibration_buckets(_scored(t), ["symbol"])


@query("ml09c_band_win_rate", "n:l win_rate:5", "select count(*) as n, avg(case when pnl_pts>=0 then 1 else 0 end) as win_rate from outcomes where conf between 60 and 80")
def _ml09c(t):
    return SC.band_win_rate(_scored(t), 70)


@query("ml10_explanations", "trade_id:l reasons:s verdict:s",
       """select trade_id, concat_ws(',', case when conf>70 then '+iv_rich' when conf>50 then '+iv_above_average' when conf>0 and conf<25 then '-iv_cheap' when conf>0 then '!iv_moderate' end,
       case when conf/3<=0 then null when conf/3<13 then '+vix_calm' when conf/3<17 then '+vix_moderate' when conf/3<22 then '!vix_elevated' when conf/3<28 then '-vix_high' else '-vix_extreme' end,
       case when entry_premium<30 then '+narrow_ranges' when entry_premium>70 then '-wide_ranges' end, case when entry_premium/60>1.3 then '-vol_accelerating' when entry_premium/60<0.8 then '+vol_decelerating' end,
       case when lots*0.6::double>1.5 then '!put_heavy' when lots*0.6::double>0.7 and lots*0.6::double<1.3 then '+pcr_balanced' end, case when trade_id%2=1 then '+event_in_window' end) as reasons,
       case when conf<50 then 'SKIP' when conf<60 then 'BORDERLINE' when conf<75 then 'BUY' else 'STRONG BUY' end as verdict from outcomes""")
def _ml10(t):
    from tidebook.functions.market import verdict
    p, c = F.col("entry_premium"), F.col("conf")
    f = t.outcomes.select("trade_id", "conf", c.alias("iv_rank"), (c / 3).alias("vix"), p.alias("atr_percentile"), (p / 60).alias("hv_ratio"), (F.col("lots") * 0.6).alias("pcr_oi"), (F.col("trade_id") % 2).alias("event_in_window"))
    return SC.explain(f).select("trade_id", F.array_join("reasons", ",").alias("reasons"), verdict("conf").alias("verdict"))


@query("ml11_point_in_time", "symbol:s as_of:d vix:1 net_value:2 lot_size:i",
       """with k as (select distinct symbol, cast(date_trunc('month',date) as date)+14 as as_of from bars) select k.symbol, k.as_of, v.vix, f.net_value, l.lot_size from k asof left join vix v on k.as_of >= v.date asof left join day_flows f on k.as_of >= f.date asof left join lots l on k.symbol=l.symbol and k.as_of >= l.effective_from""")
def _ml11(t):
    keys = t.bars.select("symbol", F.date_add(F.trunc("date", "MM"), 14).alias("as_of")).distinct()
    return SC.point_in_time(keys, {"vix": (t.vix, "date", ["vix"]), "flow": (t.day_flows, "date", ["net_value"]), "lot": (t.lots, "effective_from", ["lot_size"])})


PAST_SQL = f"""{signals_sql('chain_w')}, ky as (select distinct symbol, cast(date_trunc('month', snap_date) as date)+14 as as_of from chain_v),
sh as (select ky.*, (select max(snap_date) from chain_v v where v.symbol=ky.symbol and v.known_at<=ky.as_of) as shot from ky),
nx as (select sh.*, (select min(expiry) from chain_v v where v.symbol=sh.symbol and v.snap_date=sh.shot and v.known_at<=sh.as_of and v.expiry>sh.as_of) as expiry from sh),
vr as (select * from (select nx.symbol, nx.as_of as snap_date, nx.shot, nx.expiry, v.strike, v.option_type, v.ltp, v.oi, v.known_at, row_number() over (partition by nx.symbol, nx.as_of, nx.expiry, v.strike, v.option_type order by known_at desc) as z
  from nx join chain_v v on v.symbol=nx.symbol and v.snap_date=nx.shot and v.expiry=nx.expiry and v.known_at<=nx.as_of) q where z=1),
{CF_SQL.format(legs=legs('vr'), c='vr')}, {EOD_PARTS_SQL.format(c='vr')},
iq as (select symbol, snap_date+10 as known, iv_rank from sgm where atm_iv is not null),
vd as (select symbol, snap_date, any_value(shot) as shot, any_value(expiry) as expiry from vr group by 1,2),
pq as (select date, max(case when entity='1-URGENT' then v%1000-v%700 end) as client_call_net, max(case when entity='2-HIGH' then (v%900+v%800)/greatest(v%1000+v%700,1)::double end) as fii_pcr from (select date, entity, cast(trunc(abs(net_value)) as bigint) as v from flows) z group by 1),
hv as (select distinct event_date as d from market_events where impact='HIGH'),
pf as (select vd.symbol, vd.snap_date as as_of, vd.shot as snap_date, vd.expiry, cf.straddle_pct, cf.ce_pe_ratio, cf.pcr_oi, cf.oi_conc_ce, cf.oi_conc_pe, cf.atm_oi_ratio, case when tc > 0 then tp/tc else 0 end as pcr_eod,
  (ce_wall_strike-coalesce(sp.spot,0))*100/nullif(sp.spot,0) as ce_wall_pct, (coalesce(sp.spot,0)-pe_wall_strike)*100/nullif(sp.spot,0) as pe_wall_pct, (max_pain_strike-sp.spot)*100/nullif(sp.spot,0) as max_pain_dist_pct,
  vx.vix, pq.client_call_net, pq.fii_pcr, iq.iv_rank, vd.expiry-vd.shot as dte, isodow(vd.expiry)-1 as day_of_week, (day(vd.expiry)-1)//7+1 as week_of_month,
  case when hv.d <= vd.expiry then 1 else 0 end as event_in_window, least(coalesce(hv.d-vd.shot,30),30) as days_to_event
  from vd join cf using ({G}) join tt using ({G}) left join sp using ({G}) left join wl using ({G}) left join mp using ({G}) asof left join vix vx on vd.shot >= vx.date asof left join pq on vd.shot >= pq.date
  asof left join iq on iq.symbol=vd.symbol and vd.snap_date >= iq.known asof left join hv on vd.shot <= hv.d)"""
PAST_OUT = "straddle_pct:5 ce_pe_ratio:4 pcr_oi:4 oi_conc_ce:4 oi_conc_pe:4 atm_oi_ratio:4 pcr_eod:4 ce_wall_pct:4 pe_wall_pct:4 max_pain_dist_pct:4 vix:1 client_call_net:1 fii_pcr:4 iv_rank:2 dte:i day_of_week:i week_of_month:i event_in_window:i days_to_event:i"


def _past_features(t):
    """Features as known on the 15th of each month; the IV history counts from the day its final chain was published."""
    versions, chain = t.stored("chain_v"), t.stored("chain_w")
    days = versions.select("symbol", F.date_add(F.trunc("snap_date", "MM"), 14).alias("as_of")).distinct()
    poi = _participants(t)
    iv = O.atm_iv_daily(chain).select("symbol", F.date_add("snap_date", 10).alias("known"), "iv_rank")
    daily = {"vix": (t.vix, "date", ["vix"]), "poi": (SC.participant_features(poi), "date", ["client_call_net", "fii_pcr"])}
    return SC.rebuild_features(days, versions, daily, {"iv": (iv, "known", ["iv_rank"])}, t.market_events.where("impact = 'HIGH'"))


@query("ml11b_rebuilt_features", f"symbol:l as_of:d snap_date:d expiry:d {PAST_OUT}", f"with recursive {PAST_SQL} select * from pf")
def _ml11b(t):
    return _past_features(t)


@query("ml11c_actual_outcomes", "symbol:l as_of:d snap_date:d expiry:d strategy:s short_n:i wing_m:i pnl_pts:2 straddle_pct:5 vix:1 iv_rank:2",
       f"""with recursive {PAST_SQL}, px as ({"select * from (with " + SPREAD_SQL.format(c='chain_w', dte=100) + " select symbol, expiry, entry_date, strategy, short_n, wing_m, pnl_pts from sb) y"}),
       py as (select * from (select *, row_number() over (partition by symbol, expiry, entry_date, strategy order by short_n, wing_m) as z from px) q where z=1)
       select pf.*, strategy, short_n, wing_m, pnl_pts from pf join py on py.symbol=pf.symbol and py.expiry=pf.expiry and py.entry_date=pf.snap_date""")
def _ml11c(t):
    return SC.actual_outcomes(_past_features(t), SP.price_spreads(t.stored("chain_w"), max_dte=100))


@query("udf01_rolling_closure", "scheme_code:l date:d sortino_1y:4", f"with {RISK_SQL} select * from rk")
def _udf01(t):
    """A function over a rolling window (std of the negative values only), as
    native window aggregates."""
    from tidebook.plans import funds as FU
    return FU.risk(t.nav, t.bench)


@query("udf02_group_function", "symbol:s n:l mean_ret:4",
       f"with recursive {ENDB_SQL} select symbol, count(*) as n, avg((exit_price/entry_price-1)*100) as mean_ret from eb group by 1")
def _udf02(t):
    """A frame-in, frame-out function per symbol."""
    from tidebook.plans.backtests import month_end_breakout
    return month_end_breakout(t.bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("return_pct").alias("mean_ret"))


@query("udf03_row_expansion", "feature_name:s n:l total:2", "select 'k' as feature_name, count(*) as n, sum(conf) as total from outcomes where conf is not null")
def _udf03(t):
    """One row per trade and feature."""
    from tidebook.plans.feedback import explode_features
    return explode_features(t.outcomes).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"), F.sum("feature_value").alias("total"))


@query("udf04_model_factory", "model:s n_pos:l n_neg:l best:i")
def _udf04(t):
    """The three model kinds behind one interface, compared by rank AUC."""
    from tidebook.session import cut_lineage
    d = cut_lineage(SC._ready(_bar_dataset(t), BAR_FEATURES), "factory-input")
    out = None
    for kind in ("lr", "gbt"):
        p = SC.score(SC.final_model(d, BAR_FEATURES, kind), d).select(F.lit(kind).alias("model"), "confidence", "target")
        out = p if out is None else out.unionByName(p)
    card = d.select(F.col("rsi_14").alias("iv_rank"), F.lit(15.0).alias("vix"), F.col("drawdown_pct").alias("atr_percentile"), F.lit(1.0).alias("hv_ratio"),
                    F.lit(1.2).alias("iv_hv5_ratio"), F.lit(0).alias("event_in_window"), "target")
    out = out.unionByName(SC.scorecard_confidence(card).select(F.lit("scorecard").alias("model"), "confidence", "target"))
    return SC.compare_models(out)




STRATEGIES = ("iron_fly", "iron_condor", "bull_put", "bear_call")
TRADE_KEY = ["expiry", "entry_date", "short_n", "wing_m"]


def _dataset(t):
    """The feature table of all strategies with the margin label."""
    from tidebook.functions.market import margin_estimate
    from tidebook.session import cut_lineage
    if "model_rows" not in t.__dict__:
        d = _features(t, STRATEGIES)
        margin = margin_estimate(F.col("atm_ce_iv"), F.col("atm_pe_iv"), F.col("_spot"), F.lit(50), F.col("straddle_pct"))
        t.__dict__["model_rows"] = cut_lineage(d.withColumn("target", SC.label(d, "pnl_pts", F.lit(50), margin)), "model-rows")
    return t.__dict__["model_rows"]


_FOLDS_SQL = f"""with {PRICED_SQL}, rw as (select sb.symbol, strategy, sb.expiry, entry_date, short_n, wing_m, year(entry_date)*12+month(entry_date)-1 as m from sb join cf on cf.symbol=sb.symbol and cf.snap_date=sb.entry_date and cf.expiry=sb.expiry where strategy in {STRATEGIES}),
nr as (select *, row_number() over (partition by symbol, strategy order by entry_date) as i from rw), st as (select symbol, strategy, min(m) as start from nr where i>60 group by 1,2),
ts as (select symbol, strategy, m as tm, count(*) as n_test from rw join st using (symbol, strategy) where m>=start group by 1,2,3),
fp as (select *, row_number() over (partition by symbol, strategy order by tm)-1 as fold from (select ts.*, (select count(*) from rw where rw.symbol=ts.symbol and rw.strategy=ts.strategy and rw.m between ts.tm-12 and ts.tm-1) as n_train from ts) z where n_train>=15)"""


@query("ml04b_fold_plan", "symbol:l strategy:s fold:i test_start:d n_train:l n_test:l",
       f"{_FOLDS_SQL} select symbol, strategy, fold, make_date(tm//12, tm%12+1, 1) as test_start, n_train, n_test from fp")
def _ml04b(t):
    return WF.fold_plan(_dataset(t), ["symbol", "strategy"], "entry_date")


@query("ml04c_out_of_fold_rows", "symbol:l strategy:s expiry:d entry_date:d short_n:i wing_m:i fold:i",
       f"{_FOLDS_SQL} select rw.symbol, rw.strategy, expiry, entry_date, short_n, wing_m, fold from rw join fp on fp.symbol=rw.symbol and fp.strategy=rw.strategy and fp.tm=rw.m")
def _ml04c(t):
    return WF.out_of_fold(_dataset(t), ["symbol", "strategy"], "entry_date", SC.FEATURES, TRADE_KEY)


@query("ml04d_out_of_fold_scores", "symbol:l strategy:s fold:i target:i confidence:4")
def _ml04d(t):
    return WF.out_of_fold(_dataset(t), ["symbol", "strategy"], "entry_date", SC.FEATURES, TRADE_KEY)


def _stored_models(t):
    """One model per strategy of the index and a pooled one, with metadata."""
    path = shared_dir(t.spark, "models")
    d = SC._ready(_dataset(t), SC.FEATURES)
    groups = [(0, s) for s in STRATEGIES]
    return path, WF.store_models(d, ["symbol", "strategy"], SC.FEATURES, "lr", path, [*groups, ()], category="strategy")


@query("ml05b_model_metadata", "model_key:s n_features:i n_train:l model_type:s is_pooled:i",
       f"{_FOLDS_SQL} select '0-' || strategy as model_key, 38 as n_features, count(*) as n_train, 'lr' as model_type, 0 as is_pooled from rw group by strategy having count(*) >= 60 union all select 'pooled', 38, count(*), 'lr', 1 from rw")
def _ml05b(t):
    _, meta = _stored_models(t)
    return meta.withColumn("n_features", F.size("features")).withColumn("is_pooled", F.col("is_pooled").cast("int"))


@query("udf04b_out_of_fold_models", "model:s n_pos:l n_neg:l auc:4 best:i")
def _udf04b(t):
    """Model kinds compared on rows that no fold trained on."""
    from tidebook.session import cut_lineage
    key = ["symbol", "strategy", *TRADE_KEY]
    scored = cut_lineage(WF.out_of_fold(_dataset(t), ["symbol", "strategy"], "entry_date", SC.FEATURES, TRADE_KEY), "out-of-fold")
    card = SC.scorecard_confidence(_dataset(t)).select(*key, "confidence").join(scored.select(*key, "target"), key)
    out = scored.select(F.lit("lr").alias("model"), "confidence", "target").unionByName(card.select(F.lit("scorecard").alias("model"), "confidence", "target"))
    return SC.compare_models(out)


def _live_tables(t):
    """Daily inputs as of each calendar day, straddle statistics, and the snapshots."""
    from tidebook.session import cut_lineage
    from tidebook.streaming.jobs import straddle_rows
    chain = t.stored("chain_w")
    eod, iv, _, term, tech, poi, vix, events = _day_inputs(t, chain)
    snap = {"snap_date": "date"}
    e = eod.withColumnsRenamed(snap)
    e = e.select("symbol", "date", F.col("pcr").alias("pcr_eod"), ((F.col("ce_wall_strike") - F.col("spot")) * 100 / F.col("spot")).alias("ce_wall_pct"), ((F.col("spot") - F.col("pe_wall_strike")) * 100 / F.col("spot")).alias("pe_wall_pct"),
                 ((F.col("max_pain_strike") - F.col("spot")) * 100 / F.col("spot")).alias("max_pain_dist_pct"))
    iv, term = iv.withColumnsRenamed(snap), term.withColumnsRenamed(snap)
    tech_cols = ["atr_percentile", "rsi14", "hv_ratio", "supertrend_dir", "cpr_width_pct", "adx14"]
    poi_cols = [c for c in poi.columns if c != "date"]
    days = WF.calendar(e)
    sources = {"eod": (e, "date", [c for c in e.columns if c not in ("symbol", "date")]), "iv": (iv, "date", ["iv_rank", "iv_percentile"]), "term": (term, "date", ["term_slope", "atm_iv_7d"]),
               "tech": (tech.drop("symbol"), "date", tech_cols), "poi": (poi, "date", poi_cols), "vix": (vix, "date", ["vix"])}
    daily = cut_lineage(WF.next_event(SC.point_in_time(days, sources), events), "daily-inputs")
    rows = straddle_rows(chain).join(iv.select("symbol", F.col("date").alias("snap_date"), "atm_ce_iv", "atm_pe_iv"), ["symbol", "snap_date"], "left")
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("snap_date").cast("timestamp")) + 36000)
    snaps = rows.select("symbol", ts.alias("ts"), "expiry", "strike", "straddle", F.coalesce("atm_ce_iv", F.lit(0.0)).alias("ce_iv"), F.coalesce("atm_pe_iv", F.lit(0.0)).alias("pe_iv"))
    stats = snaps.groupBy("symbol", F.datediff("expiry", F.to_date("ts")).alias("dte")).agg(F.avg("straddle").alias("_mean"), F.stddev_pop("straddle").alias("_std"))
    return daily, cut_lineage(stats, "straddle-stats"), cut_lineage(snaps, "live-snaps")


def _live_stream(t):
    """The snapshots as three files a month, read as a stream."""
    from tidebook.streaming.jobs import stream_parquet
    daily, stats, snaps = _live_tables(t)
    path = shared_dir(t.spark, "live")
    third = F.pmod(F.xxhash64("ts"), F.lit(3))
    snaps.repartition(6, F.trunc(F.to_date("ts"), "MM"), third).write.parquet(path)
    stream = stream_parquet(t.spark, path, snaps.schema, max_files=2)
    return daily, stats, snaps, stream


_LIVE_SQL = f"""with {LEGS.format(c='chain_w')}, rw as (select bl.*, row_number() over (partition by symbol, snap_date order by expiry, abs(ce-pe), strike) as z from bl), sn as (select symbol, snap_date, expiry, strike, ce+pe as straddle, expiry-snap_date as dte from rw where z=1),
       sa as (select symbol, dte, avg(straddle) as m, stddev_pop(straddle) as s from sn group by 1,2), ev as (select distinct event_date from market_events where impact='HIGH')
       select sn.symbol, sn.snap_date, sn.expiry, straddle/strike*100 as straddle_pct, sn.dte, case when s>0 and straddle>0 then (straddle-m)/s else 0 end as straddle_z, coalesce(v.vix,0) as vix, extract(isodow from sn.expiry)-1 as day_of_week,
       case when nx.d <= sn.expiry then 1 else 0 end as event_in_window, least(coalesce(nx.d-sn.snap_date,30),30) as days_to_event
       from sn join sa using (symbol, dte) asof left join vix v on sn.snap_date >= v.date asof left join (select event_date as d from ev) nx on sn.snap_date <= nx.d"""


@query("ml06b_live_inputs", "symbol:l snap_date:d expiry:d straddle_pct:4 dte:i straddle_z:3 vix:1 day_of_week:i event_in_window:i days_to_event:i", _LIVE_SQL)
def _ml06b(t):
    """Inputs built inside the stream."""
    from tidebook.streaming.jobs import drain
    daily, stats, _, stream = _live_stream(t)
    rows = drain(WF.live_inputs(stream, daily, stats, SC.FEATURES), "live-inputs")
    return rows.withColumn("snap_date", F.to_date("ts"))


@query("ml06c_live_scores", "symbol:l snap_date:d expiry:d confidence:1 expected_pnl_pct:2")
def _ml06c(t):
    """A stored model applied to the snapshots inside the stream."""
    from tidebook.streaming.jobs import drain
    daily, stats, _, stream = _live_stream(t)
    path, _ = _stored_models(t)
    model, features = WF.load_model(t.spark, path, (0, "iron_condor")) or (None, SC.FEATURES)
    inputs = WF.live_inputs(stream, daily, stats, features).withColumn("strategy", F.lit("iron_condor"))
    rows = drain(WF.live_scores(inputs, model), "live-scores")
    return rows.withColumn("snap_date", F.to_date("ts"))
