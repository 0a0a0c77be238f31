"""Pattern-mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.fragments import LABELS, MOVES, PRICE_FEATURES, norm_cdf
from tidebook.catalog.registry import query
from tidebook.functions.rules import SEED_RULES
from tidebook.plans import patterns as P

# Prices here jump by tens of percent a day, so a selective move threshold is
# high, and rules use levels these series reach.
TH = 50.0
AS_OF = "1998-06-30"
RULES = {
    "R1": {"rsi_14": {"lt": 45}, "volume_z5": {"gt": 0.5}},
    "R2": {"sma_20_cross": {"eq": 1}},
    "R3": {"price_vs_sma200": {"gt": 0}, "return_5d": {"lt": -2.0}},
    "R4": {"volume_trend": {"in": ["contracting", "flat"]}, "bb_position": {"between": [0.4, 0.6]}},
    "R5": {"price_vs_sma20": {"gte": 10}, "volume_trend": {"eq": "expanding"}},
}
RULE_SQL = """(
  select 'R1' as pattern_id, * from {t} where rsi_14 < 45 and volume_z5 > 0.5
  union all select 'R2', * from {t} where sma_20_cross = 1
  union all select 'R3', * from {t} where price_vs_sma200 > 0 and return_5d < -2
  union all select 'R4', * from {t} where volume_trend in ('contracting','flat') and bb_position between 0.4 and 0.6
  union all select 'R5', * from {t} where price_vs_sma20 >= 10 and volume_trend = 'expanding')"""

FEATURE_OUT = (
    "rsi_14:4 rsi_5:4 sma_20_cross:i sma_50_cross:i ema_20_cross:i price_vs_sma20:4 price_vs_sma50:4 price_vs_sma200:4 "
    "volume_z5:4 volume_z20:4 volume_trend:s atr_14:4 atr_pct:4 bb_position:4 return_5d:4 return_20d:4 drawdown_pct:4"
)


def as_of():
    return F.to_date(F.lit(AS_OF))


@query("pat01_detect_moves", "symbol:s date:d close:4 prev_close:4 pct_change:4 direction:s event_type:s market_regime:s",
       "with " + MOVES.format(th=TH) + """ select m.symbol, m.date, close, prev_close, pct_change, direction, event_type,
       case when vix is null then '' when vix < 13 then 'low' when vix <= 18 then 'normal' when vix <= 25 then 'elevated' else 'extreme' end as market_regime
       from moves m left join vix v on v.date = m.date""")
def _pat01(t):
    from tidebook.functions.market import vix_regime
    regimes = t.vix.select("date", vix_regime("vix").alias("market_regime"))
    return P.detect_moves(t.bars, TH, regimes)


@query("pat02_event_features", f"symbol:s event_date:d direction:s n_hist:i {FEATURE_OUT}",
       "with recursive " + PRICE_FEATURES + f""",
       sh as (select symbol, date as event_date, case when close > lag(close) over w then 'UP' else 'DOWN' end as direction,
       lag(close) over w as pclose, close,
       {', '.join(f'lag({c.split(":")[0]}) over w as {c.split(":")[0]}' for c in FEATURE_OUT.split())}, lag(n_hist) over w as n_hist
       from pf window w as (partition by symbol order by date))
       select * from sh where pclose > 0 and abs((close-pclose)/pclose*100) >= {TH} and n_hist >= 30""")
def _pat02(t):
    return P.event_features(t.bars, TH)


CONTEXT_SQL = """bx as (select date, close, lag(close,5) over (order by date) as c5, first_value(close) over (order by date rows 5 preceding) as c0,
       row_number() over (order by date) as rn from bench),
b5 as (select date, (close-c0)/c0*100 as r from bx where rn >= 2),
fl as (select date, net_value from day_flows where extract(day from date) <> 15
       union all select date, lv from (select date, (level - lag(level) over (order by date))*0.263 as lv
         from (select date, sum(volume) as level from bars group by 1) q) z where lv is not null
         and date not in (select date from day_flows where extract(day from date) <> 15)),
f3 as (select date, sum(net_value) over (order by date rows 2 preceding) as s from fl),
days as (select date from bench union select date from fl union select date from vix),
ctx as (select d.date, coalesce(b5.r,0) as nifty_trend_5d, coalesce(f3.s,0) as fii_net_3d, coalesce(v.vix,0) as vix_level,
       case when v.vix is null or v.vix <= 0 then '' when v.vix < 13 then 'low' when v.vix <= 18 then 'normal' when v.vix <= 25 then 'elevated' else 'extreme' end as vix_regime
       from days d asof left join b5 on d.date > b5.date asof left join f3 on d.date > f3.date left join vix v on v.date = d.date)"""


def _context(t):
    # The main flow source misses the 15th of each month; open interest fills it.
    main = t.day_flows.where(F.dayofmonth("date") != 15)
    level = t.bars.groupBy("date").agg(F.sum("volume").alias("level"))
    return P.context(t.bench, main, t.vix, level)


@query("pat03_market_context", "date:d nifty_trend_5d:4 fii_net_3d:1 vix_level:2 vix_regime:s", f"with {CONTEXT_SQL} select * from ctx")
def _pat03(t):
    return _context(t)


@query("pat04_match_patterns", "pattern_id:s symbol:s event_date:d match_score:1",
       "with recursive " + PRICE_FEATURES + f""", fx as (select *, date as event_date from pf where n_hist >= 30),
       m as (select pattern_id, symbol, event_date from {RULE_SQL.format(t='fx')} z)
       select *, 1.0 as match_score from m where extract(year from event_date) <> 1997""")
def _pat04(t):
    f = P.price_features(t.bars).where("n_hist >= 30").withColumnRenamed("date", "event_date")
    known = P.match_patterns(f.where(F.year("event_date") == 1997), RULES).select("pattern_id", "symbol", "event_date")
    return P.match_patterns(f, RULES, known)


@query("pat05_forward_labels",
       "symbol:s signal_date:d direction:s return_1d:4 return_3d:4 return_5d:4 hit_2pct_1d:i hit_2pct_3d:i hit_2pct_5d:i max_adverse_3d:4",
       "with " + LABELS.format(th=TH) + " select * from lab")
def _pat05(t):
    return P.labelled_moves(t.bars, TH)


@query("pat06_pattern_stats",
       "direction:s total_matches:l win_rate_1d:2 win_rate_3d:2 win_rate_5d:2 avg_return_1d:4 avg_return_3d:4 avg_return_5d:4 "
       "sharpe_1d:4 max_drawdown_3d:4",
       "with " + LABELS.format(th=TH) + """ select direction, count(*) as total_matches, avg(hit_2pct_1d)*100 as win_rate_1d,
       avg(hit_2pct_3d)*100 as win_rate_3d, avg(hit_2pct_5d)*100 as win_rate_5d, avg(coalesce(return_1d,0)) as avg_return_1d,
       avg(coalesce(return_3d,0)) as avg_return_3d, avg(coalesce(return_5d,0)) as avg_return_5d,
       avg(coalesce(return_1d,0))/stddev_samp(coalesce(return_1d,0))*sqrt(252) as sharpe_1d, min(coalesce(max_adverse_3d,0)) as max_drawdown_3d
       from lab group by 1""")
def _pat06(t):
    return P.pattern_stats(P.labelled_moves(t.bars, TH, fill=0.0), ["direction"])


STATS_SQL = """st as (select symbol, count(*) as n, avg(return_1d)/stddev_samp(return_1d)*sqrt(252) as sharpe,
       round(avg(hit_2pct_1d),4) as win_rate, round(avg(case when signal_date >= date '1998-06-30' - 90 then 1 else 0 end),4) as recency from lab group by 1),
rt as (select symbol, n as sample_size, sharpe as sharpe_1d, case when n < 10 then 0 else win_rate end as win_rate,
       case when n < 10 then 0 else recency end as recency_score,
       case when n < 10 then 0 else round((greatest(-3.0,least(3.0,coalesce(sharpe,0)))+3)/6,4) end as risk_adj_return,
       case when n < 10 then 1 else 0 end as needs_more_data,
       case when n < 10 or coalesce(sharpe,0) < -0.5 then 1 else greatest(1,least(5,ceil(round(round(win_rate*0.35 + least(1.0,log10(n)/3)*0.20
         + recency*0.20 + round((greatest(-3.0,least(3.0,coalesce(sharpe,0)))+3)/6,4)*0.25,4)/0.20,6)))) end as stars from st)"""


def _ratings(t):
    lab = P.labelled_moves(t.bars, TH)
    return P.rate_patterns(P.pattern_stats(lab, ["symbol"]), lab, as_of(), by="symbol")


@query("pat07_star_rating",
       "symbol:s stars:i sample_size:l win_rate:4 recency_score:4 risk_adj_return:4 needs_more_data:i sharpe_1d:4",
       "with " + LABELS.format(th=TH) + f", {STATS_SQL} select * from rt")
def _pat07(t):
    return _ratings(t)


RATED = [("R1", 4, 0.70, 0.6), ("R2", 3, 0.82, 0.2), ("R3", 5, 0.95, 0.7), ("R4", 3, 0.75, 0.1), ("R5", 2, 0.99, 0.9)]


def _predict(t):
    rated = t.spark.createDataFrame(RATED, "pattern_id string, stars int, win_rate double, recency_score double")
    f = P.latest_features(P.price_features(t.bars).where(F.col("date") <= as_of())).withColumn("vix_level", F.lit(21.0))
    moves = P.detect_moves(t.bars, TH)
    return P.predict(f, RULES, rated, moves, as_of(), F.date_add(as_of(), 1))


PRED_SQL = f"""lt as (select * from (select *, row_number() over (partition by symbol order by date desc) as k from pf where date <= date '{AS_OF}') z where k = 1),
rated(pattern_id, stars, win_rate, recency_score) as (values ('R1',4,0.70,0.6),('R2',3,0.82,0.2),('R3',5,0.95,0.7),('R4',3,0.75,0.1),('R5',2,0.99,0.9)),
pc as (select r.*, m.symbol, round(least(95.0, win_rate*100.0*(case when stars>=4 then 1.10 else 1.0 end)*(case when recency_score>0.5 then 1.05 else 1.0 end)*0.90::double),2) as confidence_pct
       from {RULE_SQL.format(t='lt')} m join rated r using (pattern_id) where stars >= 3),
dir as (select symbol, max_by(direction, date) as d from moves where date between date '{AS_OF}' - 30 and date '{AS_OF}' group by 1)"""


@query("pat08_predictions",
       "prediction_date:d target_date:d symbol:s pattern_id:s stars:i confidence_pct:2 predicted_direction:s predicted_min_pct:1 status:s",
       "with recursive " + PRICE_FEATURES + ", " + MOVES.format(th=TH) + f", {PRED_SQL} select date '{AS_OF}' as prediction_date, date '{AS_OF}' + 1 as target_date, "
       "pc.symbol, pattern_id, stars, confidence_pct, coalesce(d,'UP') as predicted_direction, 2.0 as predicted_min_pct, 'open' as status "
       "from pc left join dir using (symbol) where confidence_pct >= 60")
def _pat08(t):
    return _predict(t)


def _move_predictions(t):
    """Every move predicts its own direction for the next calendar day."""
    return P.detect_moves(t.bars, TH).select(
        "symbol", F.lit("M").alias("pattern_id"), F.col("date").alias("prediction_date"), F.date_add("date", 1).alias("target_date"),
        F.col("direction").alias("predicted_direction"), F.lit(2.0).alias("predicted_min_pct"),
    )


VALID_SQL = """fw as (select symbol, date, lead(close,1) over w as c1, lead(close,3) over w as c3, lead(close,5) over w as c5 from bars window w as (partition by symbol order by date)),
vj as (select m.symbol, 'M' as pattern_id, m.date as prediction_date, m.date + 1 as target_date, m.direction as predicted_direction,
       b.open as ep, round((fw.c1-b.open)/b.open*100,4) as r1, round((fw.c3-b.open)/b.open*100,4) as r3, round((fw.c5-b.open)/b.open*100,4) as r5
       from moves m left join fw on fw.symbol=m.symbol and fw.date=m.date left join bars b on b.symbol=m.symbol and b.date=m.date+1),
vd as (select *, coalesce(r1,0) as actual_pct_1d, coalesce(r3,0) as actual_pct_3d, coalesce(r5,0) as actual_pct_5d,
       case when (predicted_direction='UP' and r1>=2) or (predicted_direction='DOWN' and r1<=-2) then 1 else 0 end as was_correct_1d,
       case when (predicted_direction='UP' and r3>=2) or (predicted_direction='DOWN' and r3<=-2) then 1 else 0 end as was_correct_3d,
       case when (predicted_direction='UP' and r5>=2) or (predicted_direction='DOWN' and r5<=-2) then 1 else 0 end as was_correct_5d from vj),
va as (select *, coalesce(ep,0) as entry_price, case when ep > 0 then greatest(was_correct_1d,was_correct_3d,was_correct_5d) else 0 end as hit_threshold,
       case when ep > 0 and greatest(was_correct_1d,was_correct_3d,was_correct_5d)=1 then 'hit' when ep > 0 then 'miss'
            when target_date + 5 < date '2000-12-31' then 'expired' else 'open' end as status from vd)"""


def _validated(t):
    return P.validate_predictions(_move_predictions(t), t.bars, F.to_date(F.lit("2000-12-31")))


@query("pat09_validate_predictions",
       "symbol:s pattern_id:s prediction_date:d target_date:d predicted_direction:s entry_price:4 actual_pct_1d:4 actual_pct_3d:4 actual_pct_5d:4 "
       "was_correct_1d:i was_correct_3d:i was_correct_5d:i hit_threshold:i status:s",
       "with " + MOVES.format(th=TH) + f", {VALID_SQL} select * from va")
def _pat09(t):
    return _validated(t)


@query("pat10_miss_rates",
       "total_events:l missed_events:l symbols_reviewed:l total_preds:l false_positives:l false_negative_rate:4 false_positive_rate:4",
       "with " + MOVES.format(th=30.0).replace("mv as", "mvx as").replace("from mv)", "from mvx)").replace("moves as", "allm as")
       + ", " + MOVES.format(th=TH) + f""", {VALID_SQL},
       e as (select count(*) as total_events, count(distinct a.symbol) as symbols_reviewed,
             count(*) filter (where not exists (select 1 from va p where p.symbol=a.symbol and p.prediction_date=a.date)) as missed_events
             from allm a where a.date between date '1997-01-01' and date '1998-12-31'),
       p as (select count(*) as total_preds, count(*) filter (where status in ('miss','expired')) as false_positives from va
             where prediction_date between date '1997-01-01' and date '1998-12-31' and status <> 'open')
       select *, missed_events/total_events::double as false_negative_rate, false_positives/total_preds::double as false_positive_rate from e, p""")
def _pat10(t):
    return P.miss_rates(P.detect_moves(t.bars, 30.0), _validated(t), F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1998-12-31")))


@query("pat11_walkforward_split",
       "symbol:s train_n:l train_win_rate:3 train_avg_ret:4 train_sharpe:4 test_n:l test_win_rate:3 test_avg_ret:4 test_sharpe:4 edge:i",
       "with " + LABELS.format(th=TH) + """,
       g as (select symbol, case when signal_date <= date '1998-06-30' then 'train' else 'test' end as p, count(*) as n,
             avg(case when return_5d>0 then 1 else 0 end)*100 as wr, avg(return_5d) as ar, coalesce(avg(return_5d)/stddev_samp(return_5d)*sqrt(252),0) as sh
             from lab where return_5d is not null group by 1,2)
       select a.symbol, a.n as train_n, a.wr as train_win_rate, a.ar as train_avg_ret, a.sh as train_sharpe, b.n as test_n, b.wr as test_win_rate,
       b.ar as test_avg_ret, b.sh as test_sharpe, case when a.wr>50 and b.wr>50 and a.ar>0 and b.ar>0 and b.sh >= a.sh*0.5 then 1 else 0 end as edge
       from g a join g b on a.symbol=b.symbol and a.p='train' and b.p='test'""")
def _pat11(t):
    return P.walkforward(P.labelled_moves(t.bars, TH), as_of(), by="symbol")


@query("pat12_flow_momentum",
       "signal:s horizon:s buy_mean:4 neutral_mean:4 sell_mean:4 t_stat:4 p_value:4",
       f"""with f as (select date, case when rn>=3 then f3 end as flow_3d, case when rn>=5 then f5 end as flow_5d, case when rn>=10 then f10 end as flow_10d from
       (select date, row_number() over (order by date) as rn, sum(net_value) over (order by date rows 2 preceding) as f3,
        sum(net_value) over (order by date rows 4 preceding) as f5, sum(net_value) over (order by date rows 9 preceding) as f10 from day_flows) z),
       b as (select date, (lead(close,5) over (order by date)/close-1)*100 as ret_5d, (lead(close,10) over (order by date)/close-1)*100 as ret_10d,
             (lead(close,20) over (order by date)/close-1)*100 as ret_20d from bench),
       j as (select * from f join b using (date) where flow_10d is not null and ret_20d is not null),
       l as (select date, 'flow_3d' as signal, flow_3d as flow, ret_5d, ret_10d, ret_20d from j union all select date, 'flow_5d', flow_5d, ret_5d, ret_10d, ret_20d from j
             union all select date, 'flow_10d', flow_10d, ret_5d, ret_10d, ret_20d from j),
       q as (select signal, quantile_cont(flow,0.33) as p33, quantile_cont(flow,0.66) as p66 from l group by 1),
       k as (select l.*, case when flow >= p66 then 'buy' when flow <= p33 then 'sell' else 'neutral' end as bucket from l join q using (signal)),
       h as (select signal, bucket, 'ret_5d' as horizon, ret_5d as r from k union all select signal, bucket, 'ret_10d', ret_10d from k union all select signal, bucket, 'ret_20d', ret_20d from k),
       s as (select signal, horizon, avg(r) filter (where bucket='buy') as buy_mean, avg(r) filter (where bucket='neutral') as neutral_mean, avg(r) filter (where bucket='sell') as sell_mean,
             (avg(r) filter (where bucket='buy') - avg(r) filter (where bucket='sell'))/sqrt(var_samp(r) filter (where bucket='buy')/count(*) filter (where bucket='buy')
              + var_samp(r) filter (where bucket='sell')/count(*) filter (where bucket='sell')) as t_stat from h group by 1,2)
       select *, 2*(1-{norm_cdf('abs(t_stat)')}) as p_value from s""")
def _pat12(t):
    return P.flow_momentum(t.day_flows, t.bench)


@query("pat13_price_action",
       "symbol:s date:d prev_range_pct:4 range_vs_atr:4 inside_bar:i ma20_dist_pct:4 ma50_dist_pct:4 above_ma20:i week_range_pct:4 consec_inside_days:i",
       """with r as (select *, (high-low)/close*100 as rg, row_number() over w as rn, cast(date_trunc('week',date) as date) as wk from bars window w as (partition by symbol order by date)),
       x as (select *, lag(rg) over w as prev_range_pct, avg(rg) over (partition by symbol order by date rows between 20 preceding and 1 preceding) as atr,
             avg(close) over (partition by symbol order by date rows 19 preceding) as m20, avg(close) over (partition by symbol order by date rows 49 preceding) as m50,
             max(high) over (partition by symbol, wk order by date) as wh, min(low) over (partition by symbol, wk order by date) as wl,
             first_value(open) over (partition by symbol, wk order by date) as wo from r window w as (partition by symbol order by date)),
       k as (select symbol, wk, lag(h) over (partition by symbol order by wk) as ph, lag(l) over (partition by symbol order by wk) as pl
             from (select symbol, wk, max(high) as h, min(low) as l from r group by 1,2) z),
       c as (select a.symbol, a.rn, max(b.rn) as last_wide from x a join x b on a.symbol=b.symbol and b.rn between a.rn-20 and a.rn-1 and b.rg >= a.atr group by 1,2)
       select x.symbol, x.date, prev_range_pct, coalesce(prev_range_pct/nullif(atr,0),0) as range_vs_atr, case when wh<ph and wl>pl then 1 else 0 end as inside_bar,
       (close-m20)/m20*100 as ma20_dist_pct, case when x.rn>=50 then (close-m50)/m50*100 else (close-m20)/m20*100 end as ma50_dist_pct,
       case when close>m20 then 1 else 0 end as above_ma20, coalesce((wh-wl)/nullif(wo,0)*100,0) as week_range_pct,
       x.rn-1-coalesce(last_wide, x.rn-21) as consec_inside_days from x join k on k.symbol=x.symbol and k.wk=x.wk left join c on c.symbol=x.symbol and c.rn=x.rn where x.rn >= 22""")
def _pat13(t):
    return P.price_action(t.bars)


@query("pat14_regime_table", "date:d vix_regime:s trend:s opportunity_score:i trade_recommended:i reason:s",
       """with p as (select *, last_value(nullif(spot,0) ignore nulls) over (order by date rows between unbounded preceding and 1 preceding) as pv from vix),
       r as (select *, case when vix<13 then 'low' when vix<=18 then 'normal' when vix<=25 then 'elevated' else 'extreme' end as vix_regime,
             case when pv>0 and spot>0 and spot>pv then 'up' when pv>0 and spot>0 then 'down' else 'flat' end as trend from p),
       o as (select *, greatest(0,least(100,(case vix_regime when 'low' then 75 when 'normal' then 60 when 'elevated' then 40 else 25 end)
             + (case trend when 'up' then 10 when 'down' then -10 else 0 end))) as opportunity_score from r)
       select *, case when opportunity_score>=50 then 1 else 0 end as trade_recommended,
       format('VIX={:.1f} ({}), trend={}', vix, vix_regime, trend) as reason from o""")
def _pat14(t):
    return P.regime_table(t.vix)


assert set(RULES) and SEED_RULES
