"""Streaming queries: each runs the stream to its end and returns its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.fragments import norm_cdf
from tidebook.catalog.options import LEGS
from tidebook.catalog.registry import query
from tidebook.operators.dedup import latest_by
from tidebook.session import shared_dir
from tidebook.streaming import jobs as J

TARGET, STOP = 10.0, 20.0


def _events(t):
    return J.stream_parquet(t.spark, t.root, t.raw("events").schema, glob="events.parquet")


def _ticks(t):
    # Event time must be a timestamp with zone semantics to carry a watermark.
    return _events(t).select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("ltp"), F.col("event_type").alias("side"))


@query("str01_ingest_new_files", "event_type:s n:l total:2", "select event_type, count(*) as n, sum(value) as total from events group by 1")
def _str01(t):
    target = (shared_dir(t.spark, "ingest"), shared_dir(t.spark, "ingest-ckpt"))
    J.ingest_new_files(_events(t), target)
    # The second run finds no new file and adds nothing.
    return J.ingest_new_files(_events(t), target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("str02_suppress_repeats", "event_id:l symbol:s ltp:2", "select event_id, symbol, ltp from ticks")
def _str02(t):
    twice = _ticks(t).withColumn("poll", F.explode(F.array(F.lit(0), F.lit(1))))
    return J.drain(J.suppress_repeats(twice, ["event_id"]), "dedup")


@query("str03_five_minute_alignment", "symbol:s window_start:t ltp:2 event_id:l",
       """with w as (select *, time_bucket(interval 5 minute, ts) as window_start from ticks) select symbol, window_start, max_by(ltp, ts) as ltp, max_by(event_id, ts) as event_id from w group by 1,2""")
def _str03(t):
    return J.drain_to_end(_ticks(t), lambda d: J.align(d, ["symbol"], ["ltp", "event_id"], ["ts", "event_id"]), "align")


@query("str04_latest_straddle", "symbol:l snap_date:d expiry:d strike:1 straddle:2",
       f"""with {LEGS.format(c='chain')}, l as (select symbol, max(snap_date) as snap_date from bl group by 1), r as (select bl.*, row_number() over (partition by symbol order by expiry, abs(ce-pe), strike) as z from bl join l using (symbol, snap_date)) select *, ce+pe as straddle from r where z=1""")
def _str04(t):
    src = shared_dir(t.spark, "chain-files")
    # One file group per snapshot month: a snapshot is never split over batches.
    t.chain.repartition("snap_date").write.parquet(src)
    s = J.stream_parquet(t.spark, src, t.chain.schema, max_files=4)
    return latest_by(J.drain_batches(s, "straddle", J.straddle_rows), ["symbol"], ["snap_date"])


@query("str05_mark_to_market", "event_id:l symbol:s pnl_inr:2",
       "with p as (select cast(user_id as varchar) as symbol, max(value) as e, 1+user_id%3 as lots from events group by 1, user_id) select event_id, t.symbol, (e-ltp)*50*lots as pnl_inr from ticks t join p using (symbol)")
def _str05(t):
    pos = t.raw("events").groupBy("user_id").agg(F.max("value").alias("entry_value")).select(
        F.col("user_id").cast("string").alias("symbol"), "entry_value", (1 + F.col("user_id") % 3).alias("lots"), F.lit(50).alias("lot_size"))
    return J.drain(J.mark_to_market(_ticks(t), pos), "mtm")


_LIFE = f"""l0 as (select symbol, cast(ts as date) as day, ts, event_id, row_number() over w as i, first_value(ltp) over w - ltp as pnl from ticks window w as (partition by symbol, cast(ts as date) order by ts, event_id)),
l1 as (select *, min(case when i>1 and pnl>={TARGET} then i end) over w as armed from l0 window w as (partition by symbol, day order by ts, event_id)),
l2 as (select *, max(case when i>=armed then pnl end) over (partition by symbol, day order by ts, event_id) as peak from l1),
l3 as (select *, case when extract(hour from ts)*60+extract(minute from ts) >= 920 then 'eod' when pnl <= -{STOP} then 'stop' when i>armed and pnl <= peak*0.75::double then 'trail' end as why from l2 where i>1)"""
_LIFE_Q = f"with {_LIFE} select symbol, day, ts as exit_time, why as exit_reason, pnl from (select *, row_number() over (partition by symbol, day order by i) as z from l3 where why is not null) q where z=1"
_LIFE_OUT = "symbol:s day:d exit_time:t exit_reason:s pnl:2"


@query("str06_position_lifecycle", _LIFE_OUT, _LIFE_Q)
def _str06(t):
    return J.drain_to_end(_ticks(t), lambda d: J.lifecycle(d, TARGET, STOP), "lifecycle")


@query("str06b_position_lifecycle_batch", _LIFE_OUT, _LIFE_Q)
def _str06b(t):
    return J.lifecycle_batch(t.ticks, TARGET, STOP)


@query("str07_entry_gate", "symbol:s event_id:l ts:t ltp:2",
       """with s as (select *, cast(ts as date) as day, max(case when side='error' then ts end) over (partition by symbol, cast(ts as date) order by ts, event_id) as stop from ticks)
       select symbol, event_id, ts, ltp from s where side<>'error' and ltp>=20 and event_id%100>=30 and extract(hour from ts)*60+extract(minute from ts) between 570 and 839 and event_id%40<=20 and (stop is null or epoch_us(ts)-epoch_us(stop) >= 1800000000)""")
def _str07(t):
    d = _ticks(t).withColumns({
        "seen": F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 40) * 60), "score": (F.col("event_id") % 100).cast("double"),
        "is_stop": F.when(F.col("side") == "error", 1).otherwise(0)})
    return J.drain_to_end(d, lambda d: J.entry_gate(d, 20.0, 30.0), "gate")


@query("str08_drop_stale", "symbol:s n:l", "select symbol, count(*) as n from ticks where event_id%40<=20 group by 1")
def _str08(t):
    d = _ticks(t).withColumn("seen", F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 40) * 60)).withWatermark("ts", J.LATENESS)
    return J.drain(J.fresh(d, "ts", "seen"), "fresh").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


_D1 = "((ln((23950+ltp)/24000.0::double)+(0.065::double+0.5::double*0.15::double*0.15::double)*(3/365.0::double))/(0.15::double*sqrt(3/365.0::double)))"


@query("str09_delta_hedges", "symbol:s event_id:l net_delta:5 hedge_lots:3 hedge_direction:s cumulative_lots:3",
       f"""with d as (select *, 1-2*{norm_cdf(_D1)} as nd from ticks), h as (select *, -nd*50 as hl from d where abs(nd)>0.15)
       select symbol, event_id, nd as net_delta, hl as hedge_lots, case when hl>0 then 'buy' else 'sell' end as hedge_direction, sum(hl) over (partition by symbol, cast(ts as date) order by ts, event_id) as cumulative_lots from h""")
def _str09(t):
    nd = J.net_delta(23950 + F.col("ltp"), F.lit(24000.0), F.lit(3 / 365.0), F.lit(0.15))
    return J.drain_to_end(_ticks(t).withColumn("net_delta", nd), lambda d: J.hedges(d, 50.0), "hedges")


@query("str10_alerts_once", "symbol:s day:d kind:s alert_time:t",
       f"""with {_LIFE} select symbol, day, 'entered' as kind, min(ts) as alert_time from l0 group by 1,2 union all select symbol, day, 'target', min(ts) from l0 where pnl>={TARGET} group by 1,2 union all select symbol, day, 'stop', min(ts) from l0 where pnl<=-{STOP} group by 1,2
       union all select symbol, day, 'eod', min(ts) from l0 where extract(hour from ts)*60+extract(minute from ts) >= 915 group by 1,2""")
def _str10(t):
    return J.drain_to_end(_ticks(t), lambda d: J.alerts(d, TARGET, STOP), "alerts")


RULES = J.Rules(target=10.0, stop=20.0, min_premium=20.0, min_score=30.0)


def _marked(d):
    """Marks with the time they were seen, a score and the critical inputs, all from the event."""
    return d.withColumns({
        "seen": F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 40) * 60), "score": (F.col("event_id") % 100).cast("double"),
        "critical": F.array(F.col("event_id") % 2, F.col("event_id") % 3)})


_TRADES_Q = f"""with recursive m as (select symbol, cast(ts as date) as day, ts, ltp, extract(hour from ts)*60+extract(minute from ts) as mi, row_number() over (partition by symbol, cast(ts as date) order by ts, event_id) as i,
  ltp>={max(RULES.min_premium, 2 * RULES.stop)} and event_id%100>={RULES.min_score} and event_id%40<=20 and (event_id%2<>0 or event_id%3<>0) as ok from ticks),
x as (select *, mi between 570 and 839 and ok as enter from m),
r(symbol, day, i, phase, entry, entered, peak, stopped, why, pnl, ts, was, was_entry) as (
  select symbol, day, 0::bigint, 0, 0::double, null::timestamp, 0::double, null::timestamp, null::varchar, null::double, null::timestamp, null::timestamp, null::double from (select distinct symbol, day from m)
  union all
  select symbol, day, i, case when enters then 1 when phase=0 or why is not null then 0 when phase=2 or pnl>={RULES.target} then 2 else 1 end, case when enters then ltp else entry end, case when enters then ts else entered end,
    case when phase=1 then pnl else greatest(peak, pnl) end, case when why='stop' then ts else stopped end, why, pnl, ts, entered, entry from (
    select x.symbol, x.day, x.i, x.ts, x.ltp, r.phase, r.entry, r.entered, r.peak, r.stopped, r.phase=0 and x.enter and (r.stopped is null or epoch_us(x.ts)-epoch_us(r.stopped)>=1800000000) as enters, r.entry-x.ltp as pnl,
      case when r.phase>0 then case when x.mi>=920 then 'eod' when r.entry-x.ltp<=-{RULES.stop} then 'stop' when r.phase=2 and r.entry-x.ltp<=greatest(r.peak, r.entry-x.ltp)*0.75::double then 'trail' end end as why
    from r join x on x.symbol=r.symbol and x.day=r.day and x.i=r.i+1) q)
select symbol, day, was as entry_time, ts as exit_time, why as exit_reason, was_entry as entry, pnl from r where why is not null"""
_TRADES_OUT = "symbol:s day:d entry_time:t exit_time:t exit_reason:s entry:2 pnl:2"


@query("str06c_lifecycle_with_reentry", _TRADES_OUT, _TRADES_Q)
def _str06c(t):
    return J.drain_to_end(_marked(_ticks(t)), lambda d: J.full_lifecycle(d, RULES), "trades")


@query("str06d_lifecycle_with_reentry_batch", _TRADES_OUT, _TRADES_Q)
def _str06d(t):
    return J.full_lifecycle_batch(_marked(t.ticks), RULES)


@query("str10b_position_alerts", "symbol:s alert_time:t kind:s",
       f"""with g as (select *, case when ts - lag(ts) over w >= interval 360 minute then 1 else 0 end as cut from ticks window w as (partition by symbol order by ts, event_id)),
       p as (select *, sum(cut) over (partition by symbol order by ts, event_id) as p from g), v as (select *, first_value(ltp) over w - ltp as pnl, row_number() over w as i from p window w as (partition by symbol, p order by ts, event_id)),
       h as (select *, min(case when pnl>={TARGET} then i end) over (partition by symbol, p) as reached from v),
       a as (select symbol, p, min(ts) as entered, min(case when pnl>={TARGET} then ts end) as target, min(case when pnl<=-{STOP} then ts end) as stop, min(case when extract(hour from ts)*60+extract(minute from ts) >= 915 then ts end) as eod, min(case when i>reached then ts end) as "trailing", max(ts)+interval 360 minute as closed from h group by 1,2)
       select symbol, alert_time, kind from (unpivot a on entered, target, stop, eod, "trailing", closed into name kind value alert_time)""")
def _str10b(t):
    return J.drain_to_end(_ticks(t), lambda d: J.position_alerts(d, TARGET, STOP, 360), "position-alerts")
