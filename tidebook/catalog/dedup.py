"""Versioned-row queries. Events are versions of (user, type) rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.operators import dedup as D

KEYS = ["user_id", "event_type"]
_LATEST = """lv as (select * from (select user_id, event_type, event_id, value, row_number() over
    (partition by user_id, event_type order by event_id desc) as k from events) z where k = 1)"""


def _latest(t):
    e = t.raw("events").select("user_id", "event_type", "event_id", "value")
    return D.latest_version(e, KEYS, "event_id")


@query("ded01_latest_version", "user_id:l event_type:s event_id:l value:2", f"with {_LATEST} select * from lv")
def _ded01(t):
    return _latest(t)


@query("ded02_last_snapshot_per_day", "symbol:s day:d side:s ltp:2 event_id:l",
       """select symbol, cast(ts as date) as day, side, max_by(ltp, ts) as ltp, max_by(event_id, ts) as event_id from ticks group by 1,2,3""")
def _ded02(t):
    d = t.ticks.withColumn("day", F.to_date("ts"))
    return D.last_in_period(d, ["symbol", "day", "side"], ["ltp", "event_id"], F.struct("ts", "event_id"))


@query("ded03_enrich_reinsert", "user_id:l event_type:s event_id:l value:2",
       f"""with {_LATEST}, u as (select user_id, event_type, avg(value) as m from events where value >= 40 group by 1,2 having count(*) >= 15)
       select user_id, event_type, case when m is null then event_id else event_id + 1000000 end as event_id, coalesce(m, value) as value
       from lv left join u using (user_id, event_type)""")
def _ded03(t):
    upd = t.raw("events").where("value >= 40").groupBy(*KEYS).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    upd = upd.where("_n >= 15").drop("_n")
    return D.upsert_columns(_latest(t), upd, KEYS, "event_id", F.col("event_id") + 1000000)


@query("ded04_update_by_key", "user_id:l event_type:s event_id:l status:s",
       f"""with {_LATEST} select user_id, event_type, case when value < 20 then event_id + 1 else event_id end as event_id,
       case when value < 20 then 'done' else 'open' end as status from lv""")
def _ded04(t):
    base = _latest(t).withColumn("status", F.lit("open"))
    return D.status_update(base, base.where("value < 20"), KEYS, "status", "done", "event_id")


@query("ded05_first_wins_union", "day:d name:s origin:s n:l",
       """with s as (select 0 as src, cast(o_orderdate as date) as day, o_orderpriority as name, 'orders' as origin, count(*) as n from orders where o_orderstatus='F' group by 2,3
       union all select 1, cast(o_orderdate as date), o_orderpriority, 'backup', count(*) from orders group by 2,3)
       select day, name, min_by(origin, src) as origin, min_by(n, src) as n from s group by 1,2""")
def _ded05(t):
    o = t.raw("orders").withColumn("day", F.to_date("o_orderdate")).withColumnRenamed("o_orderpriority", "name")
    a = o.where("o_orderstatus = 'F'").groupBy("day", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("orders"))
    b = o.groupBy("day", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("backup"))
    return D.first_wins_union([a, b], ["day", "name"], ["n"])


@query("ded06_keep_first_last", "symbol:s first_ltp:2 last_ltp:2",
       "select symbol, min_by(ltp, event_id) as first_ltp, max_by(ltp, event_id) as last_ltp from ticks group by 1")
def _ded06(t):
    d = t.ticks.select("symbol", "ts", "event_id", "ltp")
    a = D.keep_first_last(d, ["symbol"], ["event_id"], "first").select("symbol", F.col("ltp").alias("first_ltp"))
    b = D.keep_first_last(d, ["symbol"], ["event_id"], "last").select("symbol", F.col("ltp").alias("last_ltp"))
    return a.join(b, "symbol")


@query("ded07_skip_known", "symbol:s date:d close:4",
       "select symbol, date, close from bars b where not exists (select 1 from bars k where k.symbol=b.symbol and k.date=b.date and extract(month from k.date) in (1,2,3))")
def _ded07(t):
    done = t.bars.where(F.month("date").isin(1, 2, 3))
    return D.skip_known(t.bars, done, ["symbol", "date"])
