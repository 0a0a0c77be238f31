"""Source and sink queries: the given tables are written in each raw file
format to the shared folder, then read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.catalog.windows import RISK_SQL
from tidebook.operators.dedup import latest_by
from tidebook.session import shared_dir
from tidebook.sources import files as S
from tidebook.sources import incremental as I

CH = "symbol:s expiry:d strike:1 option_type:s ltp:2 oi:l"
_CHAIN = "select cast(symbol as varchar) as symbol, snap_date, expiry, strike, option_type, ltp, oi from chain"


def _raw_derivatives(t, layout, kind, fmt):
    """Chain rows as text in a report layout, with noise rows the reader drops."""
    c = t.chain
    bad = F.col("oi") % 17 == 0
    vals = {
        "kind": F.when(F.col("oi") % 13 == 0, "FUT").otherwise(F.concat(F.lit(kind), F.lit(" "))), "symbol": F.concat(F.lit(" "), F.col("symbol").cast("string")),
        "expiry": F.when(bad, "never").otherwise(F.date_format("expiry", fmt)), "strike": F.col("strike").cast("string"), "option_type": F.lower("option_type"),
        "ltp": F.when(F.col("oi") % 11 == 0, None).otherwise(F.col("ltp").cast("string")), "oi": F.col("oi").cast("string"),
        "oi_change": F.lit("0"), "volume": F.lit("10"),
    }
    return c.select(*[v.alias(layout[k]) for k, v in vals.items()], F.date_format("snap_date", "yyyy-MM-dd").alias("trade_date"))


def _write_csv(t, df, name):
    path = shared_dir(t.spark, name)
    df.write.option("header", True).csv(path)
    return path


_DERIV = f"select symbol, snap_date, expiry, strike, option_type, case when oi % 11 = 0 then 0 else ltp end as ltp, oi from ({_CHAIN}) z where oi % 17 <> 0 and oi % 13 <> 0"


@query("src01_parquet_round_trip", "symbol:s date:d close:4 volume:2", "select symbol, date, close, volume from bars")
def _src01(t):
    path = shared_dir(t.spark, "bars")
    I.write_table(t.bars.withColumn("yyyymm", F.date_format("date", "yyyy")), path, ["yyyymm"])
    return t.spark.read.parquet(path)


@query("src02_old_derivatives_csv", f"snap_date:d {CH}", _DERIV)
def _src02(t):
    path = _write_csv(t, _raw_derivatives(t, S.OLD_LAYOUT, S.OLD_KIND, S.OLD_DATE), "old")
    df = S.read_strings(t.spark, path, [*S.OLD_LAYOUT.values(), "trade_date"])
    return S.old_derivatives(df, F.to_date("trade_date")).withColumn("snap_date", F.to_date("timestamp"))


@query("src03_new_derivatives_csv", f"snap_date:d {CH}", _DERIV)
def _src03(t):
    path = _write_csv(t, _raw_derivatives(t, S.NEW_LAYOUT, S.NEW_KIND, S.NEW_DATE), "new")
    df = S.read_strings(t.spark, path, [*S.NEW_LAYOUT.values(), "trade_date"])
    return S.new_derivatives(df, F.to_date("trade_date")).withColumn("snap_date", F.to_date("timestamp"))


@query("src04_layout_dispatch", f"ts:t {CH}", f"select *, cast(snap_date as timestamp) + interval '15 hours 30 minutes' as ts from ({_DERIV}) y union all select *, cast(snap_date as timestamp) + interval '15 hours 30 minutes' from ({_DERIV}) y")
def _src04(t):
    """The whole chain in both layouts, one with its columns reversed, and files of neither, in one call."""
    old = _write_csv(t, _raw_derivatives(t, S.OLD_LAYOUT, S.OLD_KIND, S.OLD_DATE), "old")
    new = _raw_derivatives(t, S.NEW_LAYOUT, S.NEW_KIND, S.NEW_DATE)
    new = _write_csv(t, new.select(*reversed(new.columns)), "new")
    other = _write_csv(t, t.chain.select("symbol", "strike", "ltp"), "other")
    return S.routed_derivatives(t.spark, [old, new, other]).withColumnRenamed("timestamp", "ts")


@query("src05_option_chain_json", f"snap_date:d {CH}", f"select symbol, snap_date, expiry, strike, option_type, ltp, oi from ({_CHAIN}) z where oi % 17 <> 0")
def _src05(t):
    q = F.struct(F.lit(None).cast("string").alias("expiryDate"), F.col("ltp").alias("lastPrice"), F.col("oi").alias("openInterest"), F.lit(0).cast("bigint").alias("changeinOpenInterest"),
                 F.lit(0).cast("bigint").alias("totalTradedVolume"), F.lit(0.0).alias("impliedVolatility"))
    zero = q.withField("lastPrice", F.lit(0.0)).withField("openInterest", F.lit(0).cast("bigint"))
    v = F.when(F.col("oi") % 17 == 0, zero).otherwise(q)
    side = lambda s: F.max(F.when(F.col("option_type") == s, v))
    by = t.chain.groupBy("symbol", "snap_date", "expiry", "strike").agg(side("CE").alias("CE"), side("PE").alias("PE"))
    fmt = F.when(F.col("strike") % 100 == 0, F.date_format("expiry", "dd-MMM-yyyy")).otherwise(F.date_format("expiry", "dd-MM-yyyy"))
    item = F.struct(F.col("strike").alias("strikePrice"), fmt.alias("expiryDate"), "CE", "PE")
    doc = by.groupBy("symbol", "snap_date").agg(F.collect_list(item).alias("data")).select(
        F.col("symbol").cast("string").alias("symbol"), F.col("snap_date").cast("timestamp").alias("ts"), F.struct(F.lit(24000.0).alias("underlyingValue"), "data").alias("records"))
    path = shared_dir(t.spark, "chain-json")
    doc.write.json(path)
    return S.option_chain_json(t.spark.read.schema(S.CHAIN_JSON).json(path)).withColumn("snap_date", F.to_date("timestamp"))


@query("src06_participant_csv", "date:d entity:s fut_index_long:l fut_index_short:l fut_index_net:l total_net:l",
       """with p as (select date, case entity when '1-URGENT' then 'Client' when '2-HIGH' then 'FII' when '3-MEDIUM' then 'DII' when '5-LOW' then 'Pro' end as entity, cast(trunc(abs(net_value)) as bigint) as v from flows)
       select date, entity, v as fut_index_long, v//2 as fut_index_short, v-v//2 as fut_index_net, v-v//2 as total_net from p where entity is not null""")
def _src06(t):
    ent = F.when(F.col("entity") == "1-URGENT", " Client ").when(F.col("entity") == "2-HIGH", "FII").when(F.col("entity") == "3-MEDIUM", "DII").when(F.col("entity") == "5-LOW", "Pro").otherwise("Others")
    v = F.abs(F.col("net_value")).cast("bigint")
    cols = ["Client Type", "date", *[f"{p}_{s}" for p in S.POSITION_PAIRS for s in ("long", "short")]]
    vals = [ent.alias("Client Type"), F.date_format("date", "yyyy-MM-dd").alias("date")]
    for p in S.POSITION_PAIRS:
        vals += [F.format_number(v, 0).alias(f"{p}_long"), F.format_number(F.floor(v / 2), 0).alias(f"{p}_short")]
    path = _write_csv(t, t.flows.select(*vals), "participants")
    return S.participant_positions(S.read_participant_csv(t.spark, path, cols)).withColumn("date", F.to_date("date"))


@query("src07_flow_json", "date:d entity:s buy_value:2 net_value:2",
       """select date, case entity when '1-URGENT' then 'FII' else 'DII' end as entity, case when abs(net_value)>200000 then 0 else abs(net_value) end as buy_value, case when abs(net_value)>200000 then 0 else net_value end as net_value
       from flows where entity in ('1-URGENT','2-HIGH')""")
def _src07(t):
    cat = F.when(F.col("entity") == "1-URGENT", "FII/FPI *").when(F.col("entity") == "2-HIGH", "dii **").otherwise("OTHER")
    d = F.when(F.dayofmonth("date") > 15, F.date_format("date", "dd-MMMM-yyyy")).otherwise(F.date_format("date", "dd-MMM-yyyy"))
    n = F.format_number("net_value", 2)
    path = shared_dir(t.spark, "flow-json")
    t.flows.select(cat.alias("category"), d.alias("date"), F.format_number(F.abs("net_value"), 2).alias("buyValue"), F.lit("0").alias("sellValue"), n.alias("netValue")).write.json(path)
    return S.flow_json(t.spark.read.schema("category string, date string, buyValue string, sellValue string, netValue string").json(path))


@query("src08_nav_json", "scheme_code:l date:d nav:4", "select * from nav where date > date '2000-06-30' or scheme_code % 2 = 1")
def _src08(t):
    item = F.struct(F.date_format("date", "dd-MM-yyyy").alias("date"), F.col("nav").cast("string").alias("nav"))
    path = shared_dir(t.spark, "nav-json")
    # One document per fund and year, so a document stays small.
    t.nav.groupBy("scheme_code", F.year("date").alias("_y")).agg(F.collect_list(item).alias("data")).drop("_y").write.json(path)
    wm = t.nav.where("scheme_code % 2 = 0 and date <= '2000-06-30'").select("scheme_code").distinct().withColumn("watermark", F.to_date(F.lit("2000-06-30")))
    return S.nav_json(t.spark.read.schema(S.NAV_JSON).json(path), wm)


@query("src09_statements_long", "symbol:s period:d revenue:2 debt:2",
       """with b as (select p_brand as symbol, sum(p_retailprice) as a, sum(p_size) as b from part group by 1) select symbol, d as period, case when d=date '2024-03-31' then a else a*2 end as revenue, case when d=date '2024-03-31' then b else b*3 end as debt from b, (values (date '2024-03-31'),(date '2024-06-30')) x(d)""")
def _src09(t):
    g = t.raw("part").groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("p_retailprice").alias("a"), F.sum("p_size").cast("double").alias("b"))
    alt = F.when(F.col("symbol") < "Brand#2", "Total Debt").otherwise("Long Term Debt")
    rows = F.array(F.struct(F.lit("Total Revenue").alias("line"), F.col("a").alias("q1"), (F.col("a") * 2).alias("q2")), F.struct(alt.alias("line"), F.col("b").alias("q1"), (F.col("b") * 3).alias("q2")),
                   F.struct(F.lit("Notes").alias("line"), F.lit(1.0).alias("q1"), F.lit(1.0).alias("q2")))
    wide = g.select("symbol", F.explode(rows).alias("_r")).select("symbol", "_r.line", F.col("_r.q1").alias("2024-03-31"), F.col("_r.q2").alias("2024-06-30"))
    return S.statements_long(wide, {"revenue": ["Total Revenue"], "debt": ["Total Debt", "Long Term Debt"]}, ["symbol"])


@query("src10_normalise_bars", "symbol:s date:d market:s open:4 close:4 volume:l", "select symbol, date, 'm' as market, open, close, case when extract(day from date)=1 then 0 else cast(trunc(volume) as bigint) end as volume from bars")
def _src10(t):
    raw = t.bars.select("symbol", F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
                        F.when(F.dayofmonth("date") != 1, F.col("volume")).alias("Volume"))
    old = raw.withColumn("Date", F.add_months("Date", -12 * 60))
    return S.normalise_bars(raw.unionByName(old), F.col("symbol"), F.lit("m"))


@query("src11_watermark_load", "symbol:s date:d close:4", "select b.symbol, date, close from bars b where date > case when symbol like '%1%' then (select max(date) from bars w where w.symbol=b.symbol and w.date <= date '2000-12-31') else date '1900-01-01' end")
def _src11(t):
    loaded = t.bars.where(F.col("symbol").contains("1") & (F.col("date") <= "2000-12-31"))
    return I.newer_than_watermark(t.bars, loaded, ["symbol"], "date")


@query("src12_warm_up_read", "scheme_code:l date:d volatility_1y:4", f"with {RISK_SQL} select * from rk where date > date '2001-06-30'")
def _src12(t):
    from tidebook.plans import funds as FU
    wm = F.to_date(F.lit("2001-06-30"))
    src = t.nav.where(F.col("date") >= F.date_sub(wm, 3650))
    return FU.risk(src, t.bench).where(F.col("date") > wm)


@query("src13_gap_plan", "date:d status:s",
       """with d as (select cast(unnest(generate_series(date '1996-01-01', date '1996-12-31', interval 1 day)) as date) as date) select date, case when date in (select date from vix where vix>20) then 'loaded' when date in (select date from bars) then 'staged' else 'fetch' end as status from d where extract(isodow from date)<6""")
def _src13(t):
    lo, hi = (F.to_date(F.lit(x)) for x in ("1996-01-01", "1996-12-31"))
    return I.gap_plan(lo, hi, t.vix.where("vix > 20"), t.bars.select("date"), t.spark)


@query("src14_append_sink", "symbol:s n:l", "select symbol, count(*)*2 as n from bars group by 1")
def _src14(t):
    path = shared_dir(t.spark, "sink")
    for _ in range(2):
        I.write_table(t.bars, path)
    return t.spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("src15_partition_pruning", "symbol:s date:d close:4", "select symbol, date, close from bars where date between date '1998-03-01' and date '1998-03-31'")
def _src15(t):
    path = shared_dir(t.spark, "months")
    I.write_table(t.bars.withColumn("yyyymm", F.date_format("date", "yyyyMM").cast("int")), path, ["yyyymm"])
    return t.spark.read.parquet(path).where("yyyymm = 199803")


@query("src16_retention", "symbol:s date:d close:4", "select symbol, date, close from bars where date >= date '2001-12-31' - 900 and not (extract(year from date) = 2000)")
def _src16(t):
    path = shared_dir(t.spark, "retain")
    b = I.retain(t.bars, "date", F.to_date(F.lit("2001-12-31")), 900).withColumn("yr", F.year("date"))
    I.write_table(b, path, ["yr"])
    # Replace one year by a marker row per symbol; other years stay as written.
    marker = t.bars.where("year(date) = 2000").groupBy("symbol").agg(F.max("date").alias("date"), F.max("open").alias("open"), F.max("high").alias("high"),
        F.max("low").alias("low"), F.lit(None).cast("double").alias("close"), F.max("volume").alias("volume")).withColumn("yr", F.lit(2000))
    I.overwrite_partitions(marker, path, ["yr"])
    return t.spark.read.parquet(path).where("close is not null")


@query("src17_copy_with_constant", "symbol:s date:d close:4 strategy:s", "select symbol, date, close, 'buy' as strategy from bars")
def _src17(t):
    path = shared_dir(t.spark, "copy")
    I.write_table(t.bars.withColumn("strategy", F.lit("buy")), path)
    return t.spark.read.parquet(path)


@query("src18_csv_export", "symbol:s date:d close:4", "select symbol, max(date) as date, max_by(close,date) as close from bars group by 1")
def _src18(t):
    path = shared_dir(t.spark, "export")
    I.export_csv(latest_by(t.bars, ["symbol"], ["date"]).select("symbol", "date", "close"), path)
    return t.spark.read.schema("symbol string, date date, close double").option("header", True).csv(path)


