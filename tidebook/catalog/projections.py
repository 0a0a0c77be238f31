"""Projection, filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.catalog.registry import query
from tidebook.functions import text as T
from tidebook.functions.exprs import attach_row, bucket_label, cut_label, flag
from tidebook.functions.rules import compile_rule, seed_catalog


@query("prj01_derived_columns", "symbol:s date:d range_pct:4 body_pct:4 mid:4",
       "select symbol, date, (high-low)/close*100 as range_pct, (close-open)/open*100 as body_pct, (high+low)/2 as mid from bars")
def _prj01(t):
    return t.bars.select(
        "symbol", "date", ((F.col("high") - F.col("low")) / F.col("close") * 100).alias("range_pct"),
        ((F.col("close") - F.col("open")) / F.col("open") * 100).alias("body_pct"), ((F.col("high") + F.col("low")) / 2).alias("mid"),
    )


@query("prj02_parameterised_filters", "symbol:s date:d close:4",
       """select symbol, date, close from bars where symbol like '%5' and date between date '1996-01-01' and date '1999-12-31'
       and close >= 2000 and extract(month from date) in (1,6,12)""")
def _prj02(t):
    return t.bars.where(
        F.col("symbol").like("%5") & F.col("date").between("1996-01-01", "1999-12-31")
        & (F.col("close") >= 2000) & F.month("date").isin(1, 6, 12)
    ).select("symbol", "date", "close")


_RULES = {
    "lt": {"close": {"lt": 2000}}, "lte": {"volume": {"lte": 10}}, "gt": {"close": {"gt": 9000}}, "gte": {"volume": {"gte": 80}},
    "eq": {"symbol": {"eq": "Brand#7"}}, "between": {"close": {"between": [3000, 3100]}}, "in": {"symbol": {"in": ["Brand#1", "Brand#2"]}},
    "and": {"close": {"gt": 5000}, "volume": {"lt": 20}}, "first_wins": {"close": {"gt": 1, "lt": 1000}},
    "unknown_op": {"close": {"near": 5}}, "missing_feature": {"nope": {"lt": 5}},
}


@query("prj03_rule_dsl", "rule_id:s matches:l",
       """with c as (select count(*) filter (where close < 2000::double) as lt, count(*) filter (where volume <= 10) as lte, count(*) filter (where close > 9000) as gt,
       count(*) filter (where volume >= 80) as gte, count(*) filter (where symbol = 'Brand#7') as eq, count(*) filter (where close between 3000 and 3100) as btw,
       count(*) filter (where symbol in ('Brand#1','Brand#2')) as isin, count(*) filter (where close > 5000 and volume < 20) as conj, count(*) filter (where close < 1000) as fw from bars)
       select 'lt' as rule_id, lt as matches from c union all select 'lte', lte from c union all select 'gt', gt from c union all select 'gte', gte from c
       union all select 'eq', eq from c union all select 'between', btw from c union all select 'in', isin from c union all select 'and', conj from c
       union all select 'first_wins', fw from c union all select 'unknown_op', 0 from c union all select 'missing_feature', 0 from c""")
def _prj03(t):
    b = t.bars
    g = b.agg(*[F.sum(flag(compile_rule(r, b.columns))).alias(i) for i, r in _RULES.items()])
    rows = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.col(f"`{i}`").alias("matches")) for i in _RULES])
    return g.select(F.explode(rows).alias("r")).select("r.*")


@query("prj04_seed_rules_on_bars", "pattern_id:s label:s n_conditions:i bars:l",
       """with s(pattern_id, label, n_conditions) as (values ('P001','RSI Oversold + Volume Surge',2),('P002','SMA-20 Breakout in Low VIX',2),('P003','Pullback in Uptrend',3),
       ('P004','Volatility Squeeze',3),('P005','FII Accumulation Dip',2),('P006','Momentum Continuation',3),('P007','High IV + Overbought → Premium Fade',3),('P008','Low IV Squeeze → Cheap Options Breakout',3),
       ('P009','PCR Extreme + Oversold → Capitulation Buy',3),('P010','VIX Spike + FII Defense → Recovery Signal',3)) select s.*, (select count(*) from bars) as bars from s""")
def _prj04(t):
    n = t.bars.agg(F.count(F.lit(1)).alias("bars"))
    cat = seed_catalog(t.spark).withColumn("n_conditions", F.size(F.json_object_keys("conditions_json")))
    return attach_row(cat, n)


_HOUSE_SQL = "coalesce(" + ", ".join(
    f"case when upper(nm) like '%{h.upper()}%' then '{h}' end" for h in T.FUND_HOUSES
) + ", list_aggregate(list_filter(string_split_regex(trim(split_part(split_part(nm,' - ',1),'(',1)),'\\s+'), lambda x: x <> '')[1:2], 'string_agg', ' '))"


def _first(pairs, other):
    return "coalesce(" + ", ".join(f"case when upper(nm) like '%{k}%' then '{v}' end" for k, v in pairs) + f", '{other}')"


_NAMES_SQL = """with n as (select p_partkey as id, concat((['SBI','HDFC','Axis','Quant','Acme Capital','LIC'])[cast(p_partkey % 6 as int)+1], ' ', p_name, ' ',
    (['Liquid','Flexi Cap','Gilt','Index','Gold ETF','Large and Mid Cap','FOF Overseas','Balanced Advantage'])[cast(p_partkey % 8 as int)+1], ' - ',
    (['Direct Growth','Regular Growth','Direct IDCW'])[cast(p_partkey % 3 as int)+1]) as nm from part)"""


def _names(t):
    def pick(vals, n):
        return F.element_at(F.array(*[F.lit(v) for v in vals]), ((F.col("p_partkey") % n) + 1).cast("int"))

    return t.raw("part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", pick(["SBI", "HDFC", "Axis", "Quant", "Acme Capital", "LIC"], 6), "p_name",
                    pick(["Liquid", "Flexi Cap", "Gilt", "Index", "Gold ETF", "Large and Mid Cap", "FOF Overseas", "Balanced Advantage"], 8),
                    F.lit("-"), pick(["Direct Growth", "Regular Growth", "Direct IDCW"], 3)).alias("nm"),
    )


@query("prj05_name_classification", "id:l fund_house:s scheme_type:s scheme_category:s",
       f"{_NAMES_SQL} select id, {_HOUSE_SQL} as fund_house, "
       f"{_first([(k, lab) for lab, ks in T.SCHEME_TYPES.items() for k in ks], 'Other')} as scheme_type, "
       f"{_first(T.SCHEME_CATEGORIES.items(), 'Other')} as scheme_category from n")
def _prj05(t):
    return _names(t).select("id", T.fund_house("nm").alias("fund_house"), T.scheme_type("nm").alias("scheme_type"),
                            T.scheme_category("nm").alias("scheme_category"))


@query("prj06_relevance_filter", "id:l nm:s",
       f"""{_NAMES_SQL} select id, nm from n where upper(nm) like '%ETF%' or (upper(nm) like '%GROWTH%' and (upper(nm) like '%DIRECT%' or upper(nm) like '%FUND OF FUND%'
       or upper(nm) like '% FOF%' or upper(nm) like 'FOF %' or upper(nm) like '%OVERSEAS%' or upper(nm) like '%INTERNATIONAL%' or upper(nm) like '%GLOBAL%'))""")
def _prj06(t):
    return _names(t).where(T.relevant_scheme("nm"))


@query("prj07_valid_identifiers", "url:s valid:i",
       """select concat(p_brand, case when p_partkey % 3 = 0 then '; x' else '' end, p_partkey) as url,
       case when regexp_matches(concat(p_brand, case when p_partkey % 3 = 0 then '; x' else '' end, p_partkey), '^[A-Za-z0-9#]{1,40}$') then 1 else 0 end as valid from part""")
def _prj07(t):
    u = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "; x").otherwise(""), "p_partkey")
    return t.raw("part").select(u.alias("url")).withColumn("valid", flag(T.valid_id("url", r"^[A-Za-z0-9#]{1,40}$")))


@query("prj08_bucket_labels", "bucket:s n:l avg_value:4",
       """select case when value < 20 then 'low' when value < 50 then 'mid' when value < 80 then 'high' else 'top' end as bucket,
       count(*) as n, avg(value) as avg_value from events group by 1""")
def _prj08(t):
    e = t.raw("events").withColumn("bucket", bucket_label("value", [20, 50, 80], ["low", "mid", "high", "top"]))
    return e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"))


@query("prj09_fixed_bins", "band:s n:l win_rate:4",
       """select case when conf > 0 and conf <= 50 then '<50' when conf > 50 and conf <= 60 then '50-60' when conf > 60 and conf <= 70 then '60-70'
       when conf > 70 and conf <= 80 then '70-80' when conf > 80 and conf <= 100 then '>80' end as band, count(*) as n,
       avg(case when pnl_pts >= 0 then 1.0 else 0.0 end) as win_rate from outcomes where conf > 0 group by 1""")
def _prj09(t):
    b = t.outcomes.withColumn("band", cut_label("conf", [0, 50, 60, 70, 80, 100], ["<50", "50-60", "60-70", "70-80", ">80"]))
    return b.where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(flag(F.col("pnl_pts") >= 0)).alias("win_rate"))


@query("prj10_quality_gate", "symbol:s date:d close:4",
       """with f as (select p_brand as symbol, avg(p_retailprice) as pe, avg(p_size) as roe, avg(p_size - 24.0) as margin from part group by 1)
       select b.symbol, date, close from bars b where exists (select 1 from f where f.symbol=b.symbol and pe > 0 and roe > 25 and margin > 0)""")
def _prj10(t):
    q = t.raw("part").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.avg("p_retailprice").alias("pe"), F.avg("p_size").alias("roe"), F.avg(F.col("p_size") - 24.0).alias("margin")
    ).where("pe > 0 and roe > 25 and margin > 0")
    return t.bars.join(q, "symbol", "left_semi")


@query("prj11_missing_features", "trade_id:l missing:s",
       """select trade_id, concat_ws(',', case when coalesce(conf,0)=0 then 'k' end, 'vix', 'iv_rank') as missing from outcomes""")
def _prj11(t):
    return t.outcomes.select("trade_id", F.array_join(T.missing_features("features_json", ["k", "vix", "iv_rank"]), ",").alias("missing"))
