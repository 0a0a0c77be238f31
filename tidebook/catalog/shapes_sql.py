"""The same shapes as SQL common table expressions, for the independent check."""

from __future__ import annotations

import re

SHAPES: dict[str, str] = {
    "bars": """select p_brand as symbol, cast(l_shipdate as date) as date, min_by(px, o) as open, max(px) as high,
        min(px) as low, max_by(px, o) as close, sum(l_quantity) as volume
        from (select p_brand, l_shipdate, l_quantity, (floor(l_extendedprice/l_quantity*10000.0::double+0.5)/10000.0::double) as px,
              row(l_orderkey, l_partkey, l_linenumber, floor(l_extendedprice/l_quantity*10000.0::double+0.5)/10000.0::double) as o
              from lineitem join part on l_partkey=p_partkey) t group by 1,2""",
    "bench": "select date, avg(close) as close from bars group by 1",
    "nav": """select l_suppkey as scheme_code, cast(l_shipdate as date) as date,
        floor(sum(l_extendedprice)/sum(l_quantity)*10000.0::double+0.5)/10000.0::double as nav from lineitem group by 1,2""",
    "chain": """select l_suppkey % 4 as symbol, cast(date_trunc('month',l_shipdate) as date) as snap_date,
        cast(date_trunc('month',l_shipdate) as date) + cast(3 + (l_partkey % 3) * 7 as int) as expiry,
        24000.0::double + 50.0*((l_partkey % 21) - 10) as strike,
        case when l_orderkey % 2 = 0 then 'CE' else 'PE' end as option_type,
        max(l_quantity) as ltp, cast(sum(l_quantity) as bigint)*100 as oi from lineitem group by 1,2,3,4,5""",
    "chain_w": """select 0::bigint as symbol, cast(date_trunc('week',l_shipdate) as date) as snap_date,
        cast(date_trunc('quarter',l_shipdate) + interval 3 month as date) as expiry,
        24000.0::double + 50.0*((l_partkey % 11) - 5) as strike,
        case when l_orderkey % 2 = 0 then 'CE' else 'PE' end as option_type,
        max(l_quantity) as ltp, cast(sum(l_quantity) as bigint)*100 as oi from lineitem group by 1,2,3,4,5""",
    "chain_v": """select symbol, snap_date, expiry, strike, option_type, max(l_quantity) as ltp, cast(sum(l_quantity) as bigint)*100 as oi, snap_date + days as known_at from (
        select 0::bigint as symbol, cast(date_trunc('week',l_shipdate) as date) as snap_date, cast(date_trunc('quarter',l_shipdate) + interval 3 month as date) as expiry, 24000.0::double + 50.0*((l_partkey % 11) - 5) as strike,
        case when l_orderkey % 2 = 0 then 'CE' else 'PE' end as option_type, l_quantity, days from lineitem, (values (0),(10)) v(days) where l_linenumber <= 3 or days = 10) z group by 1,2,3,4,5,days""",
    "chain_d": """select 0::bigint as symbol, cast(l_shipdate as date) as snap_date,
        cast(date_trunc('week', cast(l_shipdate as date) + 5) as date) + 1 as expiry,
        24000.0::double + 50.0*((l_partkey % 5) - 2) as strike,
        case when l_orderkey % 2 = 0 then 'CE' else 'PE' end as option_type,
        max(l_quantity) as ltp, cast(sum(l_quantity) as bigint)*100 as oi from lineitem group by 1,2,3,4,5""",
    "settle_d": "select 0::bigint as symbol, date as expiry, 23950.0::double + vix*3.0::double as spot_expiry from vix where spot > 0",
    "settle": """select symbol, expiry, 23950.0::double + vix*3.0::double + 40.0::double*symbol as spot_expiry from (select distinct symbol, expiry from chain) k
        join vix on vix.date=k.expiry where spot > 0""",
    "index_bars": "select 'INDEX' as symbol, date, avg(open) as open, max(high) as high, min(low) as low, avg(close) as close from bars group by 2",
    "flows": """select cast(o_orderdate as date) as date, o_orderpriority as entity,
        floor(sum(case when o_orderstatus='F' then o_totalprice else -o_totalprice end)*100.0::double+0.5)/100.0::double as net_value
        from orders group by 1,2""",
    "day_flows": "select date, floor(sum(net_value)*100.0::double+0.5)/100.0::double as net_value from flows group by 1",
    "vix": """select cast(o_orderdate as date) as date, floor((5+avg(o_totalprice)/15000.0::double)*10.0::double+0.5)/10.0::double as vix,
        case when count(*) % 5 <> 0 then floor(avg(o_totalprice)/10.0::double*100.0::double+0.5)/100.0::double else 0.0::double end as spot from orders group by 1""",
    "market_events": """select cast(o_orderdate as date) as event_date, o_orderpriority as event_name,
        case when max(o_totalprice) > 495000 then 'HIGH' when max(o_totalprice) > 400000 then 'MEDIUM' else 'LOW' end as impact
        from orders group by 1,2""",
    "holidays": "select distinct event_date as holiday_date, 'EX' as exchange from market_events where impact='HIGH'",
    "lots": """select symbol, cast(date_trunc('quarter',date) as date) as effective_from,
        cast(25*(1+cast(max(volume) as int) % 4) as int) as lot_size from bars group by 1,2""",
    "ticks": "select cast(user_id as varchar) as symbol, ts, event_id, value as ltp, event_type as side from events",
    "outcomes": """select event_id as trade_id, user_id % 4 as symbol, ts as exit_time, cast(ts as date) as exit_date,
        cast(ts as date) - cast(event_id % 5 as int) as entry_date, cast(ts as date) + cast(event_id % 7 as int) as expiry,
        value - 50 as pnl_pts, event_type as exit_reason, props as features_json,
        cast(json_extract_string(props,'$.k') as double) as conf, cast(1 + event_id % 3 as int) as lots, 50 as lot_size,
        value as entry_premium from events""",
    "funds": """select s_suppkey as scheme_code, s_name as scheme_name, s_nationkey as scheme_category,
        1 as is_active from supplier""",
    "runs": """select event_type as service, cast(ts as date) as run_date, ts as started_at,
        date_trunc('second', ts) + to_seconds(event_id % 600) as finished_at,
        case when value < 10 then 'failed' else 'success' end as status, cast(trunc(value) as bigint) as rows_written,
        event_id as version from events""",
}

_WORD = {n: re.compile(rf"\b(?:from|join)\s+{n}\b") for n in SHAPES}


def _needed(sql: str) -> list[str]:
    out: list[str] = []

    def visit(text: str, within: str = "") -> None:
        for name, pat in _WORD.items():
            if name != within and name not in out and pat.search(text):
                visit(SHAPES[name], name)
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def expand(sql: str) -> str:
    """Prepend the shapes a statement uses as CTEs."""
    body = sql.strip()
    head = ", ".join(f"{n} as ({SHAPES[n]})" for n in _needed(body))
    low = body.lower()
    if low.startswith("with recursive"):
        body, kw = body[len("with recursive"):], "with recursive"
    elif low.startswith("with"):
        body, kw = body[len("with"):], "with"
    else:
        return f"with {head} {body}" if head else body
    return f"{kw} {head}, {body}" if head else f"{kw} {body}"
