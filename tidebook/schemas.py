"""Table schemas and schema evolution.

Each table is a compact ``name:type`` list; types are d=double, s=string,
i=int, l=long, date, ts=timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "d": T.DoubleType(),
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "date": T.DateType(),
    "ts": T.TimestampType(),
}

# Values for columns an older file does not have: zero and the empty string
# stand for "missing" in these tables, dates fall back to the epoch.
_DEFAULTS = {"d": 0.0, "s": "", "i": 0, "l": 0, "date": "1970-01-01", "ts": "1970-01-01 00:00:00"}

TABLES: dict[str, str] = {
    "ohlcv_daily": "date:date symbol:s market:s open:d high:d low:d close:d volume:l",
    "options_chain": "symbol:s timestamp:ts expiry:date strike:d option_type:s ltp:d bid:d ask:d iv:d delta:d "
    "theta:d oi:l oi_change:l volume:l",
    "options_eod_summary": "date:date symbol:s expiry:date nifty_spot:d total_ce_oi:l total_pe_oi:l pcr:d "
    "max_pain_strike:d atm_strike:d atm_ce_iv:d atm_pe_iv:d iv_rank:d iv_percentile:d ce_wall_strike:d "
    "pe_wall_strike:d iv_skew:d",
    "vol_surface": "date:date symbol:s expiry:date dte:i strike:d moneyness:d option_type:s iv:d delta:d ltp:d oi:l",
    "nifty_live": "timestamp:ts nifty_spot:d vix:d pcr:d advance_decline:d",
    "fii_dii": "date:date entity:s buy_value:d sell_value:d net_value:d",
    "participant_oi": "date:date entity:s fut_index_long:l fut_index_short:l fut_stock_long:l fut_stock_short:l "
    "opt_index_call_long:l opt_index_call_short:l opt_index_put_long:l opt_index_put_short:l "
    "opt_stock_call_long:l opt_stock_call_short:l opt_stock_put_long:l opt_stock_put_short:l "
    "total_long:l total_short:l fut_index_net:l fut_stock_net:l opt_index_call_net:l opt_index_put_net:l "
    "opt_stock_call_net:l opt_stock_put_net:l total_net:l",
    "mf_schemes": "scheme_code:l scheme_name:s fund_house:s scheme_type:s scheme_category:s is_active:i",
    "mf_nav": "date:date scheme_code:l nav:d",
    "fo_lot_sizes": "symbol:s effective_from:date lot_size:i",
    "events": "event_date:date event_time:s event_name:s impact:s description:s",
    "trading_holidays": "holiday_date:date exchange:s description:s holiday_type:s source:s",
    "market_regime": "date:date vix_regime:s trend:s momentum:s fii_stance:s opportunity_score:i "
    "trade_recommended:i reason:s",
    "detected_events": "date:date symbol:s market:s open:d high:d low:d close:d volume:l prev_close:d pct_change:d "
    "direction:s event_type:s threshold_pct:d vix_on_day:d market_regime:s processed:i",
    "backtests": "pattern_id:s symbol:s market:s signal_date:date entry_price:d return_1d:d return_3d:d return_5d:d "
    "hit_2pct_1d:i hit_2pct_3d:i hit_2pct_5d:i max_adverse_3d:d feature_snapshot:s",
    "predictions": "prediction_date:date target_date:date symbol:s market:s pattern_id:s stars:i confidence_pct:d "
    "predicted_direction:s predicted_min_pct:d features_json:s status:s",
    "confidence_scores": "score_date:date symbol:s next_expiry:date confidence:d expected_pnl_pct:d features_json:s "
    "strategy_type:s model_version:s",
    "trade_outcomes": "trade_id:s symbol:s expiry:date entry_time:ts exit_time:ts strike:d entry_premium:d "
    "exit_premium:d pnl_pts:d pnl_inr:d lot_size:i exit_reason:s scorecard_conf:d entry_features:s lots:i "
    "wing_ce_strike:d wing_pe_strike:d wing_ce_ltp:d wing_pe_ltp:d net_premium:d",
    "pipeline_runs": "service:s run_date:date started_at:ts finished_at:ts status:s rows_written:l git_sha:s error_msg:s",
}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def struct_of(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in _fields(TABLES[table])])


def conform(df: DataFrame, spec: str) -> DataFrame:
    """Project ``df`` onto a schema: cast, order, and fill absent columns and
    NULLs with the type default. ``spec`` is a table name or a field list."""
    fields = _fields(TABLES.get(spec, spec))
    have = set(df.columns)
    out = []
    for name, t in fields:
        default = F.lit(_DEFAULTS[t]).cast(_TYPES[t])
        c = F.coalesce(F.col(name).cast(_TYPES[t]), default) if name in have else default
        out.append(c.alias(name))
    return df.select(*out)
