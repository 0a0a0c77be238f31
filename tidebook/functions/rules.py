"""Rule catalog: JSON conditions compiled to columns.

A rule is ``{feature: {operator: operand}}``; conditions are AND-ed. The JSON
is read on the driver (rules are few) and becomes one boolean column per rule,
so all rules are matched in a single scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.exprs import all_of

# Operators in the order they are looked for; the first present one decides.
_OPS = {
    "lt": lambda c, a: c < a,
    "lte": lambda c, a: c <= a,
    "gt": lambda c, a: c > a,
    "gte": lambda c, a: c >= a,
    "eq": lambda c, a: c == a,
    "between": lambda c, a: c.between(a[0], a[1]),
    "in": lambda c, a: c.isin(*a),
}

# The seed rules.
SEED_RULES = {
    "P001": {"rsi_14": {"lt": 35}, "volume_z5": {"gt": 1.5}},
    "P002": {"sma_20_cross": {"eq": 1}, "vix_level": {"lte": 16.0}},
    "P003": {"price_vs_sma200": {"gt": 0}, "return_5d": {"lt": -2.0}, "rsi_14": {"lt": 45}},
    "P004": {"atr_pct": {"lt": 1.5}, "volume_trend": {"eq": "contracting"}, "rsi_14": {"between": [45, 55]}},
    "P005": {"fii_net_3d": {"gt": 500}, "return_5d": {"lt": -1.5}},
    "P006": {"price_vs_sma20": {"gt": 0}, "rsi_14": {"between": [55, 70]}, "volume_trend": {"eq": "expanding"}},
    "P007": {"iv_rank": {"gt": 70}, "rsi_14": {"gt": 65}, "return_5d": {"gt": 3.0}},
    "P008": {"iv_rank": {"lt": 25}, "atr_pct": {"lt": 1.2}, "bb_position": {"between": [0.35, 0.65]}},
    "P009": {"pcr": {"gt": 1.4}, "return_5d": {"lt": -3.0}, "rsi_14": {"lt": 38}},
    "P010": {"vix_level": {"gt": 22}, "rsi_14": {"lt": 38}, "fii_net_3d": {"gt": 200}},
}
SEED_LABELS = {
    "P001": "RSI Oversold + Volume Surge", "P002": "SMA-20 Breakout in Low VIX", "P003": "Pullback in Uptrend",
    "P004": "Volatility Squeeze", "P005": "FII Accumulation Dip", "P006": "Momentum Continuation",
    "P007": "High IV + Overbought → Premium Fade", "P008": "Low IV Squeeze → Cheap Options Breakout", "P009": "PCR Extreme + Oversold → Capitulation Buy",
    "P010": "VIX Spike + FII Defense → Recovery Signal",
}


def seed_catalog(spark) -> DataFrame:
    rows = [(k, SEED_LABELS[k], json.dumps(v), 1) for k, v in SEED_RULES.items()]
    return spark.createDataFrame(rows, "pattern_id string, label string, conditions_json string, is_active int")


def compile_condition(feature: Column, condition: dict) -> Column:
    for op, build in _OPS.items():
        if op in condition:
            return F.coalesce(build(feature, condition[op]), F.lit(False))
    return F.lit(False)


def compile_rule(conditions: dict | str, columns: list[str]) -> Column:
    """A rule over absent features never matches."""
    conds = json.loads(conditions) if isinstance(conditions, str) else conditions
    if any(f not in columns for f in conds):
        return F.lit(False)
    return all_of(compile_condition(F.col(f), c) for f, c in conds.items())


def match_rules(features: DataFrame, rules: dict[str, dict | str], id_column: str = "pattern_id") -> DataFrame:
    """One row per (feature row, matching rule)."""
    hits = F.array(*[F.when(compile_rule(c, features.columns), F.lit(pid)) for pid, c in rules.items()])
    return features.withColumn(id_column, F.explode(F.filter(hits, lambda h: h.isNotNull())))
