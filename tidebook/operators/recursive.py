"""Recursive smoothing and band-following indicators.

Exponential smoothing is a linear recurrence, so it needs no row loop: inside
a block of rows it is a scaled prefix sum, and across blocks only the previous
block's end value matters once the decay of a block falls below double
precision. That keeps EMA, Wilder averages, RSI, ATR and ADX in the JVM as
window expressions. Supertrend is a non-linear recursion and runs per key in
pandas; a key's daily history is bounded by trading days.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.exprs import clip, safe_div

# exp(-40) is below the resolution of a double.
_NEGLIGIBLE = 40.0
# exp(700) is still a double.
_OVERFLOW = 700.0


def ewm_mean(
    df: DataFrame, by: Sequence[str], order: str, specs: dict[str, tuple[str, float, int]]
) -> DataFrame:
    """Add ``out = (column, alpha, min_periods)`` exponential means.

    Semantics: ``y0 = x0; y = (1-alpha) * y_prev + alpha * x``; NULL until
    ``min_periods`` inputs were seen. NULL inputs are allowed only at the start
    of a key.
    """
    by = list(by)
    rate = {o: -math.log(1 - a) for o, (_, a, _) in specs.items()}
    block = math.ceil(_NEGLIGIBLE / min(rate.values()))
    # One block must hold the slowest decay without overflow in the fastest; others get a call of their own.
    near = {o: s for o, s in specs.items() if block * rate[o] <= _OVERFLOW}
    if len(near) < len(specs):
        far = {o: s for o, s in specs.items() if o not in near}
        out = ewm_mean(ewm_mean(df, by, order, near), by, order, far)
        return out.select(*df.columns, *specs)
    w = W.partitionBy(*by).orderBy(order)
    seen = w.rowsBetween(W.unboundedPreceding, 0)
    # The same order as ``w``, in the columns the blocks are sorted by: no second sort.
    before = W.partitionBy(*by).orderBy("_blk", "_rn").rowsBetween(W.unboundedPreceding, -1)

    pos = df.withColumn("_rn", F.row_number().over(w) - 1).withColumns(
        {f"_n_{o}": F.count(c).over(seen) for o, (c, _, _) in specs.items()}
    )
    pos = pos.withColumn("_blk", F.floor(F.col("_rn") / block)).withColumn("_j", F.col("_rn") % block)
    w_blk = W.partitionBy(*by, "_blk").orderBy("_rn").rowsBetween(W.unboundedPreceding, 0)
    part = {}
    for o, (c, a, _) in specs.items():
        weight = F.when(F.col(f"_n_{o}") == 1, F.lit(1.0)).otherwise(F.lit(a))
        term = weight * F.col(c) * F.pow(F.lit(1 - a), -F.col("_j"))
        part[f"_s_{o}"] = F.sum(term).over(w_blk) * F.pow(F.lit(1 - a), F.col("_j"))
    d = pos.withColumns(part)
    # End value of the previous block, carried into every row of this block.
    ends = {
        f"_e_{o}": F.last(F.when(F.col("_j") == block - 1, F.col(f"_s_{o}")), ignorenulls=True).over(before) for o in specs
    }
    d = d.withColumns(ends)
    out = {}
    for o, (_, a, min_periods) in specs.items():
        tail = F.coalesce(F.col(f"_e_{o}"), F.lit(0.0)) * F.pow(F.lit(1 - a), F.col("_j") + 1)
        out[o] = F.when(F.col(f"_n_{o}") >= max(1, min_periods), F.coalesce(F.col(f"_s_{o}"), F.lit(0.0)) + tail)
    return d.withColumns(out).select(*df.columns, *specs)


def ema(df: DataFrame, by: Sequence[str], order: str, value: str, spans: Sequence[int]) -> DataFrame:
    """Add ``ema_<span>`` columns, NULL before ``span`` rows."""
    out = df
    return ewm_mean(out, by, order, {f"ema_{n}": (value, 2.0 / (n + 1), n) for n in spans})


def rsi(df: DataFrame, by: Sequence[str], order: str, value: str, periods: Sequence[int], zero_loss: str = "ref") -> DataFrame:
    """Add ``rsi_<n>``: Wilder averages of gains and losses.

    ``zero_loss='ref'`` gives 0 where the average loss is 0 (the behaviour this
    library reproduces) and before ``n`` changes; ``'standard'`` gives 100 and 0.
    ``'missing'`` starts with the first change and is NULL where the average
    loss is 0.
    """
    w = W.partitionBy(*by).orderBy(order)
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    d = d.withColumn("_g", F.greatest(F.col("_d"), F.lit(0.0))).withColumn("_l", F.greatest(-F.col("_d"), F.lit(0.0)))
    d = d.withColumn("_g", F.when(F.col("_d").isNotNull(), F.col("_g"))).withColumn(
        "_l", F.when(F.col("_d").isNotNull(), F.col("_l"))
    )
    missing = zero_loss == "missing"
    specs = {}
    for n in periods:
        specs[f"_ag_{n}"] = ("_g", 1.0 / n, 1 if missing else n)
        specs[f"_al_{n}"] = ("_l", 1.0 / n, 1 if missing else n)
    e = ewm_mean(d, by, order, specs)
    flat = F.lit(0.0 if zero_loss == "ref" else 100.0)
    out = {}
    for n in periods:
        g, l = F.col(f"_ag_{n}"), F.col(f"_al_{n}")
        value_ = 100 - 100 / (1 + g / F.nullif(l, F.lit(0.0)))
        out[f"rsi_{n}"] = value_ if missing else F.when(l.isNull(), F.lit(0.0)).when(l == 0, flat).otherwise(value_)
    return e.withColumns(out).select(*df.columns, *[f"rsi_{n}" for n in periods])


def adx(df: DataFrame, by: Sequence[str], order: str, period: int = 14, out: str = "adx14") -> DataFrame:
    """Average directional index: three chained Wilder averages."""
    w = W.partitionBy(*by).orderBy(order)
    up = F.col("high") - F.lag("high").over(w)
    dn = F.lag("low").over(w) - F.col("low")
    pc = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    d = df.withColumn("_up", up).withColumn("_dn", dn).withColumn("_tr", tr)
    d = d.withColumn("_dmp", F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0))
    d = d.withColumn("_dmn", F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0))
    a = 1.0 / period
    e = ewm_mean(d, by, order, {"_atr": ("_tr", a, 1), "_p": ("_dmp", a, 1), "_n": ("_dmn", a, 1)})
    dip, din = safe_div(F.col("_p") * 100, "_atr"), safe_div(F.col("_n") * 100, "_atr")
    e = e.withColumn("_dip", dip).withColumn("_din", din)
    # Before the first move there is no direction: NULL, and smoothing starts at the first real value.
    # A smoothed sum never returns to 0 afterwards, so all gaps lead.
    e = e.withColumn("_dx", safe_div(F.abs(F.col("_dip") - F.col("_din")) * 100, F.col("_dip") + F.col("_din")))
    r = ewm_mean(e, by, order, {out: ("_dx", a, 1)})
    return r.withColumn(out, F.when(F.col(out).isNotNull(), clip(out, 0, 100))).select(*df.columns, out)


def supertrend(df: DataFrame, by: Sequence[str], order: str, atr: str, mult: float = 3.0, out: str = "supertrend_dir") -> DataFrame:
    """Direction (+1/-1) of price against trailing bands that only tighten
    while the trend holds. ``atr`` is a precomputed smoothed true range."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} double"

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        mid = (pdf["high"] + pdf["low"]) / 2
        raw_up = (mid + mult * pdf[atr]).to_numpy(float)
        raw_dn = (mid - mult * pdf[atr]).to_numpy(float)
        close = pdf["close"].to_numpy(float)
        side = np.ones(len(pdf))
        up, dn = (raw_up[0], raw_dn[0]) if len(pdf) else (0.0, 0.0)
        for i in range(1, len(pdf)):
            side[i] = 1.0 if close[i] > up else -1.0 if close[i] < dn else side[i - 1]
            if raw_up[i] < up or close[i - 1] > up:
                up = raw_up[i]
            if raw_dn[i] > dn or close[i - 1] < dn:
                dn = raw_dn[i]
        pdf[out] = side
        return pdf

    return df.groupBy(*by).applyInPandas(follow, schema)
