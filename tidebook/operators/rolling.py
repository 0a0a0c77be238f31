"""Row-window features over daily series.

Contract: a series has one row per (key, day), which the versioned-row reads
guarantee, so a window partition is bounded by the number of trading days no
matter how much raw data produced it. "N days" always means N rows.

Every function returns a ``Column``; compute as many as possible in one
``select`` so Spark plans one exchange and one ``Window`` node per frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.exprs import clip, col, pct_change, safe_div

TRADING_DAYS = 252


class Series:
    """Window expressions for one (key, date) ordering."""

    def __init__(self, by: Sequence[str], order: str = "date"):
        self.by, self.order = list(by), order

    @property
    def w(self) -> WindowSpec:
        # Built on use: importing a plan must not need a running session.
        return W.partitionBy(*self.by).orderBy(self.order)

    def rows(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    def all_before(self) -> WindowSpec:
        return self.w.rowsBetween(W.unboundedPreceding, 0)

    def row_number(self) -> Column:
        return F.row_number().over(self.w)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.w)

    def full(self, c, n: int, value: Column) -> Column:
        """``value`` once n non-NULL inputs were seen, else NULL. Inputs may be
        NULL only at the start of a series, so a running count decides it."""
        return F.when(F.count(col(c)).over(self.all_before()) >= n, value)

    # moving averages and distances
    def sma(self, c, n: int) -> Column:
        return self.full(c, n, F.avg(col(c)).over(self.rows(n)))

    def std(self, c, n: int) -> Column:
        return self.full(c, n, F.stddev_samp(col(c)).over(self.rows(n)))

    def vs_sma(self, c, n: int) -> Column:
        return F.coalesce(pct_change(c, self.sma(c, n)), F.lit(0.0))

    def zscore(self, c, n: int, flat: float | None = 0.0) -> Column:
        """Needs n+1 rows of history; a flat window gives ``flat``."""
        z = safe_div(col(c) - self.sma(c, n), self.std(c, n))
        ready = self.row_number() >= n + 1
        return F.when(ready, F.coalesce(z, F.lit(flat))).otherwise(F.lit(0.0))

    # returns and extremes
    def ret(self, c, n: int) -> Column:
        past = self.lag(c, n)
        return F.when(past > 0, (col(c) - past) / past * 100)

    def drawdown(self, c, n: int = TRADING_DAYS) -> Column:
        hi = F.max(col(c)).over(self.rows(n))
        return F.when(hi > 0, (hi - col(c)) / hi * 100).otherwise(0.0)

    def true_range(self, high="high", low="low", close="close") -> Column:
        pc = self.lag(close)
        h, l = col(high), col(low)
        return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))

    def bollinger(self, c, n: int = 20, k: float = 2.0) -> Column:
        """Position between the bands in [0, 1]; flat or short history gives 0.5."""
        ma, sd = self.sma(c, n), self.std(c, n)
        pos = safe_div(col(c) - (ma - k * sd), 2 * k * sd)
        return F.coalesce(clip(pos, 0.0, 1.0), F.lit(0.5))

    def minmax_rank(self, c, n: int = TRADING_DAYS) -> Column:
        lo, hi = F.min(col(c)).over(self.rows(n)), F.max(col(c)).over(self.rows(n))
        return F.when(hi > lo, (col(c) - lo) / (hi - lo) * 100).otherwise(50.0)

    def share_below(self, c, n: int = TRADING_DAYS) -> Column:
        """Share of the trailing window strictly below the current value, in %.
        The collected array is bounded by n."""
        arr = F.collect_list(col(c)).over(self.rows(n))
        cur = col(c)
        return F.size(F.filter(arr, lambda v: v < cur)) / F.size(arr) * 100

    def pct_rank(self, c, n: int = TRADING_DAYS, min_periods: int = 20) -> Column:
        """Average-tie percentile rank of the current value, in %."""
        arr = F.collect_list(col(c)).over(self.rows(n))
        cur = col(c)
        less = F.size(F.filter(arr, lambda v: v < cur))
        same = F.size(F.filter(arr, lambda v: v == cur))
        return F.when(F.size(arr) >= min_periods, (less + (same + 1) / 2.0) / F.size(arr) * 100)


def trailing_sums(df: DataFrame, s: Series, n: int, cols: dict[str, Column], skip_current: bool = False) -> DataFrame:
    """Sums over the last n rows (or the n rows before the current one) as
    differences of running sums: linear in the series length, where a sliding
    frame re-reads n rows for every row."""
    d = df.withColumns({f"_cum_{o}": F.coalesce(F.sum(c).over(s.all_before()), F.lit(0.0)) for o, c in cols.items()})
    out = {}
    for o in cols:
        cum = F.col(f"_cum_{o}")
        newest = F.lag(cum, 1).over(s.w) if skip_current else cum
        oldest = F.lag(cum, n + 1 if skip_current else n).over(s.w)
        out[o] = F.coalesce(newest, F.lit(0.0)) - F.coalesce(oldest, F.lit(0.0))
    return d.withColumns(out).drop(*[f"_cum_{o}" for o in cols])


def sample_variance(total: Column, squares: Column, n: Column) -> Column:
    """Sample variance from sums; differences at rounding level count as 0."""
    v = (squares - total * total / F.nullif(n, F.lit(0.0))) / F.nullif(n - 1, F.lit(0.0))
    return F.when(F.abs(v) <= 1e-13 * F.abs(squares), F.lit(0.0)).otherwise(v)


def crossover(df: DataFrame, s: Series, value: str, base: str, out: str) -> DataFrame:
    """+1 when value crosses above base on this row, -1 below, else 0."""
    d = F.col(value) - F.col(base)
    prev = F.lag(d).over(s.w)
    x = F.when((prev < 0) & (d >= 0), 1).when((prev > 0) & (d <= 0), -1).otherwise(0)
    return df.withColumn(out, x)


def volume_trend(s: Series, c: str, short: int = 5, long: int = 20) -> Column:
    ratio = safe_div(F.avg(c).over(s.rows(short)), F.avg(c).over(s.rows(long)))
    lab = F.when(ratio > 1.1, "expanding").when(ratio < 0.9, "contracting").otherwise("flat")
    return F.when(s.row_number() >= long, lab).otherwise("flat")


def period_rollup(
    df: DataFrame, by: Sequence[str], period: Column, name: str, *, order: str = "date",
    open_="open", high="high", low="low", close="close",
) -> DataFrame:
    """One bar per (key, period): first open, high, low, last close."""
    return df.groupBy(*by, period.alias(name)).agg(
        F.min_by(open_, order).alias("open"), F.max(high).alias("high"),
        F.min(low).alias("low"), F.max_by(close, order).alias("close"),
    )


def week_ending(date, weekday: str = "Thu") -> Column:
    """The date of the next given weekday on or after ``date``."""
    return F.next_day(F.date_sub(col(date), 1), weekday)


def month_of(date="date") -> Column:
    return F.trunc(col(date), "MM")


def change_events(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows where the value differs from the previous row of the key."""
    w = W.partitionBy(*by).orderBy(order)
    prev = F.lag(value).over(w)
    return df.withColumn("_prev", prev).where(F.col("_prev").isNull() | (F.col(value) != F.col("_prev"))).drop("_prev")


def fill_forward(df: DataFrame, by: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Last non-zero value so far, 0 before the first."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    nz = F.when(F.col(value) != 0, F.col(value))
    return df.withColumn(out, F.coalesce(F.last(nz, ignorenulls=True).over(w), F.lit(0.0)))
