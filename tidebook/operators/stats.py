"""Aggregates: stat bundles, correlations, tests, sweeps, splits, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.blackscholes import norm_cdf
from tidebook.functions.exprs import attach_row, clip, col, flag, literal_rows, safe_div


def summary_exprs(ret: str, hit: Column | None = None, annual: float = 1.0) -> list[Column]:
    """n, win rate, mean, best, worst, std and Sharpe of a return column."""
    r = F.col(ret)
    win = hit if hit is not None else r > 0
    return [
        F.count(F.lit(1)).alias("n"),
        (F.avg(flag(win)) * 100).alias("win_rate"),
        F.avg(r).alias("avg_ret"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
        F.stddev_samp(r).alias("std"),
        F.coalesce(safe_div(F.avg(r), F.stddev_samp(r)) * (annual**0.5), F.lit(0.0)).alias("sharpe"),
    ]


def split_label(df: DataFrame, date: str, train_end: Column) -> DataFrame:
    """Each row twice: once as 'full', once as 'train' or 'test'."""
    part = F.when(F.col(date) <= train_end, F.lit("train")).otherwise(F.lit("test"))
    return df.withColumn("period", F.explode(F.array(F.lit("full"), part)))


def guarded_corr(x: str, y: str, min_n: int = 3) -> Column:
    """Pearson correlation clipped to [-1, 1]; 0 when n is small or a side is flat."""
    ok = (F.col(x).isNotNull()) & (F.col(y).isNotNull())
    xs, ys = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    n = F.count(xs)
    denom = F.sqrt(F.var_pop(xs) * n * (F.var_pop(ys) * n))
    good = (n >= min_n) & (denom >= 1e-12)
    r = safe_div(F.covar_pop(xs, ys) * n, denom)
    return F.when(good, clip(r, -1.0, 1.0)).otherwise(0.0)


def two_sided_p(t: str | Column) -> Column:
    return 2 * (1 - norm_cdf(F.abs(col(t))))


def one_sample_t(x: str) -> Column:
    return safe_div(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def expectancy(profit: str, win: str) -> list[Column]:
    """Win rate and wr * avg win + (1 - wr) * avg loss."""
    wr = F.avg(win)
    aw = F.coalesce(F.avg(F.when(F.col(win) == 1, F.col(profit))), F.lit(0.0))
    al = F.coalesce(F.avg(F.when(F.col(win) == 0, F.col(profit))), F.lit(0.0))
    return [F.count(F.lit(1)).alias("n"), (wr * 100).alias("win_rate"), (wr * aw + (1 - wr) * al).alias("expectancy")]


def threshold_sweep(df: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float], direction: str = "ge") -> DataFrame:
    """Share of rows beyond each threshold, for a fixed list of thresholds.

    All thresholds are evaluated in one pass as separate aggregates, then
    unpivoted; rows are not multiplied before the shuffle.
    """
    v = F.col(value)
    hit = (lambda t: v >= t) if direction == "ge" else (lambda t: v <= t)
    aggs = [F.avg(flag(hit(float(t)))).alias(f"_t{i}") for i, t in enumerate(thresholds)]
    agg = df.where(v.isNotNull()).groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"_t{i}") * 100).alias("hit_rate")) for i, t in enumerate(thresholds)])
    return agg.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def welch(df_buckets: DataFrame, value: str, a: str, b: str, bucket: str = "bucket") -> DataFrame:
    """Difference of two bucket means, Welch t and two-sided normal p."""
    def part(name: str, which: str) -> list[Column]:
        x = F.when(F.col(bucket) == which, F.col(value))
        return [F.avg(x).alias(f"m_{name}"), F.var_samp(x).alias(f"v_{name}"), F.count(x).alias(f"n_{name}")]

    g = df_buckets.agg(*part("a", a), *part("b", b))
    se = F.sqrt(safe_div("v_a", "n_a") + safe_div("v_b", "n_b"))
    t = F.coalesce(safe_div(F.col("m_a") - F.col("m_b"), se), F.lit(0.0))
    return g.select((F.col("m_a") - F.col("m_b")).alias("diff"), t.alias("t_stat")).withColumn("p_value", two_sided_p("t_stat"))


def monthly_filled_sharpe(trades: DataFrame, exit_date: str, ret: str) -> DataFrame:
    """Mean return per exit month, months without an exit filled with 0, then
    mean/std * sqrt(12)."""
    m = trades.groupBy(F.trunc(exit_date, "MM").alias("month")).agg(F.avg(ret).alias("r"))
    span = m.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    f = months.join(m, "month", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    sd = F.stddev_samp("r")
    return f.agg(
        F.count(F.lit(1)).alias("months"), F.avg("r").alias("mean_ret"), sd.alias("std_ret"),
        (safe_div(F.avg("r"), sd) * 12**0.5).alias("sharpe"),
    )


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best n rows per key. Spark inserts a per-task group limit below the
    shuffle for ``row_number() <= n``, so a hot key sends n rows per task."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_k_share(df: DataFrame, by: Sequence[str], value: str, k: int, out: str) -> DataFrame:
    """Sum of the k largest values over the total (denominator at least 1)."""
    top = top_n(df.select(*by, value), by, [F.col(value).desc()], k).groupBy(*by).agg(F.sum(value).alias("_top"))
    tot = df.groupBy(*by).agg(F.sum(value).alias("_tot"))
    return tot.join(top, list(by), "left").select(
        *by, (F.coalesce("_top", F.lit(0)).cast("double") / F.greatest(F.col("_tot").cast("double"), F.lit(1.0))).alias(out)
    )


def nearest(df: DataFrame, by: Sequence[str], candidate: str, target: str, out: str) -> DataFrame:
    """Candidate closest to the target; ties take the lowest candidate."""
    c = F.col(candidate)
    return df.groupBy(*by).agg(F.min_by(c, F.struct(F.abs(c - F.col(target)), c)).alias(out))


def quantile_bins(df: DataFrame, by: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Equal-frequency bins with interpolated edges, right-closed, lowest
    included (differs from ``ntile`` on ties)."""
    probs = [i / bins for i in range(1, bins)]
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("_edges"))
    j = df.join(edges, list(by)) if by else attach_row(df, edges)
    b = F.size(F.filter("_edges", lambda e: e < F.col(value))) + 1
    return j.withColumn(out, b).drop("_edges")


def minmax_norm(df: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "n_", flat: float = 0.5) -> DataFrame:
    """Min-max scale columns within a group. The extremes come from a grouped
    aggregate joined back, not from an unordered window over the group."""
    g = df.groupBy(*by).agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    j = df.join(g, list(by))
    out = {
        f"{prefix}{c}": F.coalesce(safe_div(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(flat))
        for c in cols
    }
    return j.withColumns(out).drop(*[f"_lo_{c}" for c in cols], *[f"_hi_{c}" for c in cols])


def complete_groups(df: DataFrame, targets: DataFrame, key: str, fills: dict[str, float]) -> DataFrame:
    """Full outer completion: target keys absent from ``df`` appear with fills."""
    j = df.join(targets, key, "full_outer")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def one_hot(df: DataFrame, column: str, values: Sequence, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values})


__all__ = [n for n in dir() if not n.startswith("_")] + ["literal_rows"]
