"""Running aggregates, streaks, ranks and exact quantiles that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task.
The functions here split each key into slices of the ordering column, run the
window inside a slice, and add the carry of earlier slices. The carry comes
from one pre-aggregated row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sliced_running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slice_by: str,
    *,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Running sums and maxima per key in ``order``.

    ``slice_by`` must be non-decreasing along ``order`` within a key.
    """
    by, sums, maxes = list(by), sums or {}, maxes or {}
    end = 0 if include_current else -1
    w_in = W.partitionBy(*by, slice_by).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    w_over = W.partitionBy(*by).orderBy(slice_by).rowsBetween(W.unboundedPreceding, -1)

    aggs = [F.sum(c).alias(f"_t_{o}") for o, c in sums.items()] + [F.max(c).alias(f"_t_{o}") for o, c in maxes.items()]
    tot = df.groupBy(*by, slice_by).agg(*aggs)
    carry = tot.select(
        *by, slice_by,
        *[F.sum(f"_t_{o}").over(w_over).alias(f"_c_{o}") for o in sums],
        *[F.max(f"_t_{o}").over(w_over).alias(f"_c_{o}") for o in maxes],
    )
    inner = df.withColumns(
        {**{f"_i_{o}": F.sum(c).over(w_in) for o, c in sums.items()},
         **{f"_i_{o}": F.max(c).over(w_in) for o, c in maxes.items()}}
    )
    j = inner.join(carry, [*by, slice_by], "left")
    zero = F.lit(0)
    out = {o: F.coalesce(F.col(f"_i_{o}"), zero) + F.coalesce(F.col(f"_c_{o}"), zero) for o in sums}
    out |= {o: F.greatest(F.col(f"_i_{o}"), F.col(f"_c_{o}")) for o in maxes}
    return j.withColumns(out).select(*df.columns, *sums, *maxes)


def equity_curve(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_by: str, value: str) -> DataFrame:
    """Cumulative value, its running peak, and the fall from that peak."""
    cum = sliced_running(df, by, order, slice_by, sums={"cum": value})
    pk = sliced_running(cum, by, order, slice_by, maxes={"peak": "cum"})
    return pk.withColumn("drawdown", F.col("peak") - F.col("cum"))


def max_drawdown(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_by: str, value: str) -> DataFrame:
    return equity_curve(df, by, order, slice_by, value).groupBy(*by).agg(F.max("drawdown").alias("max_drawdown"))


def current_streak(df: DataFrame, by: Sequence[str], order: Sequence[str], win: str) -> DataFrame:
    """Length and side of the streak each key ends with.

    No window is needed: the streak is every row later than the last row of
    the other side, so two aggregations answer it.
    """
    by = list(by)
    o = F.struct(*order)
    last = df.groupBy(*by).agg(
        F.max(F.when(F.col(win) == 1, o)).alias("_lw"), F.max(F.when(F.col(win) != 1, o)).alias("_ll")
    )
    j = df.select(*by, o.alias("_o"), F.col(win).alias("_w")).join(last, by)
    ends_win = F.col("_ll").isNull() | (F.col("_lw") > F.col("_ll"))
    other = F.when(ends_win, F.col("_ll")).otherwise(F.col("_lw"))
    in_streak = other.isNull() | (F.col("_o") > other)
    return j.groupBy(*by).agg(
        F.max(F.when(ends_win, "W").otherwise("L")).alias("streak_type"),
        F.sum(F.when(in_streak, 1).otherwise(0)).alias("streak"),
    )


def longest_run(df: DataFrame, by: Sequence[str], order: Sequence[str], slice_by: str, hit: Column, out: str) -> DataFrame:
    """Longest run of consecutive rows where ``hit`` holds.

    Rows of one run share the position of the last non-hit row before them;
    that running maximum is the island id.
    """
    by = list(by)
    d = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn(
        "_stop", F.when(~F.col("_hit"), F.struct(*order))
    )
    isl = sliced_running(d, by, order, slice_by, maxes={"_island": "_stop"})
    runs = isl.where("_hit").groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("_n"))
    best = runs.groupBy(*by).agg(F.max("_n").alias(out))
    keys = df.select(*by).distinct()
    return keys.join(best, by, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def average_rank_auc(df: DataFrame, by: Sequence[str], score: str, label: str, resolution: int = 1024) -> DataFrame:
    """Area under the ROC curve from average ranks.

    Equal scores collapse first, then ranks come from a running count sliced by
    score band; no task ever sees all rows of a key.
    """
    by = list(by)
    s = F.col(score).cast("double")
    per = df.groupBy(*by, s.alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p")
    ).withColumn("_band", F.floor(F.col("_s") * resolution))
    r = sliced_running(per, by, ["_s"], "_band", sums={"_below": "_n"}, include_current=False)
    g = r.groupBy(*by).agg(
        F.sum(F.col("_p") * (F.col("_below") + (F.col("_n") + 1) / 2.0)).alias("_rp"),
        F.sum("_p").alias("n_pos"), F.sum(F.col("_n") - F.col("_p")).alias("n_neg"),
    )
    p, n = F.col("n_pos"), F.col("n_neg")
    auc = F.when((p > 0) & (n > 0), (F.col("_rp") - p * (p + 1) / 2.0) / (p * n))
    return g.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], cuts: int = 256
) -> DataFrame:
    """Exact linear-interpolated quantiles for groups of any size.

    Spark's exact ``percentile`` keeps every distinct value of a group in one
    task. Here values are counted first, banded by approximate cut points, and
    ranked by a running count per band; only the rows that hold a requested
    rank are read out.
    """
    by = list(by)
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    per = base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    probs = [i / cuts for i in range(1, cuts)]
    key = by or ["_all"]
    if not by:
        per = per.withColumn("_all", F.lit(1))
        base = base.withColumn("_all", F.lit(1))
    meta = base.groupBy(*key).agg(
        F.percentile_approx("_v", probs, 10000).alias("_cuts"), F.count(F.lit(1)).alias("_total")
    )
    banded = per.join(meta, key).withColumn(
        "_band", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    ).drop("_cuts")
    run = sliced_running(banded, key, ["_v"], "_band", sums={"_upto": "_n"})
    lo_rank, hi_rank = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    aggs = []
    for name, q in quantiles.items():
        h = (F.col("_total") - 1) * F.lit(float(q))
        for side, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.max(F.when((pos >= lo_rank) & (pos <= hi_rank), F.col("_v"))).alias(f"_{name}_{side}"))
    g = run.groupBy(*key).agg(F.max("_total").alias("n"), *aggs)
    out = []
    for name, q in quantiles.items():
        h = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return g.select(*by, "n", *out)


def mode_of(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value; ties take the smallest. Counts combine map-side."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))
