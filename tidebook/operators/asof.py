"""As-of, interval and fallback joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.functions.exprs import all_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    *,
    direction: str = "backward",
    allow_exact: bool = True,
    tolerance_days: int | None = None,
    time_slice: str | None = "month",
    matched_on: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Left rows with the nearest right row before (or after) them, per key.

    Both sides are unioned and a window carries the last right row forward.
    The window is partitioned by (key, time slice), never by the key alone, so
    one key with a third of all rows is spread over its slices. Rows whose
    slice holds no earlier right row take the carry: the last right row of the
    earlier slices, computed from one pre-aggregated row per (key, slice).

    ``time_slice=None`` is for keys whose rows are bounded, as one per day: one
    window by key, without slices and carry. ``tasks`` sets the number of tasks
    of the sorts, for inputs that outgrow the session's fixed number of shuffle
    partitions.
    """
    back = direction == "backward"
    by = list(by)
    on_t = left.schema[left_on].dataType
    # (value, on): equal right positions collapse to one row, greatest values win.
    r = right.groupBy(*by, F.col(right_on).cast(on_t).alias("_on")).agg(F.max(F.struct(*values)).alias("_val"))
    r = r.where(F.col("_on").isNotNull())
    # On a tie the right row must come first when exact matches count.
    right_first = allow_exact
    r = r.select(
        *by, "_on", F.lit(0 if right_first else 2).alias("_tag"),
        F.lit(None).cast(left.schema).alias("_left"),
        F.struct(F.col("_on").alias("on"), F.col("_val").alias("val")).alias("_right"),
    )
    lft = left.select(
        *by, F.col(left_on).alias("_on"), F.lit(1).alias("_tag"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(r.schema["_right"].dataType).alias("_right"),
    )
    u = lft.unionByName(r)
    on_order = F.col("_on").asc() if back else F.col("_on").desc()
    if time_slice is None:
        u = u.repartition(tasks, *by) if tasks else u
        w_key = W.partitionBy(*by).orderBy(on_order, F.col("_tag")).rowsBetween(W.unboundedPreceding, 0)
        known = all_of(F.col(c).isNotNull() for c in [*by, "_on"])
        j = u.withColumn("_m", F.when(known, F.last("_right", ignorenulls=True).over(w_key))).where(F.col("_left").isNotNull())
    else:
        j = _match_in_slices(u, by, back, on_order, time_slice, tasks)
    if tolerance_days is not None:
        gap = F.abs(F.datediff(F.col("_on"), F.col("_m.on")))
        j = j.withColumn("_m", F.when(gap <= tolerance_days, F.col("_m")))
    extra = [F.col("_m.on").alias(matched_on)] if matched_on else []
    return j.select("_left.*", *[F.col(f"_m.val.{v}").alias(v) for v in values], *extra)


def _match_in_slices(u: DataFrame, by: list[str], back: bool, on_order: Column, time_slice: str, tasks: int | None) -> DataFrame:
    """Left rows of the union with the last right row so far as ``_m``."""
    u = u.withColumn("_slice", F.date_trunc(time_slice, F.col("_on")).cast("date"))
    if tasks:
        u = u.repartition(tasks, *by, "_slice")
    w_in = W.partitionBy(*by, "_slice").orderBy(on_order, F.col("_tag")).rowsBetween(W.unboundedPreceding, 0)
    slice_order = F.col("_slice").asc() if back else F.col("_slice").desc()
    w_over = W.partitionBy(*by).orderBy(slice_order).rowsBetween(W.unboundedPreceding, -1)

    pick = F.max_by if back else F.min_by
    per_slice = u.groupBy(*by, "_slice").agg(pick("_right", F.col("_right.on")).alias("_edge"))
    if tasks:
        per_slice = per_slice.repartition(tasks, *by)
    carry = per_slice.withColumn("_carry", F.last("_edge", ignorenulls=True).over(w_over)).select(*by, "_slice", "_carry")

    hit = u.withColumn("_hit", F.last("_right", ignorenulls=True).over(w_in)).where(F.col("_left").isNotNull())
    return hit.join(carry, [*by, "_slice"], "left").withColumn("_m", F.coalesce("_hit", "_carry"))


def interval_hits(
    left: DataFrame, events: DataFrame, start: str, end: str, event_date: str, cap_days: int = 30
) -> DataFrame:
    """Per left row: is there an event in [start, end], and days to the next
    event from ``start`` (capped).

    The event calendar collapses to one row per calendar day: each day carries
    the next event day on or after it, so both answers come from one equi join
    on ``start`` instead of a range join. The calendar is bounded by days, not
    by data volume.
    """
    ev = events.select(F.col(event_date).alias("_ev")).distinct()
    lo = left.agg(F.min(start).alias("lo"), F.max(start).alias("hi"))
    days = lo.select(F.explode(F.sequence("lo", "hi")).alias("_day"))
    nxt = asof_join(
        days.withColumn("_k", F.lit(1)), ev.withColumn("_k", F.lit(1)), ["_k"], "_day", "_ev", ["_ev"], direction="forward"
    ).select("_day", F.col("_ev").alias("_next"))
    j = left.join(nxt, F.col(start) == F.col("_day"), "left")
    to_next = F.datediff(F.col("_next"), F.col(start))
    return j.select(
        *left.columns,
        F.when(F.col("_next") <= F.col(end), 1).otherwise(0).alias("event_in_window"),
        F.coalesce(F.least(to_next, F.lit(cap_days)), F.lit(cap_days)).alias("days_to_event"),
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary rows, plus fallback rows only for keys the primary lacks."""
    missing = fallback.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.unionByName(missing.select(*primary.columns))


def previous_match(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, out: str) -> DataFrame:
    """Greatest right position strictly before the left position."""
    r = right.select(*by, F.col(right_on).alias(out))
    return asof_join(left, r, by, left_on, out, [out], allow_exact=False)


def dim_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join of a dimension with defaults for unmatched rows."""
    j = df.join(dim, list(on), "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
