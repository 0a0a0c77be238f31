"""Structured Streaming jobs for live snapshots and open positions.

State is keyed by (symbol, day): a position never outlives its day, so state
is dropped by an event-time timer and a busy symbol is split over its days.
Stateful jobs take the watermarked stream of ``drain_to_end`` and fold each
key's rows in order of time, whatever their order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions import blackscholes as BS
from tidebook.functions.exprs import flag
from tidebook.session import shared_dir
from tidebook.streaming.ordered import LATENESS, drain, drain_to_end, ordered_fold  # noqa: F401

# Trading hours, trail share, cooldown and hedge limit.
EOD_MINUTE = 15 * 60 + 20
ENTRY_FROM, ENTRY_TO = 9 * 60 + 30, 14 * 60
TRAIL_SHARE = 0.75
COOLDOWN_MINUTES = 30
MAX_AGE_MINUTES = 20
HEDGE_LIMIT = 0.15
EOD_WARN_MINUTE = 15 * 60 + 15


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def drain_batches(df: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per micro-batch transform. Each batch overwrites its own folder, so a
    replayed batch does not add rows twice."""
    spark = df.sparkSession
    path, ckpt = shared_dir(spark, name), shared_dir(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    df.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def ingest_new_files(df: DataFrame, target: tuple[str, str]) -> DataFrame:
    """Append files not seen before; the checkpoint is the file registry."""
    return drain(df, "ingest", target)


def suppress_repeats(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark(list(keys))


def align(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], minutes: int = 5, ts: str = "ts") -> DataFrame:
    """Latest quote per key in each tumbling window. End markers have no key."""
    w = F.window(ts, f"{minutes} minutes")
    g = df.groupBy(w.alias("_w"), *keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"), F.count(keys[0]).alias("_n"))
    # A filter on the key itself would be moved below the watermark and hide the markers from it.
    return g.where("_n > 0").select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "_v.*")


def straddle_rows(chain: DataFrame) -> DataFrame:
    """At-the-money straddle of each snapshot: nearest expiry, smallest
    call-put gap, lowest strike."""
    from tidebook.plans.options import both_legs

    gap = F.abs(F.col("ce") - F.col("pe"))
    pick = F.min_by(F.struct("expiry", "strike", "ce", "pe"), F.struct("expiry", gap, "strike"))
    g = both_legs(chain).groupBy("symbol", "snap_date").agg(pick.alias("_b"))
    return g.select("symbol", "snap_date", "_b.*", (F.col("_b.ce") + F.col("_b.pe")).alias("straddle"))


def mark_to_market(quotes: DataFrame, positions: DataFrame) -> DataFrame:
    """Stream-static join: P&L of each open position at each quote."""
    pnl = (F.col("entry_value") - F.col("ltp")) * F.col("lot_size") * F.col("lots")
    return quotes.join(positions, "symbol").withColumn("pnl_inr", pnl)


def fresh(df: DataFrame, ts: str, seen: str, minutes: int = MAX_AGE_MINUTES) -> DataFrame:
    """Drop snapshots older than ``minutes`` when seen."""
    return df.where(F.unix_timestamp(seen) - F.unix_timestamp(ts) <= minutes * 60)


def minute_of_day(ts: str | Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def _keyed(df: DataFrame, step: Callable, out: str, order: list[str], initial: tuple) -> DataFrame:
    """Fold ``step(state, row) -> (state, output or None)`` over each
    (symbol, day) in order; the state goes a day after its day."""

    def fold(s, r):
        s, o = step(initial if s is None else s, r)
        return s, [] if o is None else [o]

    def lapse(key, s, now):
        over = datetime(key[1].year, key[1].month, key[1].day, tzinfo=timezone.utc).timestamp() + 2 * 86_400
        return (None, [], None) if now >= over else (s, [], over)

    return ordered_fold(df.withColumn("day", F.to_date("ts")), ["symbol", "day"], fold, out, order, lapse=lapse)


def _seconds(ts: datetime) -> float:
    return ts.replace(tzinfo=timezone.utc).timestamp()


def lifecycle(df: DataFrame, target: float, stop: float) -> DataFrame:
    """One position per (symbol, day), opened at the first mark. Checks in
    order: end of day, stop, trailing stop, arm the trail, hold."""

    def step(s, r):
        entry, peak, phase = s
        if phase == 0:
            return (float(r.ltp), 0.0, 1), None
        if phase == 3:
            return s, None
        pnl, minute = entry - r.ltp, r.ts.hour * 60 + r.ts.minute
        why = "eod" if minute >= EOD_MINUTE else "stop" if pnl <= -stop else None
        if why is None and phase == 2:
            peak = max(peak, pnl)
            why = "trail" if pnl <= peak * TRAIL_SHARE else None
        elif why is None and pnl >= target:
            return (entry, pnl, 2), None
        if why:
            return (entry, peak, 3), (r.ts, why, pnl)
        return (entry, peak, phase), None

    return _keyed(df.select("symbol", "ts", "event_id", "ltp"), step, "symbol string, day date, exit_time timestamp, exit_reason string, pnl double",
                  ["ts", "event_id"], (0.0, 0.0, 0))


def lifecycle_batch(df: DataFrame, target: float, stop: float) -> DataFrame:
    """The same exits from window functions over (symbol, day)."""
    d = df.withColumn("day", F.to_date("ts"))
    w = W.partitionBy("symbol", "day").orderBy("ts", "event_id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"_i": F.row_number().over(w), "_pnl": F.first("ltp").over(upto) - F.col("ltp")})
    live = F.col("_i") > 1
    d = d.withColumn("_armed_at", F.min(F.when(live & (F.col("_pnl") >= target), F.col("_i"))).over(upto))
    d = d.withColumn("_peak", F.max(F.when(F.col("_i") >= F.col("_armed_at"), F.col("_pnl"))).over(upto))
    why = (
        F.when(minute_of_day("ts") >= EOD_MINUTE, "eod").when(F.col("_pnl") <= -stop, "stop")
        .when((F.col("_i") > F.col("_armed_at")) & (F.col("_pnl") <= F.col("_peak") * TRAIL_SHARE), "trail")
    )
    d = d.where(live).withColumn("_why", why).where("_why is not null")
    g = d.groupBy("symbol", "day").agg(F.min_by(F.struct("ts", "_why", "_pnl"), "_i").alias("_x"))
    return g.select("symbol", "day", F.col("_x.ts").alias("exit_time"), F.col("_x._why").alias("exit_reason"), F.col("_x._pnl").alias("pnl"))


def entry_gate(df: DataFrame, min_premium: float, min_score: float) -> DataFrame:
    """Candidates inside trading hours, fresh, above the premium and score
    floors, and not within the cooldown after a stop on the same day.

    Rows have ts, seen, ltp, score and ``is_stop`` (1 = a stop happened)."""
    m = minute_of_day("ts")
    ok = (F.col("ltp") >= min_premium) & (F.col("score") >= min_score) & (m >= ENTRY_FROM) & (m < ENTRY_TO)
    ok = ok & (F.unix_timestamp("seen") - F.unix_timestamp("ts") <= MAX_AGE_MINUTES * 60)
    d = df.withColumn("candidate", flag(ok & (F.col("is_stop") == 0))).where("candidate = 1 or is_stop = 1 or symbol is null")

    def step(s, r):
        now = _seconds(r.ts)
        if r.is_stop == 1:
            return (now,), None
        if now - s[0] < COOLDOWN_MINUTES * 60:
            return s, None
        return s, (r.event_id, r.ts, float(r.ltp))

    return _keyed(d.select("symbol", "ts", "event_id", "ltp", "is_stop"), step, "symbol string, day date, event_id bigint, ts timestamp, ltp double", ["ts", "event_id"], (-1e18,))


@dataclass(frozen=True)
class Rules:
    """Limits of one position at a time, in points."""

    target: float
    stop: float
    min_premium: float
    min_score: float
    cooldown_minutes: int = COOLDOWN_MINUTES


def may_enter(rules: Rules) -> Column:
    """Trading hours, fresh snapshot, premium of at least the floor and twice
    the stop, score, and at least one critical input that is not zero.

    Rows have ts, seen, ltp, score and ``critical`` (an array of inputs)."""
    m = minute_of_day("ts")
    ok = (m >= ENTRY_FROM) & (m < ENTRY_TO) & (F.unix_timestamp("seen") - F.unix_timestamp("ts") <= MAX_AGE_MINUTES * 60)
    ok = ok & (F.col("ltp") >= max(rules.min_premium, 2 * rules.stop)) & (F.col("score") >= rules.min_score)
    return F.coalesce(ok & ((F.size("critical") == 0) | F.exists("critical", lambda c: c != 0)), F.lit(False))


TRADES = "entry_time timestamp, exit_time timestamp, exit_reason string, entry double, pnl double"


def full_lifecycle(df: DataFrame, rules: Rules) -> DataFrame:
    """Every closed position of a (symbol, day): entry through the gate, exit by
    end of day, stop or trailing stop, then entry again, after a stop not
    before the cooldown is over. A row either enters or is a mark."""

    def step(s, r):
        phase, entry, entered, peak, stopped = s
        if phase == 0:
            waits = stopped is not None and (r.ts - stopped).total_seconds() < rules.cooldown_minutes * 60
            return (s if waits or not r.may_enter else (1, float(r.ltp), r.ts, 0.0, stopped)), None
        pnl, minute = entry - r.ltp, r.ts.hour * 60 + r.ts.minute
        peak = max(peak, pnl)
        why = "eod" if minute >= EOD_MINUTE else "stop" if pnl <= -rules.stop else "trail" if phase == 2 and pnl <= peak * TRAIL_SHARE else None
        if why:
            return (0, 0.0, None, 0.0, r.ts if why == "stop" else stopped), (entered, r.ts, why, entry, pnl)
        if phase == 1:
            return ((2, entry, entered, pnl, stopped) if pnl >= rules.target else s), None
        return (2, entry, entered, peak, stopped), None

    marks = df.select("symbol", "ts", "event_id", "ltp", may_enter(rules).alias("may_enter"))
    return _keyed(marks, step, f"symbol string, day date, {TRADES}", ["ts", "event_id"], (0, 0.0, None, 0.0, None))


def full_lifecycle_batch(df: DataFrame, rules: Rules) -> DataFrame:
    """The same positions by a fold over the sorted marks of each (symbol, day),
    which are bounded by a trading day."""
    marks = df.select("symbol", F.to_date("ts").alias("day"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id", "ltp", may_enter(rules).alias("ok"), minute_of_day("ts").alias("minute")).alias("m"))
    none = F.expr(f"named_struct('phase', 0, 'entry', 0D, 'entered', cast(null as timestamp), 'peak', 0D, 'stopped', cast(null as timestamp), 'done', cast(array() as array<struct<{TRADES}>>))")

    def step(s: Column, r: Column) -> Column:
        pnl = s["entry"] - r["ltp"]
        peak = F.greatest(s["peak"], pnl)
        why = F.when(r["minute"] >= EOD_MINUTE, "eod").when(pnl <= -rules.stop, "stop").when((s["phase"] == 2) & (pnl <= peak * TRAIL_SHARE), "trail")
        waits = F.coalesce(F.unix_micros(r["ts"]) - F.unix_micros(s["stopped"]) < rules.cooldown_minutes * 60_000_000, F.lit(False))
        enters = (s["phase"] == 0) & r["ok"] & ~waits
        exits = (s["phase"] > 0) & why.isNotNull()
        armed = (s["phase"] == 2) | ((s["phase"] == 1) & (pnl >= rules.target))
        trade = F.struct(s["entered"].alias("entry_time"), r["ts"].alias("exit_time"), why.alias("exit_reason"), s["entry"].alias("entry"), pnl.alias("pnl"))
        return F.struct(
            F.when(enters, 1).when(exits, 0).when(s["phase"] == 0, 0).when(armed, 2).otherwise(1).alias("phase"),
            F.when(enters, r["ltp"]).when(exits, 0.0).otherwise(s["entry"]).alias("entry"), F.when(enters, r["ts"]).when(exits, None).otherwise(s["entered"]).alias("entered"),
            F.when(enters | exits | (s["phase"] == 0), 0.0).when(armed, F.when(s["phase"] == 1, pnl).otherwise(peak)).otherwise(0.0).alias("peak"),
            F.when(exits & (why == "stop"), r["ts"]).otherwise(s["stopped"]).alias("stopped"), F.when(exits, F.concat(s["done"], F.array(trade))).otherwise(s["done"]).alias("done"))

    sorted_marks = F.sort_array(F.collect_list("m"))
    folded = marks.groupBy("symbol", "day").agg(sorted_marks.alias("marks")).select("symbol", "day", F.explode(F.aggregate("marks", none, step, lambda s: s["done"])).alias("t"))
    return folded.select("symbol", "day", "t.*")


def net_delta(spot: Column, strike: Column, t: Column, iv: Column) -> Column:
    """Net delta of a short straddle: 1 - 2 N(d1)."""
    return 1 - 2 * BS.norm_cdf(BS.d1(spot, strike, t, F.lit(BS.RISK_FREE), iv))


def hedges(df: DataFrame, lot: float) -> DataFrame:
    """Hedge rows where |net delta| exceeds the limit, with the cumulative hedge."""
    d = df.where((F.abs("net_delta") > HEDGE_LIMIT) | F.col("symbol").isNull())

    def step(s, r):
        lots = -r.net_delta * lot
        total = s[0] + lots
        return (total,), (r.event_id, r.ts, float(r.net_delta), lots, "buy" if lots > 0 else "sell", total)

    return _keyed(d.select("symbol", "ts", "event_id", "net_delta"), step, "symbol string, day date, event_id bigint, hedge_time timestamp, net_delta double, hedge_lots double, hedge_direction string, cumulative_lots double",
                  ["ts", "event_id"], (0.0,))


ALERT_KINDS = ("entered", "target", "stop", "eod")


def alerts(df: DataFrame, target: float, stop: float) -> DataFrame:
    """One row per (position, kind), the first time the condition holds. The
    state is a bit per kind."""

    def step_all(s, r):
        entry, seen = s
        if seen == 0:
            entry = float(r.ltp)
        pnl, minute = entry - r.ltp, r.ts.hour * 60 + r.ts.minute
        hit = (True, pnl >= target, pnl <= -stop, minute >= EOD_WARN_MINUTE)
        new = [k for i, k in enumerate(ALERT_KINDS) if hit[i] and not seen >> i & 1]
        for i in range(len(ALERT_KINDS)):
            seen |= int(hit[i]) << i
        return (entry, seen), (r.ts, ",".join(new)) if new else None

    raw = _keyed(df.select("symbol", "ts", "event_id", "ltp"), step_all, "symbol string, day date, alert_time timestamp, kinds string", ["ts", "event_id"], (0.0, 0))
    return raw.select("symbol", "day", "alert_time", F.explode(F.split("kinds", ",")).alias("kind"))


POSITION_ALERTS = ("entered", "target", "stop", "eod", "trailing")


def position_alerts(df: DataFrame, target: float, stop: float, gone_after_minutes: int) -> DataFrame:
    """Alerts over snapshots of open positions, each kind once per position.

    A position opens with its first snapshot; ``trailing`` follows on the
    snapshot after the target was reached. A position without a snapshot for
    ``gone_after_minutes`` has closed: that alert comes from a timer, dated when
    the time was over, and a later snapshot opens a new position."""
    gap = gone_after_minutes * 60

    def gone(s):
        return datetime.fromtimestamp(s[3] + gap, timezone.utc).replace(tzinfo=None), "closed"

    def step(s, r):
        now = _seconds(r.ts)
        out = []
        if s is not None and now - s[3] >= gap:
            out.append(gone(s))
            s = None
        entry, seen, reached, _ = s or (float(r.ltp), 0, False, now)
        pnl, minute = entry - r.ltp, r.ts.hour * 60 + r.ts.minute
        hits = (True, pnl >= target, pnl <= -stop, minute >= EOD_WARN_MINUTE, reached)
        for i, kind in enumerate(POSITION_ALERTS):
            if hits[i] and not seen >> i & 1:
                seen |= 1 << i
                out.append((r.ts, kind))
        return (entry, seen, bool(reached or pnl >= target), now), out

    def lapse(key, s, now):
        return (None, [gone(s)], None) if now >= s[3] + gap else (s, [], s[3] + gap)

    return ordered_fold(df.select("symbol", "ts", "event_id", "ltp"), ["symbol"], step, "symbol string, alert_time timestamp, kind string", lapse=lapse)
