"""Stream results equal their batch twins when data arrives in several files."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.session import shared_dir
from tidebook.sources.adapters import Tables
from tidebook.streaming import jobs as J

ROOT = "/root/testdata/sf0.001"


def split_ticks(spark, files="days"):
    d = Tables(spark, ROOT).ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    path = shared_dir(spark, "ticks")
    if files == "days":  # one file per day, written in order: state must survive across batches
        for day in [r[0] for r in d.select(F.to_date("ts")).distinct().orderBy(F.to_date("ts")).collect()]:
            d.where(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(path)
    else:  # three files per day, each with every third row, the later rows first
        third = d.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
        for part in (2, 0, 1):
            third.where(F.col("part") == part).drop("part").orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(path)
    return d, J.stream_parquet(spark, path, d.schema, max_files=5 if files == "days" else None)


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_lifecycle_stream_equals_batch(spark):
    batch, stream = split_ticks(spark)
    got = J.drain_to_end(stream, lambda d: J.lifecycle(d, 10.0, 20.0), "lifecycle")
    cols = ["symbol", "day", "exit_time", "exit_reason", F.round("pnl", 6)]
    want = rows(J.lifecycle_batch(batch, 10.0, 20.0).select(*cols))
    assert want and rows(got.select(*cols)) == want


def test_alignment_stream_equals_batch_with_all_windows(spark):
    batch, stream = split_ticks(spark)
    got = J.drain_to_end(stream, lambda d: J.align(d, ["symbol"], ["ltp"], ["ts", "event_id"]), "align")
    want = J.align(batch, ["symbol"], ["ltp"], ["ts", "event_id"])
    assert rows(got) == rows(want)


def fold(marks, rules):
    """Positions of one (symbol, day) by a plain loop."""
    out, entered, stopped = [], None, None
    for r in marks:
        minute = r.ts.hour * 60 + r.ts.minute
        if entered is None:
            if r.ok and (stopped is None or (r.ts - stopped).total_seconds() >= 1800):
                entered, entry, peak = r.ts, r.ltp, None
            continue
        pnl = entry - r.ltp
        if peak is not None:
            peak = max(peak, pnl)
        why = "eod" if minute >= J.EOD_MINUTE else "stop" if pnl <= -rules.stop else "trail" if peak is not None and pnl <= 0.75 * peak else None
        if why:
            out.append((entered, r.ts, why, round(pnl, 6)))
            entered, stopped = None, r.ts if why == "stop" else stopped
        elif peak is None and pnl >= rules.target:
            peak = pnl
    return out


def busy_marks(spark):
    """Every three minutes of two days, so that positions open again after trailing and stop exits."""
    import math
    from datetime import datetime, timedelta

    out = []
    for s, symbol in enumerate("abc"):
        for day in range(2):
            for i in range(130):
                ts = datetime(2024, 3, 4 + day, 9, 15) + timedelta(minutes=3 * i)
                ltp = 100 + 30 * math.sin(i / (3 + s)) + 7 * math.sin(i * 1.7 + day)
                late = ts + timedelta(minutes=25 if i % 7 == 0 else 5)
                out.append((symbol, ts, len(out), ltp, late, float(i % 50), [0.0, float(i % 3)]))
    return spark.createDataFrame(out, "symbol string, ts timestamp, event_id long, ltp double, seen timestamp, score double, critical array<double>")


def test_full_lifecycle_from_shuffled_files_equals_batch_and_loop(spark):
    marks, rules = busy_marks(spark), J.Rules(10.0, 20.0, 30.0, 5.0)
    path = shared_dir(spark, "marks")
    for part in (1, 0, 2):  # each file holds every third row of all days
        marks.where(F.col("event_id") % 3 == part).orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(path)
    got = J.drain_to_end(J.stream_parquet(spark, path, marks.schema), lambda d: J.full_lifecycle(d, rules), "trades")
    cols = ["symbol", "day", "entry_time", "exit_time", "exit_reason", F.round("pnl", 6)]
    batch = J.full_lifecycle_batch(marks, rules).select(*cols)
    groups = {}
    for r in marks.withColumn("ok", J.may_enter(rules)).orderBy("ts").collect():
        groups.setdefault((r.symbol, r.ts.date()), []).append(r)
    want = sorted(tuple(str(v) for v in (*key, *t)) for key, ms in groups.items() for t in fold(ms, rules))
    assert rows(batch) == want and rows(got.select(*cols)) == want
    assert {w[4] for w in want} >= {"stop", "trail"} and len(want) > 2 * len(groups)


def test_gate_and_hedges_from_shuffled_files(spark):
    batch, stream = split_ticks(spark, "thirds")
    nd = (F.col("event_id") % 11 / 10.0 - 0.5).alias("net_delta")
    got = J.drain_to_end(stream.select("*", nd), lambda d: J.hedges(d, 50.0), "hedges")
    total = F.sum(-F.col("net_delta") * 50).over(W.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "event_id"))
    want = batch.select("*", nd).where("abs(net_delta) > 0.15").select("symbol", "event_id", F.round(total, 6))
    assert rows(got.select("symbol", "event_id", F.round("cumulative_lots", 6))) == rows(want)


def test_alerts_come_without_a_row(spark):
    from datetime import datetime as dt

    snaps = [("a", dt(2024, 3, 4, 10, 0), 1, 100.0), ("a", dt(2024, 3, 4, 10, 5), 2, 85.0), ("a", dt(2024, 3, 4, 10, 10), 3, 95.0), ("a", dt(2024, 3, 4, 15, 20), 4, 90.0), ("b", dt(2024, 3, 4, 10, 1), 5, 50.0), ("b", dt(2024, 3, 4, 10, 6), 6, 75.0)]
    d = spark.createDataFrame(snaps, "symbol string, ts timestamp, event_id long, ltp double")
    path = shared_dir(spark, "snaps")
    d.orderBy(F.desc("ts")).coalesce(1).write.parquet(path)
    got = J.drain_to_end(J.stream_parquet(spark, path, d.schema), lambda d: J.position_alerts(d, 10.0, 20.0, 20), "alerts")
    want = [("a", "10:00", "entered"), ("a", "10:05", "target"), ("a", "10:10", "trailing"), ("a", "10:30", "closed"), ("a", "15:20", "entered"), ("a", "15:20", "eod"), ("a", "15:40", "closed"),
            ("b", "10:01", "entered"), ("b", "10:06", "stop"), ("b", "10:26", "closed")]
    assert sorted((r.symbol, r.alert_time.strftime("%H:%M"), r.kind) for r in got.collect()) == sorted(want)


def test_state_entries_do_not_grow_with_the_keys(spark):
    """A state call per key took most of the time of a stream of many symbols."""
    from tidebook.streaming.ordered import watermarked

    at = F.timestamp_seconds(F.lit(1_709_600_400) + F.col("id") % 2 * 60)
    d = spark.range(6000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias("symbol"), at.alias("ts"), F.col("id").alias("event_id"), (100.0 - F.col("id") % 2 * 30).alias("ltp"))
    path = shared_dir(spark, "many")
    d.write.parquet(path)
    q = J.alerts(watermarked(J.stream_parquet(spark, path, d.schema)), 10.0, 20.0).writeStream.format("noop").option("checkpointLocation", shared_dir(spark, "many-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    written = sum(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"])
    assert 0 < written < 3000
    got = J.drain_to_end(J.stream_parquet(spark, path, d.schema), lambda d: J.alerts(d, 10.0, 20.0), "many")
    assert {(r.kind, r["count"]) for r in got.groupBy("kind").count().collect()} == {("entered", 3000), ("target", 3000)}


def test_open_states_last_over_batches_of_a_shelf(spark):
    """Stretches of one shelf fall due in different batches; the rest of the shelf stays."""
    from datetime import datetime, timedelta

    path = shared_dir(spark, "steps")
    start = datetime(2024, 3, 4, 9, 15)
    snaps = [(s, start + timedelta(minutes=7 * i), 2 * i + k, 100.0 - i) for i in range(55) for k, s in enumerate("ab")]
    d = spark.createDataFrame(snaps, "symbol string, ts timestamp, event_id long, ltp double")
    for part in range(11):
        d.where(F.floor(F.col("event_id") / 10) == part).coalesce(1).write.mode("append").parquet(path)
    got = J.drain_to_end(J.stream_parquet(spark, path, d.schema, max_files=1), lambda d: J.lifecycle(d, 10.0, 20.0), "steps")
    assert rows(got.drop("pnl")) == rows(J.lifecycle_batch(d, 10.0, 20.0).drop("pnl")) and got.count() == 2


def test_ingest_twice_adds_nothing(spark):
    batch, stream = split_ticks(spark)
    target = (shared_dir(spark, "in"), shared_dir(spark, "in-ckpt"))
    J.ingest_new_files(stream, target)
    assert J.ingest_new_files(stream, target).count() == batch.count()
