"""Keyed state machines that fold their rows in event-time order.

Keys are dealt over a fixed number of buckets, and a bucket is what Spark's
state is kept by: a key has few rows, so a state call per key costs far more
than folding them. Rows wait in map state, one entry per shelf of six hours of
a bucket, until the watermark has passed their stretch of ``hold_minutes``; then
a timer hands them to the step function of their key by order columns. Late and
shuffled files therefore give the same result as sorted ones, and a task holds
one shelf of one bucket and the open states of its keys, not a bucket's
micro-batch. Output may come from a timer alone (``lapse``), with no input row.

A bounded run ends with an end marker: a row without a key, from a source of
its own, whose time lies beyond the last row. See ``drain_to_end``.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import defaultdict, namedtuple
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebook.session import shared_dir

LATENESS = "20 minutes"

#: Fixed for the life of a checkpoint. A bucket's open states are in memory at once.
BUCKETS = 256
#: Seconds of rows in one entry of map state; a multiple of every stretch.
SHELF = 6 * 3600
#: Rows of a micro-batch that are put into map state together, and rows of an output frame.
CHUNK = 50_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Later than any row of a run that is over.
END_OF_RUN = datetime(2100, 1, 1)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_POLICY = "spark.sql.streaming.multipleWatermarkPolicy"

Step = Callable[[tuple | None, object], tuple[tuple | None, list[tuple]]]
Lapse = Callable[[tuple, tuple, float], tuple[tuple | None, list[tuple], float | None]]


class OrderedFold(StatefulProcessor):
    """``step(state, row)`` gives the key's next state (None: nothing to keep)
    and output rows. ``lapse(key, state, now)`` is asked when all rows before
    ``now`` (seconds) are folded: it gives the next state, output rows, and the
    time at which it wants to be asked again (None: not at all)."""

    def __init__(self, step: Step, columns: list[str], keys: Sequence[str], fields: list[str], order: Sequence[str], hold_minutes: int, lapse: Lapse | None) -> None:
        self.step, self.columns, self.keys, self.fields, self.order = step, columns, list(keys), fields, list(order)
        self.hold, self.lapse = hold_minutes * 60, lapse

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The open states of the bucket: {key: (state, time to ask lapse or None)}.
        self.current = handle.getValueState("current", "states binary")
        self.waiting = handle.getMapState("waiting", "shelf long", "chunks array<binary>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n, first = defaultdict(list), 0, None
        for frame in rows:
            frame = frame[frame[self.keys[0]].notna()]  # the others are end markers
            if frame.empty:
                continue
            stretches = (frame["ts"].astype("int64") // 10 ** {"ns": 9, "us": 6, "ms": 3, "s": 0}[frame["ts"].dt.unit]) // self.hold
            columns = [_plain(frame[c]) for c in [*self.keys, *self.fields]]
            for row in zip(stretches.tolist(), *columns, strict=True):
                held[row[0] * self.hold // SHELF].append(row)
            n += len(frame)
            earliest = int(stretches.min())
            first = earliest if first is None else min(first, earliest)
            if n >= CHUNK:
                self._hold(held)
                held, n = defaultdict(list), 0
        self._hold(held)
        if first is not None:
            self.handle.registerTimer((first + 1) * self.hold * 1000)
        yield from ()

    def _hold(self, held: dict[int, list[tuple]]) -> None:
        for shelf, new in held.items():
            before = self.waiting.getValue((shelf,))
            self.waiting.updateValue((shelf,), ([*(before[0] if before else ()), pickle.dumps(new)],))

    def _due(self, shelf: int, now: int) -> tuple[list[tuple], int | None]:
        """The shelf's rows that the watermark has passed, taken out of state in
        order, and the first stretch that stays."""
        rows = [r for chunk in self.waiting.getValue((shelf,))[0] for r in pickle.loads(chunk)]
        rest = [r for r in rows if (r[0] + 1) * self.hold > now]
        if rest:
            self.waiting.updateValue((shelf,), ([pickle.dumps(rest)],))
            rows = [r for r in rows if (r[0] + 1) * self.hold <= now]
        else:
            self.waiting.removeKey((shelf,))
        names = [*self.keys, *self.fields]
        place = [1 + names.index(c) for c in self.order]
        rows.sort(key=lambda r: (r[0], *((r[i] is None, r[i]) for i in place)))
        return rows, min(r[0] for r in rest) if rest else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Everything the watermark has passed, not only this timer's stretch: a
        # timer set in the last batch of a run would not be called any more.
        now = timerValues.getCurrentWatermarkInMs() // 1000 // self.hold * self.hold
        states = pickle.loads(self.current.get()[0]) if self.current.exists() else {}
        asks = [(ask, k) for k, (_, ask) in states.items() if ask is not None]
        heapq.heapify(asks)
        Row = namedtuple("Row", [*self.keys, *self.fields])
        width, out, ahead = len(self.keys), [], []
        for shelf in sorted(k[0] for k in self.waiting.keys()):
            if shelf * SHELF >= now:
                ahead.append(shelf * SHELF + self.hold)
                break
            due, stays = self._due(shelf, now)
            if stays is not None:
                ahead.append((stays + 1) * self.hold)
            for stretch, rows in groupby(due, key=itemgetter(0)):
                self._lapse(states, asks, stretch * self.hold, out)
                for r in rows:
                    k = r[1:1 + width]
                    state, ask = states.get(k, (None, None))
                    state, made = self.step(state, Row._make(r[1:]))
                    out += [(*k, *o) for o in made]
                    if state is None:
                        states.pop(k, None)
                        continue
                    if ask is None and self.lapse is not None:  # asked for the first time when the stretch is over
                        ask = (stretch + 1) * self.hold
                        heapq.heappush(asks, (ask, k))
                    states[k] = (state, ask)
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        self._lapse(states, asks, now, out)
        if states:
            self.current.update((pickle.dumps(states),))
        else:
            self.current.clear()
        ahead += [math.ceil(ask / self.hold) * self.hold for ask, _ in asks[:1]]
        if ahead:
            self.handle.registerTimer(min(ahead) * 1000)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def _lapse(self, states: dict, asks: list[tuple], now: float, out: list[tuple]) -> None:
        """Ask for every state whose time has come, up to ``now``."""
        while asks and asks[0][0] <= now:
            ask, k = heapq.heappop(asks)
            if k not in states or states[k][1] != ask:
                continue  # that state is gone or was asked already
            state, made, again = self.lapse(k, states[k][0], float(now))
            out += [(*k, *o) for o in made]
            if state is None:
                del states[k]
                continue
            states[k] = (state, again)
            if again is not None:
                heapq.heappush(asks, (again, k))

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """The Python values of a column; times are naive, in UTC as the session's."""
    if pd.api.types.is_datetime64_any_dtype(column):
        return [None if v is pd.NaT else v.to_pydatetime(warn=False) for v in column]
    return [None if isinstance(v, float) and math.isnan(v) else v for v in column.tolist()]


def ordered_fold(df: DataFrame, keys: Sequence[str], step: Step, out: str, order: Sequence[str] = ("ts", "event_id"), hold_minutes: int = 15, lapse: Lapse | None = None) -> DataFrame:
    """Fold ``step`` over the rows of each key of a stream with event time ``ts``, in order.

    ``out`` lists the output columns, keys first. Rows reach ``step`` as named
    tuples of plain Python values. Needs the RocksDB state store, which is set
    on the session (a query keeps what it began with)."""
    df.sparkSession.conf.set(_PROVIDER, ROCKSDB)
    columns = T._parse_datatype_string(out)
    fields = [c for c in df.columns if c not in keys]
    processor = OrderedFold(step, [f.name for f in columns.fields], keys, fields, order, hold_minutes, lapse)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    return df.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(processor, columns, "append", "eventTime")


def drain(df: DataFrame, name: str, target: tuple[str, str] | None = None) -> DataFrame:
    """Run the stream over everything available and return its table.

    Table and checkpoint live in the shared folder; pass the same ``target``
    again to continue where the last run stopped."""
    spark = df.sparkSession
    path, ckpt = target or (shared_dir(spark, name), shared_dir(spark, f"{name}-ckpt"))
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def watermarked(df: DataFrame, end: DataFrame | None = None) -> DataFrame:
    """The stream with its watermark; with ``end``, joined by the stream of end markers."""
    d = df.withWatermark("ts", LATENESS)
    return d if end is None else d.unionByName(end.withWatermark("ts", "0 seconds"), allowMissingColumns=True)


def end_markers(df: DataFrame) -> tuple[DataFrame, str]:
    """A stream of end markers beside ``df``, and the folder that one is written to."""
    spark = df.sparkSession
    path = shared_dir(spark, "end")
    spark.createDataFrame([], "ts timestamp").write.parquet(path)
    return spark.readStream.schema("ts timestamp").parquet(path), path


def drain_to_end(source: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, until: datetime = END_OF_RUN) -> DataFrame:
    """Run ``job`` over all files of ``source``, then once more with an end
    marker, so that windows and timers up to ``until`` close. Returns the table.

    ``job`` gets the watermarked stream; markers are rows of nulls but for ts.

    The marker's source has a watermark of its own and the later one counts;
    the marker is written after all rows are read, so none becomes late."""
    spark = source.sparkSession
    end, markers = end_markers(source)
    df = job(watermarked(source, end))
    before = spark.conf.get(_POLICY, None)
    spark.conf.set(_POLICY, "max")
    try:
        target = (shared_dir(spark, name), shared_dir(spark, f"{name}-ckpt"))
        drain(df, name, target)
        seconds = until.replace(tzinfo=until.tzinfo or timezone.utc).timestamp()
        spark.range(1).select(F.timestamp_seconds(F.lit(seconds)).alias("ts")).write.mode("append").parquet(markers)
        return drain(df, name, target)
    finally:
        spark.conf.unset(_POLICY) if before is None else spark.conf.set(_POLICY, before)
