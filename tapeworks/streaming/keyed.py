"""Keyed state that ends: alert life cycles with commands, running totals, pattern watches and uniform samples.

Each operator is a ``StatefulProcessor`` under ``transformWithState``: map, list and value state in RocksDB, event-time timers
that clear what is closed or idle, and several input streams where commands steer the state. Within a micro-batch a key's rows
are taken in event-time order, and what a timer would have done between two rows is done before the second, so results do not
depend on how the rows are split into batches. Rows older than the watermark are dropped by Spark.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapeworks.session import ensure_checkpoint_dir

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed operators need the RocksDB state store; a session that names another one keeps it for its other queries only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def replay(df: DataFrame, order: str, batches: int, columns: list[str] | None = None) -> DataFrame:
    """A stream over a batch table that hands it out in ``batches`` micro-batches by ranges of the order column.

    The parts are written one after the other to the shared checkpoint folder, in the order in which the stream reads them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/replay-{uuid4().hex}"
    low, high = df.agg(F.min(order), F.max(order)).first()
    df = df.select(*columns) if columns else df
    for i in range(batches):
        a, b = (low + (high - low) * k / batches for k in (i, i + 1)) if low is not None else (None, None)
        part = df.where((F.col(order) >= F.lit(a)) & ((F.col(order) < F.lit(b)) | F.lit(i == batches - 1))) if low is not None else df
        part.coalesce(1).write.mode("append").parquet(folder)
        if low is None:
            break
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def micros(ts) -> int:
    """Microseconds of a naive UTC or aware timestamp."""
    return round(ts.timestamp() * 1_000_000)


# -- alerts -------------------------------------------------------------------------------

LEVELS = ("none", "warning", "critical")


class AlertLifecycle(StatefulProcessor):
    """Open alerts of a source, one for each metric, in map state; a timer at the earliest end of a quiet time.

    A breach opens an alert or, at a higher severity, escalates it, which takes an acknowledgement back. The commands ``ack`` and
    ``resolve`` act on an open alert and are void otherwise. An alert without a breach for ``quiet`` microseconds expires. A closed
    alert leaves nothing in the state, and a source without open alerts has no state and no timer.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "metric string", "level int, acked boolean, opened long, last long, value double")

    def _event(self, key, metric, ts, event, level, value) -> Row:
        return Row(source=key[0], metric=metric, ts_us=ts, event=event, severity=LEVELS[level], value=float(value))

    def _load(self) -> None:
        """The source's open alerts, read once a call; each access of the state store is a round trip."""
        self.now = {m: tuple(v) for (m,), v in self.open.iterator()}
        self.was = dict(self.now)

    def _store(self) -> None:
        """Alerts that changed go back, and the timer moves if the earliest end of a quiet time did."""
        for m in self.was.keys() - self.now.keys():
            self.open.removeKey((m,))
        for m, a in self.now.items():
            if self.was.get(m) != a:
                self.open.updateValue((m,), a)
        before, last = (min((a[3] for a in x.values()), default=None) for x in (self.was, self.now))
        if before != last:
            for t in list(self.handle.listTimers()) if before is not None else []:
                self.handle.deleteTimer(t)
            if last is not None:
                self.handle.registerTimer((last + self.quiet) // 1000 + 1)

    def _expire(self, key, metric, now: int) -> Iterator[Row]:
        a = self.now.get(metric)
        if a is not None and a[3] + self.quiet < now:
            del self.now[metric]
            yield self._event(key, metric, a[3] + self.quiet, "expired", a[0], a[4])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        for r in sorted(rows, key=lambda r: (r.ts_us, r.tie)):
            yield from self._expire(key, r.metric, r.ts_us)
            a = self.now.get(r.metric)
            if r.command is None:
                level = (r.value > r.limit) + (r.value > r.critical) if r.value is not None else 0
                if not level:
                    continue
                if a is None:
                    self.now[r.metric] = (level, False, r.ts_us, r.ts_us, r.value)
                    yield self._event(key, r.metric, r.ts_us, "opened", level, r.value)
                else:
                    self.now[r.metric] = (max(level, a[0]), a[1] and level <= a[0], a[2], r.ts_us, r.value)
                    if level > a[0]:
                        yield self._event(key, r.metric, r.ts_us, "escalated", level, r.value)
            elif a is not None and r.command == "ack" and not a[1]:
                self.now[r.metric] = (a[0], True, a[2], a[3], a[4])
                yield self._event(key, r.metric, r.ts_us, "acknowledged", a[0], a[4])
            elif a is not None and r.command == "resolve":
                del self.now[r.metric]
                yield self._event(key, r.metric, r.ts_us, "resolved", a[0], a[4])
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        fired = timerValues.getCurrentWatermarkInMs() * 1000
        for metric in list(self.now):
            yield from self._expire(key, metric, fired)
        self._store()

    def close(self) -> None:
        pass


def alert_lifecycle(samples: DataFrame, commands: DataFrame, late: str, quiet_seconds: int) -> DataFrame:
    """Alert events from samples (source, metric, ts, tie, value, limit, critical) steered by commands (source, metric, ts, tie, command).

    One row per opened, escalated, acknowledged, resolved or expired alert, in append mode; feed it to ``flows.upsert_batches`` for
    notifications. Both streams share the state of a source, and the watermark is the earlier of the two.
    """
    with_state_store(samples.sparkSession)
    us = F.unix_micros("ts").alias("ts_us")
    a = samples.withWatermark("ts", late).select("source", "metric", "ts", us, "tie", F.col("value").cast("double").alias("value"), F.col("limit").cast("double").alias("limit"), F.col("critical").cast("double").alias("critical"), F.lit(None).cast("string").alias("command"))
    n = F.lit(None).cast("double")
    b = commands.withWatermark("ts", late).select("source", "metric", "ts", us, "tie", n.alias("value"), n.alias("limit"), n.alias("critical"), "command")
    kind = samples.schema["source"].dataType.simpleString()
    out = a.unionByName(b).groupBy("source").transformWithState(
        AlertLifecycle(quiet_seconds * 1_000_000), f"source {kind}, metric string, ts_us long, event string, severity string, value double", "Append", "EventTime")
    return out.select("source", "metric", F.timestamp_micros("ts_us").alias("ts"), "event", "severity", "value")


# -- running totals and watched patterns over closed bars ---------------------------------

class RunningDelta(StatefulProcessor):
    """Cumulative delta with its extremes; the state of a symbol without bars for ``idle`` milliseconds is cleared by a timer."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "total double, high double, low double, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, high, low, last = self.total.get() if self.total.exists() else (0.0, None, None, None)
        for r in sorted(rows, key=lambda r: r.ts_us):
            if last is not None and r.ts_us - last > self.idle * 1000:
                total, high, low = 0.0, None, None
            total += r.delta
            high, low, last, end = total if high is None else max(high, total), total if low is None else min(low, total), r.ts_us, r.end_us
            yield Row(symbol=key[0], ts_us=r.ts_us, cum_delta=total, session_high=high, session_low=low)
        self.total.update((total, high, low, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(end // 1000 + self.idle + 1)  # a bar that goes on with the session has closed by then

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.total.clear()
        yield from ()

    def close(self) -> None:
        pass


def running_delta(bars: DataFrame, idle_seconds: int) -> DataFrame:
    """symbol, ts, cum_delta, session_high and session_low over a stream of closed bars (symbol, ts, ts_end, delta), in the same query that makes the bars.

    A session ends when a symbol has no bar for ``idle_seconds``; the next bar starts from nothing.
    """
    with_state_store(bars.sparkSession)
    kind = bars.schema["symbol"].dataType.simpleString()
    out = bars.withColumn("ts_us", F.unix_micros("ts")).withColumn("end_us", F.unix_micros("ts_end")).groupBy("symbol").transformWithState(
        RunningDelta(idle_seconds * 1000), f"symbol {kind}, ts_us long, cum_delta double, session_high double, session_low double", "Append", "EventTime")
    return out.select("symbol", F.timestamp_micros("ts_us").alias("ts"), "cum_delta", "session_high", "session_low")


class PatternWatch(StatefulProcessor):
    """A watched pattern's way from waiting to entered to target or stop; a timer at its expiry reports it stale and clears it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, expires long")

    def _out(self, key, ts, event) -> Row:
        return Row(symbol=key[0], pattern_id=key[1], ts_us=ts, event=event)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, expires = self.status.get() if self.status.exists() else ("waiting", None)
        for r in sorted(rows, key=lambda r: r.ts_us):
            if status in ("target", "stop", "stale"):
                break
            up, expires = r.direction == "bullish", r.expires_us
            if status == "waiting":
                if r.ts_us > expires:
                    status = "stale"
                    yield self._out(key, expires, status)
                elif r.low <= r.entry <= r.high:
                    status = "entered"
                    yield self._out(key, r.ts_us, status)
            elif (r.low <= r.stop) if up else (r.high >= r.stop):
                status = "stop"
                yield self._out(key, r.ts_us, status)
            elif (r.high >= r.target) if up else (r.low <= r.target):
                status = "target"
                yield self._out(key, r.ts_us, status)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.status.update((status, expires))
        if status == "waiting":
            self.handle.registerTimer(expires // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.status.exists():
            status, expires = self.status.get()
            if status == "waiting":
                self.status.update(("stale", expires))
                yield self._out(key, expires, "stale")

    def close(self) -> None:
        pass


def pattern_watch(bars: DataFrame, patterns: DataFrame) -> DataFrame:
    """symbol, pattern_id, ts and event of watched patterns (symbol, pattern_id, direction, entry, target, stop, expires) against closed bars.

    One query from ticks to events. A pattern that nobody entered by its expiry is stale at that time, also when no bar follows; a
    settled pattern keeps a word of state, so that later bars don't open it again.
    """
    with_state_store(bars.sparkSession)
    kind = bars.schema["symbol"].dataType.simpleString()
    j = bars.join(patterns, "symbol").withColumn("ts_us", F.unix_micros("ts")).withColumn("expires_us", F.unix_micros("expires"))
    out = j.groupBy("symbol", "pattern_id").transformWithState(PatternWatch(), f"symbol {kind}, pattern_id long, ts_us long, event string", "Append", "EventTime")
    return out.select("symbol", "pattern_id", F.timestamp_micros("ts_us").alias("ts"), "event")


# -- uniform samples ----------------------------------------------------------------------

class BottomK(StatefulProcessor):
    """The k rows of a key with the smallest draws, in list state; what enters and what leaves is reported."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sample = handle.getListState("sample", "draw long, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {tuple(x) for x in self.sample.get()} if self.sample.exists() else set()
        now = set(heapq.nsmallest(self.k, before | {(r.draw, r.id) for r in rows}))
        self.sample.put(sorted(now))
        for change, some in ((1, now - before), (-1, before - now)):
            for draw, i in sorted(some):
                yield Row(stratum=key[0], draw=draw, id=i, change=change)

    def close(self) -> None:
        pass


def sample_changes(s: DataFrame, stratum: str, row_id: str, k: int, seed: int = 11, lanes: int = 16) -> DataFrame:
    """stratum, draw, id and change (1 in, -1 out) of a uniform sample of k rows of each stratum.

    A row's draw is a hash of its id, so the sample is the k smallest draws of all rows so far, whatever the batches, repeats and
    restarts. A stratum is spread over ``lanes`` keys that keep k rows each, so a hot one is not one task; ``sample_of`` merges.
    """
    with_state_store(s.sparkSession)
    kind = s.schema[stratum].dataType.simpleString()
    d = s.select(F.col(stratum).alias("stratum"), F.pmod(F.xxhash64(F.lit(seed + 1), row_id), F.lit(lanes)).alias("lane"), F.xxhash64(F.lit(seed), row_id).alias("draw"), F.col(row_id).cast("long").alias("id"))
    return d.groupBy("stratum", "lane").transformWithState(BottomK(k), f"stratum {kind}, draw long, id long, change int", "Append", "None")


def sample_of(changes: DataFrame, k: int) -> DataFrame:
    """stratum and id of the sample after the changes read so far."""
    from pyspark.sql import Window

    live = changes.groupBy("stratum", "draw", "id").agg(F.sum("change").alias("n")).where("n > 0")
    w = Window.partitionBy("stratum").orderBy("draw", "id")
    return live.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("stratum", "id", "draw")
