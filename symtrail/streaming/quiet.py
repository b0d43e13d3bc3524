"""Quiet periods as keyed state: every event arms its key's timer again, and silence flushes what is pending.

The state of a key is one value: its open bursts, with the last write and the number of writes of each slot (a
path), and when the first of them is due, for which the key has its timer.  Contents stay out of the state; a flush names the write that counts.  Time is that of the events, with
a watermark for late ones, or that of their arrival.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STATE = "due bigint, bursts array<struct<start:bigint,end:bigint,slots:array<struct<slot:string,at:bigint,ord:bigint,writes:bigint>>>>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Span:
    """A burst: first and last event in microseconds, and (order, writes) of each slot."""

    start: int
    end: int
    slots: dict[str, list] = field(default_factory=dict)

    def add(self, slot: str, order: tuple, writes: int) -> None:
        held = self.slots.get(slot)
        if held is None:
            self.slots[slot] = [order, writes]
        else:
            held[0], held[1] = max(held[0], order), held[1] + writes


class Spans:
    """Bursts of one key in order; an event joins all that it is at most the gap away from."""

    def __init__(self, stored: list[Span], gap: int):
        self.gap = gap
        self.spans = sorted(stored, key=lambda s: s.start)
        self.ends = [s.end for s in self.spans]

    def add(self, at: int, slot: str, order: tuple) -> None:
        first = bisect_left(self.ends, at - self.gap)
        last = first
        while last < len(self.spans) and self.spans[last].start <= at + self.gap:
            last += 1
        near = self.spans[first:last]
        if not near:
            one = Span(at, at)
        else:
            one = near[0]
            one.start, one.end = min(one.start, at), max(near[-1].end, one.end, at)
            for other in near[1:]:
                for name, (o, n) in other.slots.items():
                    one.add(name, o, n)
        one.add(slot, order, 1)
        self.spans[first:last] = [one]
        self.ends[first:last] = [one.end]


class QuietPeriods(StatefulProcessor):
    """Rows (keys, slot, at, order) to flushes (keys, flush_start, slot, writes, order)."""

    def __init__(self, keys: list[str], gap_us: int, arrival: bool):
        self.keys, self.gap, self.arrival = keys, gap_us, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getValueState("bursts", STATE)

    def _due(self, end: int) -> int:
        """Milliseconds at which a burst is over: an event exactly the gap later still belongs to it."""
        return (end + self.gap) // 1000 + 1

    def _held(self) -> tuple[int | None, list[Span]]:
        """When the key's timer is due, and its open bursts."""
        value = self.bursts.get()
        if value is None:
            return None, []
        return value[0], [Span(b[0], b[1], {x[0]: [(x[1], x[2]), x[3]] for x in b[2]}) for b in value[1]]

    def _keep(self, was: int | None, spans: list[Span]) -> None:
        """Open bursts as one value, read and written once a batch; one timer stands for the first that is due."""
        due = min((self._due(s.end) for s in spans), default=None)
        if was is not None and was != due:
            self.handle.deleteTimer(was)
        if due is None:
            self.bursts.clear()
            return
        if was != due:
            self.handle.registerTimer(due)
        self.bursts.update((due, [(s.start, s.end, [(name, *order, n) for name, (order, n) in sorted(s.slots.items())]) for s in spans]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        due, held = self._held()
        spans = Spans(held, self.gap)
        for r in rows:
            spans.add(now if self.arrival else r["at"], r["slot"], (r["at"], r["ord"]))
        self._keep(due, spans.spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        told = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentProcessingTimeInMs() if self.arrival else timerValues.getCurrentWatermarkInMs()
        due, held = self._held()
        over = [s for s in held if self._due(s.end) <= told or self._due(s.end) < now]
        self._keep(None if due == told else due, [s for s in held if not (self._due(s.end) <= told or self._due(s.end) < now)])
        for span in over:
            for slot, ((_, order), writes) in sorted(span.slots.items()):
                yield Row(**dict(zip(self.keys, key)), start=span.start, slot=slot, writes=writes, ord=order)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def flushes(events: DataFrame, keys: list[str], slot: Column, ts: str, order: str, gap_seconds: float, late: str | None = None) -> DataFrame:
    """(keys, flush_start, slot, writes, order) of a stream, when `gap_seconds` have passed in silence for the keys.

    With `late` time is that of `ts` and a burst closes when the watermark is past it: it holds what events in
    any order within `late` would give.  Without, time is that of arrival and `flush_start` that of the first
    arrival.  The last write of a slot has the greatest (`ts`, `order`).  Events with a null key are a key of
    their own; events with a null time or slot are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.filter(F.col(ts).isNotNull() & slot.isNotNull())
    zoned = F.col(ts).cast("timestamp")
    rows = rows.select(*keys, zoned.alias("ts"), F.unix_micros(zoned).alias("at"), slot.cast("string").alias("slot"), F.col(order).cast("long").alias("ord"))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    shape = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start bigint, slot string, writes bigint, ord bigint"
    out = rows.groupBy(*keys).transformWithState(
        QuietPeriods(keys, round(gap_seconds * 1e6), late is None), shape, "append", "ProcessingTime" if late is None else "EventTime")
    return out.select(*keys, F.timestamp_micros("start").alias("flush_start"), "slot", "writes", F.col("ord").alias(order))


def armed(spark: SparkSession, checkpoint: str, keys: list[str], order: str) -> DataFrame:
    """What a stopped stream of `flushes` has pending, as it would be flushed: read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "bursts").load(checkpoint)
    bursts = state.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.explode("value.bursts").alias("b"))
    slots = bursts.select(*keys, F.timestamp_micros("b.start").alias("flush_start"), F.explode("b.slots").alias("s"))
    return slots.select(*keys, "flush_start", "s.slot", "s.writes", F.col("s.ord").alias(order))


def run_once(spark: SparkSession, events: DataFrame, base: str, keys: list[str], slot: Column, ts: str, order: str, gap_seconds: float, late: str) -> DataFrame:
    """All flushes of a stream that ends: those it told, and what was still armed."""
    out = flushes(events, keys, slot, ts, order, gap_seconds, late)
    with rocksdb(spark):
        stream = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").unionByName(armed(spark, f"{base}/checkpoint", keys, order))
