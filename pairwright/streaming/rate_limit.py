"""Trailing-window rate limit.

An event is allowed when fewer than ``limit`` *allowed* events of its key lie in
the window before it.  Denied events use no quota, so this is sequential per
key: the state is the times of the last allowed events, never more than
``limit`` of them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import lexicon as lx

OUT = "event_id bigint, key bigint, at bigint, allowed boolean, retry_after int"
_MICROS = 1_000_000


def _events(events: DataFrame, key: str, at: str, event_id: str) -> DataFrame:
    """Events with their time in microseconds; the limiter needs nothing else."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return events.select(
        F.col(event_id).cast("bigint").alias("event_id"),
        F.col(key).cast("bigint").alias("key"),
        micros.alias("at"),
    )


class Quota:
    """The last ``limit`` grants of a key; only the oldest of them can stand in the way of the next."""

    def __init__(self, limit: int, window: int, grants: Iterable[int] = ()) -> None:
        self.window, self.grants = window, deque(grants, maxlen=limit)

    def ask(self, at: int) -> tuple[bool, int]:
        """Whether an event at ``at`` is allowed, else the seconds after which one may be."""
        full = len(self.grants) == self.grants.maxlen
        free = self.grants[0] + self.window if full else at
        if at < free:
            return False, (free - at) // _MICROS + 1
        self.grants.append(at)
        return True, 0


def busy_periods(events: DataFrame, window_seconds: int) -> DataFrame:
    """Add ``period``: runs of a key's events without a pause of a whole window.

    A pause of one window empties the log, so periods are independent and a hot
    key is spread over as many tasks as it has pauses.  Pauses are found on one
    row per key and window-sized slot, not on the events.
    """
    window = window_seconds * _MICROS
    slotted = events.withColumn("_slot", F.floor(F.col("at") / window))
    slots = slotted.groupBy("key", "_slot").agg(
        F.min("at").alias("_first"), F.max("at").alias("_last")
    )
    by_key = Window.partitionBy("key").orderBy("_slot")
    paused = F.col("_first") - F.lag("_last").over(by_key) >= window
    numbered = slots.withColumn(
        "_new", F.coalesce(paused, F.lit(True)).cast("int")
    ).withColumn("period", F.sum("_new").over(by_key))
    found = numbered.select(F.col("key").alias("_key"), F.col("_slot").alias("_at"), "period")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at"))
    return slotted.join(found, same).drop("_key", "_slot", "_at")


def rate_limit_flags(
    events: DataFrame, key: str, at: str, event_id: str, limit: int = lx.RATE_LIMIT,
    window_seconds: int = lx.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """Decide every event of a bounded table, ordered by time and id within its key.

    Events stream through sorted partitions in Arrow batches; a task holds one
    batch and one log, never a whole key. A null key is a key; events without time are
    left out. A key that never pauses for a window is read by one task, in order.
    """
    window = window_seconds * _MICROS

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, quota = None, Quota(limit, window)
        for batch in batches:
            allowed, retry = [], []
            rows = zip(batch["key"].tolist(), batch["period"].tolist(), batch["at"].tolist())
            for k, period, moment in rows:
                k = None if k != k else k  # pandas reads a null as nan
                if (k, period) != current:
                    current, quota = (k, period), Quota(limit, window)
                ok, wait = quota.ask(moment)
                allowed.append(ok)
                retry.append(wait)
            yield batch[["event_id", "key", "at"]].assign(allowed=allowed, retry_after=retry)

    split = busy_periods(_events(events, key, at, event_id).where("at is not null"), window_seconds)
    return (
        split.repartition("key", "period")
        .sortWithinPartitions("key", "period", "at", "event_id")
        .mapInPandas(decide, OUT)
    )


class _Limiter(StatefulProcessor):
    """Events of a key wait in slots of time until the watermark has passed their slot.

    State are the last grants and, for each slot, its waiting events. One timer per key
    wakes at the end of its first waiting slot; then the slots that have ended are read and
    decided one by one, so a task holds one slot of one key. A key without waiting events
    wakes once more when its grants no longer count, and leaves no state.
    """

    def __init__(self, limit: int, window: int, slot: int) -> None:
        self.limit, self.window, self.slot = limit, window, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grants = handle.getValueState("grants", "times array<bigint>")
        self.waiting = handle.getMapState("waiting", "slot bigint", "times array<bigint>, ids array<bigint>")

    def _wake(self, slots: Iterable[int], grants: Iterable[int] = ()) -> None:
        """Keep one timer, at the end of the first slot or else of the last grant's window."""
        ends = [(min(slots) + 1) * self.slot] if slots else [max(grants) + self.window] if grants else []
        at = -(-ends[0] // 1000) if ends else None
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != at:
                self.handle.deleteTimer(timer)
        if at is not None and at not in timers:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for slot, part in batch.groupby(batch["at"] // self.slot):
                held = self.waiting.getValue((int(slot),)) if self.waiting.containsKey((int(slot),)) else ([], [])
                self.waiting.updateValue(
                    (int(slot),), ([*held[0], *part["at"].tolist()], [*held[1], *part["event_id"].tolist()])
                )
        self._wake([slot for (slot,) in self.waiting.keys()])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = sorted(slot for (slot,) in self.waiting.keys())
        due = bisect_right(slots, passed // self.slot - 1)
        quota = Quota(self.limit, self.window, self.grants.get()[0] if self.grants.exists() else ())
        for slot in slots[:due]:
            times, ids = self.waiting.getValue((slot,))
            rows = sorted(zip(times, ids))
            decided = [quota.ask(moment) for moment, _ in rows]
            self.waiting.removeKey((slot,))
            yield pd.DataFrame(
                {
                    "event_id": [i for _, i in rows], "key": key[0], "at": [m for m, _ in rows],
                    "allowed": [ok for ok, _ in decided], "retry_after": [wait for _, wait in decided],
                }
            )
        if due == len(slots) and (not quota.grants or quota.grants[-1] + self.window <= passed):
            self.grants.clear()
            return
        self.grants.update((list(quota.grants),))
        self._wake(slots[due:], quota.grants)

    def close(self) -> None:
        pass


#: Where an ended stream puts its watermark: events must lie before it (nanoseconds end soon after).
_END = "2262-01-01"
CLOSING_SCHEMA = "event_id bigint, key bigint, at bigint"


def rate_limit_stream(
    events: DataFrame, key: str, at: str, event_id: str, limit: int = lx.RATE_LIMIT,
    window_seconds: int = lx.RATE_WINDOW_SECONDS, lateness: str = "10 minutes",
    slot_seconds: int | None = None, closing: DataFrame | None = None,
) -> DataFrame:
    """The same decision on a stream, whatever the order of arrival within ``lateness``.

    Events are decided behind the watermark, in order of time and id, one slot of
    ``slot_seconds`` (by default the window) at a time; shorter slots bound what a hot key
    keeps in memory. Events later than ``lateness`` are dropped, as by any watermark. A
    null key is a key; events without time are left out.

    The newest events wait for the watermark. ``closing`` is a stream of
    ``CLOSING_SCHEMA``; a row of :func:`closing_row` in it ends the input and decides what
    still waits. The state store has to be RocksDB (:data:`STATE_STORE`).
    """
    timed = _events(events, key, at, event_id).where("at is not null")
    if closing is not None:
        timed = timed.union(closing)
    slot = (window_seconds if slot_seconds is None else slot_seconds) * _MICROS
    return (
        timed.withColumn("moment", F.timestamp_micros("at")).withWatermark("moment", lateness).groupBy("key")
        .transformWithStateInPandas(_Limiter(limit, window_seconds * _MICROS, slot), OUT, "Append", "EventTime")
        .where(F.col("at") < F.unix_micros(F.lit(_END).cast("timestamp")))
    )


#: Settings a session needs for :func:`rate_limit_stream`.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def closing_row(spark: SparkSession) -> DataFrame:
    """The row that ends a stream; its time moves the watermark past every event."""
    return spark.range(1).select(
        F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("key"),
        F.unix_micros(F.lit(_END).cast("timestamp")).alias("at"),
    )


def limit_to_the_end(
    events: DataFrame, target: str, scratch: str, key: str, at: str, event_id: str, **options
) -> DataFrame:
    """Run a stream over all input there is, close it, and read its decisions from ``target``.

    ``scratch`` is a shared folder of this run's own, for the checkpoint and the closing row. After
    it the stream has ended: events that come later are late.
    """
    spark = events.sparkSession
    spark.createDataFrame([], CLOSING_SCHEMA).write.parquet(f"{scratch}/closing")
    before = {name: spark.conf.get(name) for name in STATE_STORE}
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        for last in (False, True):
            if last:
                closing_row(spark).write.mode("append").parquet(f"{scratch}/closing")
            closing = spark.readStream.schema(CLOSING_SCHEMA).parquet(f"{scratch}/closing")
            flags = rate_limit_stream(events, key, at, event_id, closing=closing, **options)
            (
                flags.writeStream.format("parquet").option("path", target)
                .option("checkpointLocation", f"{scratch}/state").trigger(availableNow=True).start()
            ).awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(OUT).parquet(target)


def trailing_counts(
    events: DataFrame, key: str, at: str, event_id: str, window_seconds: int = lx.RATE_WINDOW_SECONDS
) -> DataFrame:
    """Events of the key in the window before each event, denied ones included.

    Each event falls in one slot and is counted against its own and the previous
    slot only, so no task orders a whole key.
    """
    window = window_seconds * _MICROS
    base = _events(events, key, at, event_id).withColumn("_slot", F.floor(F.col("at") / window))
    both = base.select(
        "*",
        F.explode(F.array(F.col("_slot"), F.col("_slot") + 1)).alias("_seen_in"),
    )
    span = (
        Window.partitionBy("key", "_seen_in").orderBy("at").rangeBetween(-(window - 1), -1)
    )
    counted = both.withColumn("previous", F.count(F.lit(1)).over(span))
    return counted.where(F.col("_seen_in") == F.col("_slot")).select(
        "event_id", "key", "at", "previous"
    )
