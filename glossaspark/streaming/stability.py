"""When a condition has held long enough, as a stream with a deadline."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key {key}, outcome string, run_start long, ended long"
WATCH = "started long, since long, seen long, done boolean"


class _Watch(StatefulProcessor):
    """One watch for each key, all times in microseconds."""

    def __init__(self, least: int, deadline: int | None, live: bool):
        self.least, self.deadline, self.live = least, deadline, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", WATCH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        started, since, seen, done = tuple(self.watch.get()) if self.watch.exists() else (None, None, None, False)
        told = None
        for at, good in sorted((r["at"], r["good"]) for r in rows):
            if done or (seen is not None and at < seen):
                continue
            seen = at
            if started is None:
                started = at
                self.remind(at, timerValues)
            if self.deadline is not None and at > started + self.deadline:
                told = ("deadline", None, started + self.deadline)
            elif not good:
                since = None
            else:
                since = at if since is None else since
                if at - since >= self.least:
                    told = ("stable", since, at)
            done = told is not None
        self.watch.update((started, since, seen, done))
        if told:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield Row(key=key[0], outcome=told[0], run_start=told[1], ended=told[2])

    def remind(self, at: int, clock) -> None:
        if self.deadline is not None:
            now = clock.getCurrentProcessingTimeInMs() if self.live else at // 1000
            self.handle.registerTimer(now + self.deadline // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        started, since, seen, done = tuple(self.watch.get())
        if not done:
            self.watch.update((started, since, seen, True))
            yield Row(key=key[0], outcome="deadline", run_start=None, ended=started + self.deadline)

    def close(self) -> None:
        pass


def session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep typed state, as this one needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def stable(events: DataFrame, key: str, time: str, good: str, least_seconds: float, deadline_seconds: float | None = None, live: bool = False) -> DataFrame:
    """One row for each key whose watch ends: (key, outcome, run_start, ended).

    A watch begins with the first event of a key. ``stable``: the condition was true in all events
    over ``least_seconds`` and more; an event where it is false or null starts anew. ``deadline``: that did
    not happen in time, put out by a timer when no further event comes. Timers follow the watermark
    of ``events`` or, with ``live``, the clock. Events older than the last one of their key are ignored, and so are
    null keys and times and all that comes after the end of a watch. The state is a row for each key; the events of a key in
    one micro-batch are sorted in memory, so bound the trigger.
    """
    kind = events.schema[key].dataType.simpleString()
    ready = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("key"), F.col(time).alias("__time"), F.unix_micros(F.col(time)).alias("at"), F.coalesce(F.col(good), F.lit(False)).alias("good")
    )
    watch = _Watch(int(least_seconds * 1_000_000), None if deadline_seconds is None else int(deadline_seconds * 1_000_000), live)
    found = ready.groupBy("key").transformWithState(watch, OUT.format(key=kind), "append", "ProcessingTime" if live else "EventTime")
    return found.select("key", "outcome", F.timestamp_micros("run_start").alias("run_start"), F.timestamp_micros("ended").alias("ended"))
