"""Stability with a deadline: by events, by the watermark, and by the clock."""

from __future__ import annotations

import time

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from glossaspark.operators import sequences
from glossaspark.streaming import stability

#: The watermark begins at 1970, where an event would be late.
START = 1e6
SCHEMA = "k string, ts timestamp, good boolean"


@pytest.fixture
def stream(spark, tmp_path):
    own = stability.session(spark)

    def put(name, *rows):
        df = own.createDataFrame([(k, s + START, g) for k, s, g in rows], "k string, s double, good boolean")
        df.select("k", F.timestamp_seconds("s").alias("ts"), "good").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run(live=False, trigger=None, seconds=0):
        events = own.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found = stability.stable(events if live else events.withWatermark("ts", "0 seconds"), "k", "ts", "good", 10, 3 if live else 60, live)
        query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(**(trigger or {"availableNow": True})).start(str(tmp_path / "out"))
        if seconds:
            until = time.time() + 60
            while time.time() < until and not rows():
                time.sleep(seconds)
            query.stop()
        query.awaitTermination()
        return rows()

    def rows():
        try:
            found = own.read.parquet(str(tmp_path / "out")).select("key", "outcome", F.unix_micros("run_start") / 1e6 - START, F.unix_micros("ended") / 1e6 - START)
            return sorted(map(tuple, found.collect()))
        except Exception as error:
            if "infer schema" in str(error) or "PATH_NOT_FOUND" in str(error):
                return []
            raise

    return put, run


def test_a_gap_starts_anew_and_restarts_repeat_nothing(stream):
    put, run = stream
    put("1", ("a", 0.0, True), ("a", 6.0, True), ("b", 0.0, True), ("b", 5.0, False), ("b", 9.0, True), ("b", 12.0, None), (None, 1.0, True))
    assert run() == []
    put("2", ("a", 12.5, True), ("b", 13.0, True), ("b", 20.0, True))
    assert run() == [("a", "stable", 0.0, 12.5)]
    put("3", ("a", 40.0, True), ("b", 14.0, False), ("b", 23.0, True))  # b's second comes too late to count
    assert run() == [("a", "stable", 0.0, 12.5), ("b", "stable", 13.0, 23.0)]
    assert run() == [("a", "stable", 0.0, 12.5), ("b", "stable", 13.0, 23.0)]


def test_deadline_without_a_further_event(stream):
    put, run = stream
    put("1", ("a", 0.0, False), ("c", 1.0, True))
    assert run() == []
    put("2", ("b", 100.0, True))  # another key moves the watermark
    assert run() == [("a", "deadline", None, 60.0), ("c", "deadline", None, 61.0)]
    put("3", ("a", 101.0, True), ("a", 120.0, True))  # after the end of its watch
    assert len(run()) == 2


def test_the_deadline_counts_before_a_later_event(stream):
    put, run = stream
    put("1", ("a", 0.0, False), ("a", 55.0, True), ("a", 70.0, True))
    assert run() == [("a", "deadline", None, 60.0)]


def test_deadline_by_the_clock(stream):
    put, run = stream
    put("1", ("a", 0.0, True))
    assert run(live=True, trigger={"processingTime": "1 second"}, seconds=1) == [("a", "deadline", None, 3.0)]


def test_equal_to_the_batch_runs(spark):
    """Without a deadline: the first long run of each user."""
    from glossaspark.queries import QUERIES

    events = spark.read.parquet(f"{DATA}/events.parquet")
    runs = sequences.stable_runs(events, "user_id", ["ts", "event_id"], "ts", F.col("event_type").isin("view", "click", "signup"), 172_800)
    first = {r["user_id"]: r["s"] for r in runs.groupBy("user_id").agg(F.min(F.unix_micros(F.col("run_start").cast("timestamp"))).alias("s")).collect()}
    found = [r for r in QUERIES["stability_stream"](spark, DATA).collect() if r["outcome"] == "stable"]
    assert all(first[r["user_id"]] == r["run_start"] for r in found)
