"""Runs: fenced sending, progress lines, staged exports, early ends, replacement, single scripts."""

from __future__ import annotations

import re
import subprocess
import sys
import time

import pytest
from oracle import ROOT
from pyspark.sql import functions as F

from glossaspark.operators import digest_tree, matching, sequences
from glossaspark.plans import sending
from glossaspark.sources import compatibility, events, projects
from glossaspark.streaming.progress import ProgressLines

GOOD = '{"id": "r", "choices": [{"message": {"content": "{\\"translations\\": [{\\"segment_id\\": \\"s\\", \\"target_text\\": \\"t\\"}]}"}}]}'

RETRY = """
import os, sys, uuid
from glossaspark.session import session
from glossaspark.plans import sending
folder = sys.argv[1]
spark = session("retry", "local[2,3]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
good = %r
def backend(payload):
    before = len([n for n in os.listdir(folder) if n.startswith(payload)])
    open(f"{folder}/{payload}-{uuid.uuid4().hex}", "x").close()
    if payload == "dies" and not before:
        raise OSError("the task ends after the service took the batch")
    return 200, good
batches = spark.createDataFrame([(x, x, ["s"]) for x in ("dies", "good")], "batch_id string, payload string, segment_ids array<string>").repartition(2, "batch_id")
told = lambda df: sorted((r["batch_id"], r["status"]) for r in df.collect())
print(told(sending.send(batches, folder + "-store", backend, "one")))
print(told(sending.drive(batches, folder + "-store", backend, lambda p: (200, good), "two")))
print(sorted(n.split("-")[0] for n in os.listdir(folder)))
"""


def test_a_task_that_is_tried_again_sends_nothing_again(tmp_path):
    (tmp_path / "calls").mkdir()
    out = subprocess.run([sys.executable, "-c", RETRY % GOOD, str(tmp_path / "calls")], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines()
    first, last, calls = (eval(line) for line in out[-3:])
    assert dict(first)["dies"] == "unknown"
    assert last == [("dies", "succeeded"), ("good", "succeeded")]
    assert calls == ["dies", "good"]


def test_one_of_several_attempts_sends(tmp_path):
    first, second = sending.fence(str(tmp_path)), sending.fence(str(tmp_path))
    assert [first("a"), second("a"), second("b/c"), first("b/c")] == [True, False, True, False]


def test_progress_lines_are_events(spark, tmp_path):
    lines: list[str] = []
    listener = ProgressLines("told", lines.append, total=1)
    spark.streams.addListener(listener)
    try:
        for n in (1, 2):
            spark.range(n).write.parquet(str(tmp_path / "in" / str(n)))
        source = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        for name, column in (("other", F.col("id")), ("told", F.col("id"))):
            query = source().select(column).writeStream.format("parquet").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start(str(tmp_path / f"out-{name}"))
            query.awaitTermination()
        until = time.time() + 30
        while time.time() < until and not any("succeeded" in line for line in lines):
            time.sleep(0.2)
        failing = source().select(F.raise_error(F.lit("a secret")).alias("x")).writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "cp-f")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="a secret"):
            failing.awaitTermination()
        while time.time() < until + 30 and not any("failed" in line for line in lines):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    ended = next(i for i, line in enumerate(lines) if "succeeded" in line)
    rows = events.parsed(spark.createDataFrame([("a" if i <= ended else "b", i, line) for i, line in enumerate(lines)], "run string, line_no long, line string")).orderBy("line_no").collect()
    assert [r["error"] for r in rows] == [None] * len(rows) and "secret" not in "".join(lines)
    assert rows[0]["completed_batches"] == 1 and rows[1]["completed_batches"] is None
    assert [r["type"] for r in rows if r["type"] != "progress"] == ["succeeded", "failed"]
    with pytest.raises(ValueError):
        ProgressLines("x", lines.append, stage="thinking")


def test_only_changed_branches_of_a_snapshot_are_read(spark, tmp_path):
    rows = [(f"game/{i % 40}/{i}.rpy", str(i)) for i in range(400)] + [("top.rpy", None)]
    after = [(p, "x" if p == "game/7/47.rpy" else d) for p, d in rows if p != "game/3/3.rpy"] + [("game/3/new.rpy", "1")]
    frames = [spark.createDataFrame(x, "path string, digest string") for x in (rows, after, rows[::-1], [])]
    places = [str(tmp_path / n) for n in ("before", "after", "same", "empty")]
    for frame, place in zip(frames, places):
        digest_tree.store(frame, place, branches=16)
    told = lambda df: sorted(map(tuple, df.collect()))
    found = digest_tree.changes(spark, places[0], places[1])
    assert told(found) == told(matching.changed(frames[0], frames[1], "path", "digest")) == [("game/3/3.rpy", "removed"), ("game/3/new.rpy", "added"), ("game/7/47.rpy", "changed")]
    assert 1 <= len(digest_tree.changed_branches(spark, places[0], places[1])) <= 2
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert len(re.findall(r"PartitionFilters: \[[^\]]*branch#\d+ (?:IN|INSET|=)", plan)) == 2
    assert digest_tree.changed_branches(spark, places[0], places[2]) == [] and told(digest_tree.changes(spark, places[0], places[2])) == []
    assert len(told(digest_tree.changes(spark, places[0], places[3]))) == 400  # a null digest is no file to compare
    digest_tree.store(frames[0], str(tmp_path / "other"), branches=8)
    with pytest.raises(ValueError, match="different numbers"):
        digest_tree.changes(spark, places[0], str(tmp_path / "other"))
    with pytest.raises(Exception, match="without a path"):
        digest_tree.store(spark.createDataFrame([(None, "1")], "path string, digest string"), str(tmp_path / "null"))


def test_a_limit_ends_the_scan_early(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = spark.range(0, 100_000, 1, 100).mapInPandas(counted, "id long")
    assert sequences.exceeds(rows, 10) and read.value <= 5_000
    assert not sequences.exceeds(spark.range(10), 10) and sequences.exceeds(spark.range(11), 10) and not sequences.exceeds(spark.range(0), 0)


def test_replacement_needs_its_row(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, s string")
    new = spark.createDataFrame([("b", None, "y")], "k string, n int, s string")
    assert sorted(map(tuple, matching.replaced(rows, new, "k").collect())) == [("a", 1, "x"), ("b", None, "y")]
    with pytest.raises(Exception, match="nothing to update: c"):
        matching.replaced(rows, new.withColumn("k", F.lit("c")), "k").collect()
    with pytest.raises(Exception, match="updated twice: b"):
        matching.replaced(rows, new.union(new), "k").collect()


def test_a_single_script_and_none(spark, tmp_path):
    (tmp_path / "game" / "cache").mkdir(parents=True)
    with pytest.raises(ValueError, match="no scripts"):
        projects.scripts(spark, str(tmp_path))
    (tmp_path / "game" / "a.RPY").write_text("label a:\n")
    (tmp_path / "game" / "b.txt").write_text("label b:\n")
    assert [r["path"] for r in projects.scripts(spark, str(tmp_path)).collect()] == ["game/a.RPY"]
    assert [r["path"] for r in projects.scripts(spark, str(tmp_path / "game" / "a.RPY")).collect()] == ["a.RPY"]
    assert [r["path"] for r in projects.scripts(spark, str(tmp_path / "game" / "b.txt")).collect()] == ["b.txt"]


def test_each_status_has_its_sentence(spark):
    found = spark.createDataFrame([(s,) for s in ("source_ready", "packaged_requires_import", "uncertain", "not_renpy", "?")], "s string")
    told = [r[0] for r in found.select(compatibility.summary(F.col("s"))).collect()]
    assert len(set(told)) == 5 and told[-1] is None and told[0].endswith("可以继续。")
