"""Event lines as a stream: ranges of bytes, restarts, ends of runs."""

from __future__ import annotations

import random

import pytest
from pyarrow import fs as arrow_fs

from glossaspark.sources import events
from glossaspark.streaming import event_lines

GOOD = '{"schema_version":2,"type":"progress","stage":"translating","message":"m","completed_batches":0,"total_batches":3}'
END = '{"schema_version":2,"type":"succeeded"}'


@pytest.mark.parametrize("most", [3, 8, 1000])
def test_ranges_of_bytes_give_each_line_once(tmp_path, monkeypatch, most):
    rng = random.Random(most)
    for trial in range(30):
        monkeypatch.setattr(event_lines, "BLOCK", rng.randrange(1, 12))
        data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.randrange(60)))
        (tmp_path / "f").write_bytes(data)
        wanted, at = [], 0
        for part in data.split(b"\n")[:-1]:
            at += len(part) + 1
            wanted.append((at, None, True) if len(part) + 1 > most else (at, part.rstrip(b"\r").decode(), False))
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
        store = arrow_fs.LocalFileSystem()
        found = [r for a, b in zip(cuts, cuts[1:]) for r in event_lines.lines_ending(store, str(tmp_path / "f"), a, b, most)]
        assert found == wanted


def test_a_restart_repeats_nothing_and_an_end_is_kept(spark, tmp_path):
    folder, out = tmp_path / "runs", tmp_path / "out"
    folder.mkdir()

    def add(name, text):
        with open(folder / f"{name}.jsonl", "a", newline="") as file:
            file.write(text)

    def run():
        query = event_lines.stream(spark, str(folder), split_bytes=100, bytes_per_trigger=1 << 20).writeStream
        query.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out)).awaitTermination()
        rows = spark.read.parquet(str(out)).orderBy("run", "at").collect()
        return [(r["run"][0], r["type"], r["error"]) for r in rows]

    add("a", GOOD + "\r\n" + GOOD[:20])
    add("b", "[1]\n" + END + "\n")
    first = [("a", "progress", None), ("b", None, "no_object"), ("b", "succeeded", None)]
    assert run() == first
    assert run() == first
    add("a", GOOD[20:] + "\n" + "x" * (events.MOST_BYTES + 5) + "\n" + END + "\n" + GOOD + "\n" + END + "\n")
    add("b", END + "\n\n")
    wanted = [("a", "progress", None), ("a", "progress", None), ("a", None, "line_too_long"), ("a", "succeeded", None), ("a", "progress", "after_end"), ("a", "succeeded", "after_end")]
    wanted += [("b", None, "no_object"), ("b", "succeeded", None), ("b", "succeeded", "after_end"), ("b", None, "after_end")]
    assert run() == wanted
    (folder / "b.jsonl").rename(tmp_path / "b.jsonl")
    add("c", END + "\n")
    assert run() == [*wanted, ("c", "succeeded", None)]


def test_a_trigger_is_bounded(tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_bytes(b"x" * 30)
    reader = event_lines._Reader({"path": str(tmp_path), "bytes_per_trigger": "40", "split_bytes": "25"})
    assert reader.initialOffset() == {}
    assert reader.latestOffset() == {"a.jsonl": 30, "b.jsonl": 10}
    assert [(p.path, p.start, p.end) for p in reader.partitions({}, {"a.jsonl": 30, "b.jsonl": 10})] == [("a.jsonl", 0, 25), ("a.jsonl", 25, 30), ("b.jsonl", 0, 10)]
    assert reader.latestOffset() == {"a.jsonl": 30, "b.jsonl": 30}
    again = event_lines._Reader({"path": str(tmp_path), "bytes_per_trigger": "1"})
    assert again.latestOffset() == {"a.jsonl": 30, "b.jsonl": 30}
