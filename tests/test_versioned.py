"""Durable versions: one winner each, whatever happens between reading and publishing."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from glossaspark.functions import text
from glossaspark.operators import store
from glossaspark.operators.versioned import LostRace, VersionedStore


@pytest.fixture
def made(spark, tmp_path):
    held = VersionedStore(spark, f"file://{tmp_path}/store", "k", "v", buckets=4)
    held.create(spark.createDataFrame([(i, "pending") for i in range(10)], "k int, v string"))
    return held


def attempts(spark, *rows):
    return spark.createDataFrame(rows, "k int, v string, expected string, o int")


def rows(df):
    return {r["k"]: (r["v"], r["version"]) for r in df.collect()}


def outcomes(df):
    return sorted((r["k"], r["o"], r["outcome"]) for r in df.collect())


def test_commit_is_seen_by_another_session(spark, made):
    out = made.compare_and_set(attempts(spark, (1, "running", "pending", 1), (1, "failed", "pending", 2), (2, "done", "running", 3), (99, "x", "y", 4)), "expected", "o")
    assert outcomes(out) == [(1, 1, "committed"), (1, 2, "stale"), (2, 3, "stale"), (99, 4, "missing")]
    other = VersionedStore(spark.newSession(), made.path, "k", "v")
    assert rows(other.snapshot())[1] == ("running", 2) and rows(other.snapshot())[2] == ("pending", 1)
    assert rows(other.snapshot(1))[1] == ("pending", 1)  # old versions stay readable
    assert len(rows(other.snapshot())) == 10


def test_a_tie_has_one_winner(spark, made):
    tie = attempts(spark, (3, "a", "pending", 7), (3, "b", "pending", 7), (3, "c", "pending", 7))
    out = made.compare_and_set(tie, "expected", "o").collect()
    won = [r["v"] for r in out if r["outcome"] == "committed"]
    assert len(won) == 1 and sorted(r["outcome"] for r in out) == ["committed", "stale", "stale"]
    assert rows(made.snapshot())[3] == (won[0], 2)
    # the operator alone chooses alike
    current = spark.createDataFrame([(3, "pending", 1)], "k int, v string, version int")
    alone = store.compare_and_set(current, tie, "k", "v", "expected", "o")
    assert [r["v"] for r in alone.where("outcome = 'committed'").collect()] == won
    assert store.committed(current, alone, "k", "v", "o", "version").first()["v"] == won[0]


def test_the_loser_of_a_race_is_stale(spark, made):
    """The other writer publishes after this one has read and judged."""
    other = VersionedStore(spark.newSession(), made.path, "k", "v", buckets=4)

    class Slow(VersionedStore):
        raced = False

        def _take(self, manifest, version):
            if not self.raced:
                self.raced = True
                won = other.compare_and_set(attempts(other.spark, (5, "theirs", "pending", 1), (6, "theirs", "pending", 1)), "expected", "o")
                assert {r["outcome"] for r in won.collect()} == {"committed"}
            return super()._take(manifest, version)

    slow = Slow(spark, made.path, "k", "v", buckets=4)
    out = slow.compare_and_set(attempts(spark, (5, "mine", "pending", 1), (7, "mine", "pending", 1)), "expected", "o")
    assert outcomes(out) == [(5, 1, "stale"), (7, 1, "committed")]
    now = rows(made.snapshot())
    assert now[5] == ("theirs", 2) and now[6] == ("theirs", 2) and now[7] == ("mine", 2)
    assert made.versions() == [1, 2, 3]


def test_concurrent_writers_lose_no_commit(spark, made):
    """Each adds one to the same counter until it has won; no addition is lost."""
    path = made.path.replace("/store", "/counter")
    VersionedStore(spark, path, "k", "v", 1).create(spark.createDataFrame([(1, "0")], "k int, v string"))

    def add():
        mine = VersionedStore(spark.newSession(), path, "k", "v", 1)
        while True:
            seen = rows(mine.snapshot())[1][0]
            out = mine.compare_and_set(attempts(mine.spark, (1, str(int(seen) + 1), seen, 1)), "expected", "o")
            if out.first()["outcome"] == "committed":
                return

    threads = [threading.Thread(target=add) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert rows(VersionedStore(spark, path, "k", "v", 1).snapshot())[1] == ("3", 4)


def test_a_crash_before_the_manifest_changes_nothing(spark, made, monkeypatch):
    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedStore, "_take", dies)
        with pytest.raises(KeyboardInterrupt):
            made.compare_and_set(attempts(spark, (1, "x", "pending", 1)), "expected", "o")
    assert made.versions() == [1] and rows(made.snapshot())[1] == ("pending", 1)
    made.compare_and_set(attempts(spark, (1, "y", "pending", 1)), "expected", "o")
    before = len(list_data(made))
    made.vacuum(1)
    assert made.versions() == [2] and len(list_data(made)) < before
    assert rows(made.snapshot())[1] == ("y", 2) and len(rows(made.snapshot())) == 10


def list_data(held):
    fs = held._fs(held._hadoop(held.path))
    return fs.listStatus(held._hadoop(f"{held.path}/data"))


def test_only_touched_buckets_are_written(spark, made):
    made.compare_and_set(attempts(spark, (1, "x", "pending", 1)), "expected", "o")
    first, second = made._manifest(1)["folders"], made._manifest(2)["folders"]
    assert sum(first[b] != second[b] for b in first) == 1


def test_no_winner_makes_no_version(spark, made):
    made.compare_and_set(attempts(spark, (1, "x", "running", 1)), "expected", "o")
    made.compare_and_set(attempts(spark).where("false"), "expected", "o")
    assert made.versions() == [1]


def test_insert_once(spark, made):
    new = lambda *r: spark.createDataFrame(r, "k int, v string")
    told = lambda df: sorted((r["k"], r["v"], r["outcome"]) for r in df.collect())
    assert told(made.insert_once(new((20, "a"), (20, "a"), (1, "pending")))) == [(1, "pending", "same"), (20, "a", "insert"), (20, "a", "insert")]
    assert rows(made.snapshot())[20] == ("a", 1)
    assert told(made.insert_once(new((20, "a")))) == [(20, "a", "same")] and made.versions() == [1, 2]
    assert told(made.insert_once(new((20, "b"), (21, "a"), (22, "a"), (22, "b")))) == [(20, "b", "conflict"), (21, "a", "insert"), (22, "a", "conflict"), (22, "b", "conflict")]
    assert made.versions() == [1, 2] and 21 not in rows(made.snapshot())


def test_create_refuses(spark, made, tmp_path):
    with pytest.raises(LostRace):
        made.create(spark.createDataFrame([(1, "a")], "k int, v string"))
    empty = VersionedStore(spark, f"file://{tmp_path}/none", "k", "v")
    with pytest.raises(FileNotFoundError):
        empty.snapshot()
    with pytest.raises(Exception, match="several rows"):
        empty.create(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    assert empty.versions() == []
    empty.create(spark.createDataFrame([], "k int, v string"))
    assert empty.snapshot().count() == 0
    json.loads(spark.read.text(empty._name(1)).first()[0])


def test_many_tokens_in_one_text(spark):
    """200 000 tokens of one text: the work is linear."""
    one = "[a]x{b}\\n𝄞"
    df = spark.createDataFrame([(one * 70_000,)], "t string").repartition(1)
    found = text.tokens(F.col("t"))
    r = df.select(F.size(found).alias("n"), F.element_at(found, -1).alias("last"), text.spans_fit(F.col("t"), found).alias("ok")).first()
    assert r["n"] == 210_000 and r["ok"]
    assert tuple(r["last"]) == (209_999, "escape", "\\n", 70_000 * 10 - 3, 70_000 * 10 - 1)
