"""Imports of archives and folders published whole or not at all."""

from __future__ import annotations

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_sources import packed

from glossaspark.sources import archives, snapshots


@pytest.fixture
def game(tmp_path):
    """Two archives of 300 and 3 entries."""
    folder = tmp_path / "game"
    folder.mkdir()
    many = {f"ch{i:03}/s.rpy": (f"label l{i}:\n" * (1 + i % 50)).encode() for i in range(299)} | {"a.rpyc": b"c"}
    (folder / "one.rpa").write_bytes(packed(many))
    (folder / "two.rpa").write_bytes(packed({"b.rpym": b"label b:\n", "tl/fr/x.rpy": b"t", "p.png": b"p"}, key=7))
    return folder


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def test_import_publishes_scripts_and_manifest(spark, game, tmp_path):
    out = tmp_path / "out"
    archives.import_snapshot(spark, str(game), str(out), authorised=True, split_bytes=4096)
    found = tree(out)
    manifest = json.loads(found.pop("manifest.json"))
    assert len(found) == 300 and found["game/ch007/s.rpy"] == b"label l7:\n" * 8 and found["game/b.rpym"] == b"label b:\n"
    assert [f["relative_path"] for f in manifest["source_files"]] == sorted(found)
    assert [(a["relative_path"], a["entries"]) for a in manifest["archives"]] == [("one.rpa", 300), ("two.rpa", 3)]
    assert manifest["ignored_compiled_scripts"] == ["a.rpyc"] and manifest["ignored_translation_files"] == ["tl/fr/x.rpy"]
    again = tmp_path / "again"
    archives.import_snapshot(spark, str(game), str(again), authorised=True)
    assert tree(again) == tree(out)  # also the id, whatever the splits
    assert sorted(p.name for p in tmp_path.iterdir()) == ["again", "game", "out"]


def test_one_archive_is_the_work_of_many_tasks(spark, game):
    entries = archives.planned(spark, str(game))
    rows = archives.contents(entries, split_bytes=8192).withColumn("task", F.spark_partition_id())
    per_task = Counter(r["task"] for r in rows.where("archive LIKE '%one.rpa'").select("task").collect())
    assert len(per_task) > 3 and max(per_task.values()) < 200


def test_a_changed_archive_stops_the_import(spark, game, tmp_path, monkeypatch):
    plan = archives.planned

    def changed(*args, **limits):
        entries = plan(*args, **limits)
        os.utime(game / "two.rpa", ns=(1, 1))
        return entries

    monkeypatch.setattr(archives, "planned", changed)
    with pytest.raises(Exception, match="changed while it was read"):
        archives.import_snapshot(spark, str(game), str(tmp_path / "out"), authorised=True)
    assert [p.name for p in tmp_path.iterdir()] == ["game"]


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    boom = F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.lit("x"))
    files = spark.range(100).repartition(4).select(F.concat(F.lit("f"), "id").alias("relative_path"), boom.cast("binary").alias("content"))
    with pytest.raises(Exception, match="killed"):
        snapshots.write(files, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize(
    ("names", "clash"),
    [(["A.rpy", "a.rpy"], True), (["stra\u00dfe.rpy", "STRASSE.rpy"], True), (["e\u0301.rpy", "\u00e9.rpy"], True), (["a", "A/b.rpy"], True), (["a.rpy", "b/a.rpy"], False)],
)
def test_paths_that_collide(spark, tmp_path, names, clash):
    files = spark.createDataFrame([(n, b"x") for n in names], "relative_path string, content binary")
    if clash:
        with pytest.raises(Exception, match="one path for two files"):
            snapshots.write(files, str(tmp_path / "out"))
        assert list(tmp_path.iterdir()) == []
    else:
        snapshots.write(files, str(tmp_path / "out"))
        assert sorted(tree(tmp_path / "out")) == sorted(names)


@pytest.mark.parametrize("name", ["game/a.rpy", "con.rpy", "a?.rpy", "x /a.rpy", "e\u0301.rpy"])
def test_names_that_cannot_be_written(spark, tmp_path, name):
    (tmp_path / "a.rpa").write_bytes(packed({name: b"x"}))
    with pytest.raises(archives.ArchiveError):
        archives.planned(spark, str(tmp_path))


def test_budgets_hold_over_all_archives(spark, game, tmp_path):
    for limits in ({"archives": 1}, {"all_archive_bytes": 1000}, {"total_bytes": 20_000}, {"file_bytes": 100}):
        with pytest.raises(archives.ArchiveError):
            archives.planned(spark, str(game), **limits)
    (game / "three.rpa").write_bytes(packed({"B.rpym": b"other"}))
    with pytest.raises(archives.ArchiveError, match="one path"):
        archives.planned(spark, str(game))
    with pytest.raises(PermissionError):
        archives.import_snapshot(spark, str(game), str(tmp_path / "out"))
    (tmp_path / "none").mkdir()
    (tmp_path / "none/a.rpa").write_bytes(packed({"a.rpyc": b"c"}))
    with pytest.raises(archives.ArchiveError, match="no scripts"):
        archives.import_snapshot(spark, str(tmp_path / "none"), str(tmp_path / "out"), authorised=True)
