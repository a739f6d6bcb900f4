"""Script files inside game archives, as a Spark data source.

``spark.read.format("game_archive").load(path)`` gives (archive, name, kind, size_bytes,
sha256, content) with one partition for each archive; only scripts have content. The
index of an archive is not trusted: its size is bounded, its pickle may name four
container classes and nothing else, and each extent must lie in the data region and
overlap no other.

For large archives :func:`planned` reads the indexes first, a task for each archive, and
:func:`contents` then reads the extents of the scripts in splits of about equal bytes, so one
archive is the work of many tasks. :func:`import_snapshot` publishes them.
"""

from __future__ import annotations

import glob
import hashlib
import io
import os
import pickle
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import safe_archive_entry, safe_output
from ..functions.unicode import nfc, path_key
from ..operators.sequences import running_sum
from ..storage import written
from . import snapshots

# The archive format.
HEADER = re.compile(rb"RPA-3\.0 ([0-9a-fA-F]{16}) ([0-9a-fA-F]{8})\n")
CONTAINERS = {
    ("renpy.python", "RevertableDict"): dict,
    ("renpy.python", "RevertableList"): list,
    ("renpy.revertable", "RevertableDict"): dict,
    ("renpy.revertable", "RevertableList"): list,
}
LIMITS = {"index_bytes": 32 << 20, "entries": 50_000, "archive_bytes": 8 << 30, "file_bytes": 16 << 20, "total_bytes": 128 << 20, "archives": 128, "all_archive_bytes": 32 << 30}
INDEX = "archive string, archive_bytes long, mtime_ns long, name string, kind string, offset long, size_bytes long"
SCHEMA = "archive string, name string, kind string, size_bytes long, sha256 string, content binary"


class ArchiveError(ValueError):
    """An archive breaks its format or a limit."""


class _Containers(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        try:
            return CONTAINERS[module, name]
        except KeyError:
            raise ArchiveError(f"the index names {module}.{name}") from None

    def persistent_load(self, pid):
        raise ArchiveError("the index holds references")


def read_index(data: bytes, limit: int = LIMITS["index_bytes"]) -> dict:
    inflater = zlib.decompressobj()
    try:
        plain = inflater.decompress(data, limit + 1)
    except zlib.error as error:
        raise ArchiveError("the index is damaged") from error
    if len(plain) > limit:
        raise ArchiveError("the index is too large")
    if not inflater.eof or inflater.unused_data:
        raise ArchiveError("the index ends elsewhere than the archive")
    try:
        reader = _Containers(io.BytesIO(plain))
        index = reader.load()
    except ArchiveError:
        raise
    except Exception as error:
        raise ArchiveError("the index can't be read") from error
    if type(index) is not dict:
        raise ArchiveError("the index is no dictionary")
    return index


def extents(index: dict, key: int, first: int, end: int) -> list[tuple[int, int, str]]:
    """(offset, size, name) of the entries by offset, all inside [first, end)."""
    out = []
    for name, parts in index.items():
        ok = isinstance(name, str) and isinstance(parts, list) and len(parts) == 1 and isinstance(parts[0], tuple)
        if not ok or len(parts[0]) not in (2, 3) or (len(parts[0]) == 3 and parts[0][2] not in (b"", "")):
            raise ArchiveError(f"entry of another form: {name!r}")
        offset, size = parts[0][:2]
        if type(offset) is not int or type(size) is not int:
            raise ArchiveError(f"extent of {name!r} is no pair of integers")
        offset, size = offset ^ key, size ^ key
        if offset < first or size < 0 or offset + size > end:
            raise ArchiveError(f"extent of {name!r} leaves the data region")
        out.append((offset, size, name))
    out.sort()
    for (offset, size, _), (later, _, name) in zip(out, out[1:], strict=False):
        if later < offset + size:
            raise ArchiveError(f"extent of {name!r} overlaps another")
    return out


def unsafe(name: str) -> bool:
    parts = name.split("/")
    return (
        not name
        or len(name.encode("utf-8", "surrogatepass")) > 4096
        or "\\" in name
        or any(p in ("", ".", "..") or ":" in p or any(ord(c) < 32 for c in p) for p in parts)
    )


def kind_of(name: str) -> str:
    low, top = name.casefold(), name.split("/")[0].casefold()
    script, compiled = low.endswith((".rpy", ".rpym")), low.endswith((".rpyc", ".rpymc"))
    if top == "tl" and (script or compiled):
        return "translation"
    return "source" if script else "compiled" if compiled else "other"


def limits_of(given: dict) -> dict[str, int]:
    """The limits, tightened by ``given``; what isn't a positive number, or would widen a limit, is refused."""
    for name, value in given.items():
        if not re.fullmatch(r"[0-9]{1,18}", str(value)) or not 1 <= int(value) <= LIMITS[name]:
            raise ArchiveError(f"{name} is a number from 1 to {LIMITS[name]}")
    return LIMITS | {name: int(value) for name, value in given.items()}


def entries_of(path: str, limits: dict[str, int]) -> list[tuple[int, int, str]]:
    """(offset, size, name) of an archive's entries, from its header and index alone."""
    size = os.path.getsize(path)
    if size > limits["archive_bytes"]:
        raise ArchiveError(f"{path} is too large")
    with open(path, "rb") as f:
        header = HEADER.match(f.read(64))
        if not header:
            raise ArchiveError(f"{path} is no archive of this format")
        at, key = int(header[1], 16), int(header[2], 16)
        if not header.end() <= at < size or size - at > limits["index_bytes"]:
            raise ArchiveError(f"the index of {path} leaves the archive")
        f.seek(at)
        index = read_index(f.read(size - at), limits["index_bytes"])
    if len(index) > limits["entries"]:
        raise ArchiveError(f"{path} has too many entries")
    found = extents(index, key, header.end(), at)
    if wrong := next((name for *_, name in found if unsafe(name)), None):
        raise ArchiveError(f"unsafe path {wrong!r}")
    return found


def read_archive(path: str, limits: dict[str, int]) -> Iterator[tuple]:
    found, total = entries_of(path, limits), 0
    with open(path, "rb") as f:
        for offset, length, name in found:
            kind, content = kind_of(name), None
            if kind == "source":
                total += length
                if length > limits["file_bytes"] or total > limits["total_bytes"]:
                    raise ArchiveError(f"scripts of {path} are too large")
                f.seek(offset)
                content = f.read(length)
            yield os.path.basename(path), name, kind, length, content and hashlib.sha256(content).hexdigest(), content


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        self.limits = limits_of({k: options[k] for k in LIMITS if k in options})

    def partitions(self) -> list[_Archive]:
        found = [self.root] if os.path.isfile(self.root) else sorted(glob.glob(os.path.join(self.root, "**", "*.rpa"), recursive=True))
        return [_Archive(p) for p in found]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        yield from read_archive(partition.path, self.limits)


class _IndexReader(_Reader):
    def read(self, partition: _Archive) -> Iterator[tuple]:
        path, was = partition.path, os.stat(partition.path)
        for offset, length, name in entries_of(path, self.limits):
            yield path, was.st_size, was.st_mtime_ns, name, kind_of(name), offset, length


class GameArchiveIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "game_archive_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(dict(self.options))


class GameArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "game_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """Archives below a path that all executors see."""
    spark.dataSource.register(GameArchive)
    return spark.read.format("game_archive").options(**{k: str(v) for k, v in limits.items()}).load(path)


def planned(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """The entries of all archives below ``path``, from their indexes, checked together.

    Limits hold over all archives too: their number and bytes, and a running sum of the bytes of
    scripts. A script's name has to be in NFC and writable below ``game`` on Windows, and
    no two scripts may have one place in a folder that ignores case."""
    bounds = limits_of(limits)
    spark.dataSource.register(GameArchiveIndex)
    rows = written(spark.read.format("game_archive_index").options(**{k: str(v) for k, v in limits.items()}).load(path), "entries")
    each = rows.groupBy("archive").agg(F.first("archive_bytes").alias("bytes"))
    count, total = each.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if count > bounds["archives"] or total > bounds["all_archive_bytes"]:
        raise ArchiveError("the archives are too many or too large")
    scripts = rows.where("kind = 'source'")
    bad = scripts.where(~safe_archive_entry(F.col("name")) | ~safe_output(F.col("name")) | (nfc("name") != F.col("name"))).first()
    if bad:
        raise ArchiveError(f"{bad['name']!r} of {bad['archive']} can't be written")
    twice = scripts.groupBy(path_key("name")).agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("z")).where("n > 1").first()
    if twice:
        raise ArchiveError(f"two scripts would be written to one path: {twice['a']!r} and {twice['z']!r}")
    if scripts.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)) > bounds["total_bytes"]).first()[0] or not scripts.where(F.col("size_bytes") > bounds["file_bytes"]).isEmpty():
        raise ArchiveError("the scripts are too large")
    return rows


def contents(entries: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """The scripts of :func:`planned` entries: archive, name, size_bytes, sha256, content.
    Extents are packed in the order of the archives into splits of about ``split_bytes``,
    a task each, whatever the sizes of the archives."""
    scripts = entries.where("kind = 'source'").withColumn("one", F.lit(1))
    placed = running_sum(scripts, ["one"], ["archive", "offset", "name"], F.col("size_bytes"), "upto")
    split = F.floor((F.col("upto") - F.col("size_bytes")) / split_bytes)
    splits = int(scripts.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]) // split_bytes + 1
    dealt = placed.select("archive", "name", "offset", "size_bytes", split.alias("split")).repartitionByRange(splits, "split").sortWithinPartitions("archive", "offset")

    def read_extents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                out = []
                for row in batch.iloc[start : start + 64].itertuples(index=False):
                    with open(row.archive, "rb") as f:
                        f.seek(row.offset)
                        content = f.read(row.size_bytes)
                    if len(content) != row.size_bytes:
                        raise ArchiveError(f"{row.archive} changed while it was read")
                    out.append((row.archive, row.name, row.size_bytes, hashlib.sha256(content).hexdigest(), content))
                yield pd.DataFrame(out, columns=["archive", "name", "size_bytes", "sha256", "content"])

    return dealt.mapInPandas(read_extents, "archive string, name string, size_bytes long, sha256 string, content binary")


def import_snapshot(spark: SparkSession, path: str, output: str, *, authorised: bool = False, split_bytes: int = 32 << 20, **limits: int) -> None:
    """Publish the scripts of all archives below ``path`` under ``output/game``, with a manifest of
    archives, files and what was left out. An archive that changes meanwhile, or a task that
    fails for good, leaves no output. ``authorised``: the user has confirmed that the files may be processed."""
    if not authorised:
        raise PermissionError("the import of a game's files needs its user's confirmation")
    entries = planned(spark, path, **limits)
    if entries.where("kind = 'source'").isEmpty():
        raise ArchiveError("the archives hold no scripts")
    # at most ``archives`` rows
    archives = entries.groupBy("archive").agg(F.first("archive_bytes").alias("size"), F.first("mtime_ns").alias("mtime"), F.count("*").alias("entries")).orderBy("archive").collect()
    left_out = {kind: sorted(r["name"] for r in entries.where(F.col("kind") == kind).select("name").distinct().collect()) for kind in ("compiled", "translation")}
    manifest = {
        "schema_version": 1,
        "archives": [{"relative_path": os.path.relpath(r["archive"], path if os.path.isdir(path) else os.path.dirname(path)), "size_bytes": r["size"], "entries": r["entries"]} for r in archives],
        "ignored_compiled_scripts": left_out["compiled"],
        "ignored_translation_files": left_out["translation"],
    }
    files = contents(entries, split_bytes).select(F.concat(F.lit("game/"), "name").alias("relative_path"), "content", F.regexp_extract("archive", "[^/]+$", 0).alias("origin"))
    snapshots.write(files, output, manifest, [[r["archive"], "File", r["size"], r["mtime"]] for r in archives])
