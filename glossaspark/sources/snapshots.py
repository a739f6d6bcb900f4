"""A folder of files with exact names as a Spark sink, published whole or not at all.

``df.write.format("file_snapshot")`` takes (relative_path, content, origin). Tasks stage the files
beside the output on the file system that all share, each attempt in a folder of its own, so
a repeated task leaves nothing behind. The driver sees names, sizes and digests. It
refuses paths that one case-insensitive folder can't hold together, moves the files of
the attempts that count into place, writes the manifest, looks at the sources again,
and renames the folder.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "relative_path string, content binary, origin string"
MANIFEST = "manifest.json"


class SnapshotError(ValueError):
    """The files can't be published together."""


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def signature(path: str) -> list:
    """What tells that a file is still the one that was read."""
    fs, inside = file_system(path)
    info = fs.get_file_info(inside)
    return [path, info.type.name, info.size, info.mtime_ns]


def collisions(names: list[str]) -> list[tuple[str, str]]:
    """Pairs of paths of which one would overwrite the other, or be its folder."""
    seen, out = {}, []
    key = lambda name: unicodedata.normalize("NFC", name).casefold()
    for name in names:
        if key(name) in seen:
            out.append((seen[key(name)], name))
        seen[key(name)] = name
    for name in names:
        parts = key(name).split("/")
        out += [(seen[folder], name) for n in range(1, len(parts)) if (folder := "/".join(parts[:n])) in seen]
    return out


def _make_folders(fs: arrow_fs.FileSystem, base: str, path: str) -> None:
    """The folders of a file below ``base``, which has to be there: a task that outlives
    its job can't bring a removed one back."""
    parts = path[len(base) + 1 :].split("/")[:-1]
    for n in range(1, len(parts) + 1):
        fs.create_dir("/".join([base, *parts[:n]]), recursive=False)


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: list[tuple[str, int, str, str | None]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/").removeprefix("file://") if options["path"].startswith("file:///") else options["path"].rstrip("/")
        self.header = json.loads(options.get("manifest", "null"))
        self.sources = json.loads(options.get("sources", "[]"))
        parent, _, name = self.root.rpartition("/")
        self.stage = f"{parent}/.stage-{name}-{uuid.uuid4().hex}"
        fs, stage = file_system(self.stage)
        fs.create_dir(stage, recursive=True)

    def write(self, iterator: Iterator) -> _Staged:
        fs, stage = file_system(self.stage)
        folder, files = f"{stage}/{uuid.uuid4().hex}", []
        for row in iterator:
            path = f"{folder}/{row['relative_path']}"
            if any(p in ("", ".", "..") for p in row["relative_path"].split("/")):
                raise SnapshotError(f"a path leaves the output: {row['relative_path']!r}")
            _make_folders(fs, stage, path)
            content = bytes(row["content"])
            with fs.open_output_stream(path) as out:
                out.write(content)
            files.append((row["relative_path"], len(content), hashlib.sha256(content).hexdigest(), row["origin"]))
        return _Staged(folder, files)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, stage = file_system(self.stage)
        _, root = file_system(self.root)
        try:
            staged = [m for m in messages if m is not None]
            if found := collisions(sorted(f[0] for m in staged for f in m.files)):
                raise SnapshotError(f"one path for two files: {found[0][0]} and {found[0][1]}")
            final = f"{stage}/final"
            fs.create_dir(final, recursive=True)
            for m in staged:
                for name, *_ in m.files:
                    _make_folders(fs, stage, f"{final}/{name}")
                    fs.move(f"{m.folder}/{name}", f"{final}/{name}")
            if self.header is not None:
                with fs.open_output_stream(f"{final}/{MANIFEST}") as out:
                    out.write(self.manifest(staged))
            for was in self.sources:
                if signature(was[0]) != was:
                    raise SnapshotError(f"{was[0]} changed while it was read")
            if fs.get_file_info(root).type != arrow_fs.FileType.NotFound:
                raise SnapshotError(f"{self.root} exists")
            fs.move(final, root)
        finally:
            self.clear()

    def abort(self, messages: list[_Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, stage = file_system(self.stage)
        if fs.get_file_info(stage).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(stage)

    def manifest(self, staged: list[_Staged]) -> bytes:
        files = sorted(({"relative_path": n, "size_bytes": size, "sha256": sha, "origin": origin} for m in staged for n, size, sha, origin in m.files), key=lambda f: f["relative_path"])
        told = json.dumps({"archives": self.header.get("archives"), "source_files": files}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        whole = self.header | {"source_files": files, "import_id": "import_" + hashlib.sha256(told.encode()).hexdigest()[:24]}
        return (json.dumps(whole, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()


class FileSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def write(files: DataFrame, root: str, manifest: dict | None = None, sources: list[list] | None = None) -> None:
    """Publish (relative_path, content, and origin if there is one) below the new folder ``root``.

    ``sources``: signatures of the files that the rows come from; if one has changed by the end, nothing
    is published. ``manifest``: what the manifest says besides the files."""
    fs, path = file_system(root.removeprefix("file://"))
    if fs.get_file_info(path).type != arrow_fs.FileType.NotFound:
        raise FileExistsError(root)
    files.sparkSession.dataSource.register(FileSnapshot)
    rows = files.selectExpr("relative_path", "CAST(content AS BINARY) AS content", "origin" if "origin" in files.columns else "CAST(NULL AS STRING) AS origin")
    options = {"path": root} | ({"manifest": json.dumps(manifest)} if manifest is not None else {}) | {"sources": json.dumps(sources or [])}
    rows.write.format("file_snapshot").options(**options).mode("append").save()
