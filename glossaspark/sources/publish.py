"""Translated files of a project, written whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import safe_template
from . import snapshots


def publish(files: DataFrame, root: str) -> None:
    """Write (relative_path, content) with a byte order mark below a new folder ``root``
    that all executors share: tasks write the files, nothing passes through the driver."""
    inner = F.regexp_replace("relative_path", "^game/tl/[^/]+/", "")
    if not files.where(~safe_template(inner) | ~F.col("relative_path").startswith("game/tl/")).isEmpty():
        raise ValueError("a path leaves the output folder")
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("content", "UTF-8"))
    snapshots.write(files.select("relative_path", marked.alias("content")), root)
