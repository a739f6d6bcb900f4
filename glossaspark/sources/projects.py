"""Scans of project folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from .encoding import decoded_files


def files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below a folder: (path relative to it, content). Filters on the path apply
    before contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(root)
    base = F.regexp_replace(F.regexp_replace(F.lit(root), "^file:/*", "/"), "/+$", "")
    whole = F.regexp_replace("path", "^file:/*", "/")
    inner = F.when(whole == base, F.regexp_extract(whole, "[^/]*$", 0)).otherwise(F.substring(whole, F.length(base) + 2, F.length(whole)))
    return rows.select(inner.alias("path"), "content")


def by_parts(path: Column) -> Column:
    """Order of paths by their parts, not by their characters."""
    return F.split(path, "/")


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Texts of a project and warnings for files that aren't text: (path, kind, engine,
    size_bytes, sha256, encoding, has_bom, line_count) and (path, message), to be sorted
    by :func:`by_parts` where order matters."""
    found = files(spark, root)
    wanted = found.where(~paths.ignored(F.col("path")) & paths.file_kind(F.col("path")).isNotNull())
    rows = decoded_files(wanted)
    good = rows.where("encoding IS NOT NULL").select(
        "path",
        paths.file_kind(F.col("path")).alias("kind"),
        paths.engine_hint(F.col("path")).alias("engine"),
        "size_bytes",
        "sha256",
        "encoding",
        "has_bom",
        F.when(F.length("text") == 0, 0).otherwise(text.line_count(F.col("text"))).alias("line_count"),
    )
    return good, rows.where("encoding IS NULL").select("path", F.lit("no known text encoding").alias("message"))


def scripts(spark: SparkSession, root: str) -> DataFrame:
    """Decoded scripts (path, text, encoding, has_bom, size_bytes, sha256) of a project, or
    the one script that ``root`` is, under its own name and with any ending. A folder without scripts is an error."""
    found = files(spark, root, "*.[rR][pP][yY]*") if _is_folder(spark, root) else files(spark, root)
    wanted = found.where((F.col("path") == _name(root)) | (~paths.ignored(F.col("path")) & paths.suffix(F.col("path")).isin(".rpy", ".rpym")))
    if wanted.select("path").isEmpty():
        raise ValueError(f"there are no scripts below {root}")
    return decoded_files(wanted)


def _is_folder(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _name(root: str) -> str:
    return root.rstrip("/").rsplit("/", 1)[-1]


def translatable(path: Column) -> Column:
    """A script below ``game`` that is no translation."""
    parts = F.transform(F.split(path, "/"), F.lower)
    return (F.get(parts, F.lit(0)) == "game") & ~F.array_contains(parts, "tl") & paths.suffix(path).isin(".rpy", ".rpym")


def exported(found: DataFrame, language: str) -> DataFrame:
    """Files (path, ...) of a translation export, which holds only ``.rpy`` files below
    ``game/tl/<language>``; anything else stops the query."""
    inside = F.startswith("path", F.lit(f"game/tl/{language}/")) & F.endswith("path", F.lit(".rpy"))
    stray = F.raise_error(F.concat(F.lit("not part of an export: "), "path"))
    return found.withColumn("path", F.when(inside, F.col("path")).otherwise(stray))
