"""What a game folder holds, and whether it can be translated."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import suffix

LISTED = "path string, is_dir boolean, is_link boolean, depth int"
#: Names of programs that don't start the game.
OTHER_LAUNCHERS = ("python.exe", "pythonw.exe", "zsync.exe", "zsyncmake.exe")


def classify(path: Column) -> Column:
    """translation, source, compiled or archive, from a path below ``game``; else null."""
    kind = suffix(path)
    script, compiled = kind.isin(".rpy", ".rpym"), kind.isin(".rpyc", ".rpymc")
    below_tl = F.lower(F.split(path, "/")[0]) == "tl"
    return (
        F.when(below_tl & (script | compiled), "translation")
        .when(script, "source")
        .when(compiled, "compiled")
        .when(kind == ".rpa", "archive")
    )


def is_launcher(name: Column) -> Column:
    low = F.lower(name)
    return low.endswith(".exe") & ~low.isin(*OTHER_LAUNCHERS) & ~low.startswith("unins") & ~name.contains("/")


def status() -> Column:
    """Decision over the counts of a project, the first rule that fits. Columns:
    has_game, incomplete, sources, archives, compiled, translations, launcher, runtime."""
    c = F.col
    packaged = (c("archives") > 0) | (c("compiled") > 0)
    strong = (c("compiled") > 0) | ((c("archives") > 0) & (c("launcher") | c("runtime")))
    running = c("runtime") & c("launcher")
    return (
        F.when(~c("has_game"), F.when(running, "uncertain").otherwise("not_renpy"))
        .when(c("incomplete"), "uncertain")
        .when(c("sources") > 0, "source_ready")
        .when(packaged & strong, "packaged_requires_import")
        .when(packaged | (c("translations") > 0) | running, "uncertain")
        .otherwise("not_renpy")
    )


def presentation(found: Column) -> Column:
    """What a user is shown for a status: (tone, next_step)."""
    shown = {
        "source_ready": ("ready", "choose the SDK, the service and a new output folder"),
        "packaged_requires_import": ("blocked", "keep the folder; packed games are not opened here"),
        "uncertain": ("uncertain", "choose the folder of the game, or its game folder, and check again"),
        "not_renpy": ("blocked", "choose a project with a game folder"),
    }
    out = F.lit(None).cast("struct<tone:string,next_step:string>")
    for name, (tone, step) in shown.items():
        out = F.when(found == name, F.struct(F.lit(tone).alias("tone"), F.lit(step).alias("next_step"))).otherwise(out)
    return out


def summary(found: Column) -> Column:
    """One sentence on a status, in the language of its users."""
    # The sentences that a report shows.
    told = {
        "source_ready": "发现可读的 Ren'Py 源脚本；当前 source-only 流程可以继续。",
        "packaged_requires_import": "已识别为 Ren'Py 成品结构；当前自动流程不能直接继续，且不会反编译编译脚本。",
        "uncertain": "发现部分 Ren'Py 线索，但证据不足或扫描不完整；已安全停止。",
        "not_renpy": "没有发现足以确认 Ren'Py 项目的证据。",
    }
    return F.create_map(*[F.lit(x) for pair in told.items() for x in pair])[found]


class Unbounded(ValueError):
    """A folder that is too deep or holds too many entries."""


def inspected(spark: SparkSession, folder: str, **bounds: int) -> DataFrame:
    """Report of a selected folder, with ``issue``. The folder may be the ``game`` folder
    itself. One beyond the bounds, or that can't be read, is uncertain."""
    root = os.path.abspath(os.path.expanduser(folder))
    if os.path.basename(root).casefold() == "game":
        root = os.path.dirname(root)
    try:
        return report(listing(spark, root, **bounds)).withColumn("issue", F.lit(None).cast("string"))
    except (Unbounded, OSError) as error:
        nothing = report(spark.createDataFrame([], LISTED))
        return nothing.withColumn("status", F.lit("uncertain")).withColumn("issue", F.lit(str(error)))


def listing(spark: SparkSession, root: str, max_depth: int = 12, max_entries: int = 50_000) -> DataFrame:
    """Entries below a folder of the driver, bounded in depth and number; links are
    listed and not followed. Raises when a bound is reached: a partial listing would
    look like a whole one."""
    rows: list[tuple[str, bool, bool, int]] = []
    open_folders = [("", 0)]
    while open_folders:
        folder, depth = open_folders.pop()
        for entry in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: (e.name.casefold(), e.name)):
            path = f"{folder}/{entry.name}" if folder else entry.name
            link, is_dir = entry.is_symlink(), entry.is_dir(follow_symlinks=False)
            rows.append((path, is_dir, link, depth))
            if len(rows) > max_entries or (is_dir and depth >= max_depth):
                raise Unbounded(f"{root} is deeper than {max_depth} levels or has more than {max_entries} entries")
            if is_dir and not link:
                open_folders.append((path, depth + 1))
    return spark.createDataFrame(rows, LISTED)


def report(entries: DataFrame) -> DataFrame:
    """One row for a project from its listing (paths below the project). Exactly one
    folder of the project is named ``game``, in any case; two of them are none."""
    game = F.lower(F.split("path", "/")[0]) == "game"
    folders = F.count_if(F.col("is_dir") & (F.lower("path") == "game"))
    inner = F.regexp_replace("path", "^[^/]*/", "")
    kind = F.when(game & ~F.col("is_dir") & ~F.col("is_link"), classify(inner))
    count = lambda k: F.count_if(F.coalesce(kind == k, F.lit(False)))
    counts = entries.agg(
        (folders == 1).alias("has_game"),
        F.coalesce(F.bool_or(game & F.col("is_link")), F.lit(False)).alias("incomplete"),
        count("source").alias("sources"),
        count("archive").alias("archives"),
        count("compiled").alias("compiled"),
        count("translation").alias("translations"),
        F.coalesce(F.bool_or(is_launcher(F.col("path")) & ~F.col("is_dir")), F.lit(False)).alias("launcher"),
        F.coalesce(F.bool_or((F.lower("path") == "renpy") & F.col("is_dir")), F.lit(False)).alias("runtime"),
    )
    return counts.withColumn("status", status()).withColumn("summary", summary(F.col("status")))
