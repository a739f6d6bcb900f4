"""Event lines of a localization run: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domains import STAGE_PERCENT
from ..functions import records, text

#: Bytes of the longest line that is read.
MOST_BYTES = 256 * 1024
VERSION = 2
PROGRESS = ("completed_batches", "message", "schema_version", "stage", "total_batches", "type")
ENDS = ("succeeded", "failed", "compatibility_report")
SCHEMA = "schema_version int, type string, stage string, message string, completed_batches long, total_batches long"


def valid_progress(stage: Column, message: Column, done: Column, total: Column) -> Column:
    """A known stage and a message; both counts or none, total not 0, done at most total."""
    counts = (done.isNull() == total.isNull()) & F.coalesce((total != 0) & (done <= total), F.lit(True))
    return stage.isin(*STAGE_PERCENT) & text.checked_string(message, 2000) & counts


def line_error(line: Column, e: Column) -> Column:
    """What is wrong with a line and its event, apart from its place in the run; null for a good one."""
    keys = F.json_object_keys(line)
    allowed = F.array(*[F.lit(k) for k in PROGRESS])
    progress = e["type"] == "progress"
    good = valid_progress(e["stage"], e["message"], e["completed_batches"], e["total_batches"])
    return (
        F.when(F.octet_length(line) > MOST_BYTES, "line_too_long")
        .when(keys.isNull(), "no_object")
        .when(~records.is_integer(line, "schema_version") | (e["schema_version"] != VERSION), "version")
        .when(progress & (F.size(F.array_except(keys, allowed)) > 0), "unknown_fields")
        .when(progress & ~F.coalesce(good, F.lit(False)), "progress")
        .when(F.coalesce(~progress & ~e["type"].isin(*ENDS), F.lit(True)), "type")
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Events of (run, line_no, line) with ``error``: line_too_long, no_object,
    unknown_fields, version, progress, type, or after_end for what follows a run's
    terminal event; null for a good line. A run is one process's output."""
    rows = lines.withColumn("e", F.from_json("line", SCHEMA)).withColumn("error", line_error(F.col("line"), F.col("e")))
    end = F.min(F.when(F.col("error").isNull() & F.col("e.type").isin(*ENDS), F.col("line_no"))).alias("end_no")
    ends = rows.groupBy("run").agg(end)
    late = F.coalesce(F.col("line_no") > F.col("end_no"), F.lit(False))
    return rows.join(ends, "run").withColumn("error", F.when(late, "after_end").otherwise(F.col("error"))).select("run", "line_no", "e.*", "error")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of finished files of lines; each file is a run and read whole. For files that grow, and large ones, see
    :mod:`glossaspark.streaming.event_lines`."""
    numbered = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.col("value"))
    rows = numbered.select("run", F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n\\z", ""), "\\r?\\n", -1)).alias("line_no", "line"))
    return parsed(rows)
