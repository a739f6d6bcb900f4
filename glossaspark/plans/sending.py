"""Sending of batches with a record before and after, so that none is sent twice."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import services
from ..sources.snapshots import file_system

RECEIPTS = "batch_id string, seq long, status string, error string, body string"
UNANSWERED = "the service has not answered yet"


def receipts(spark: SparkSession, store: str) -> DataFrame:
    """The latest receipt of each batch in the store (batch_id, seq, status, error, body)."""
    try:
        rows = spark.read.schema(RECEIPTS).option("recursiveFileLookup", "true").parquet(store)
        rows.take(1)
    except Exception as error:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], RECEIPTS)
    latest = F.max_by(F.struct("seq", "status", "error", "body"), "seq").alias("r")
    return rows.groupBy("batch_id").agg(latest).select("batch_id", "r.*")


def _stored(rows: DataFrame, store: str, name: str) -> DataFrame:
    rows.select("batch_id", F.col("seq").cast("long"), "status", F.col("error").cast("string"), F.col("body").cast("string")).write.parquet(f"{store}/{name}")
    return rows.sparkSession.read.schema(RECEIPTS).parquet(f"{store}/{name}")


def send(batches: DataFrame, store: str, backend: services.Backend, run: str, retry: bool = False) -> DataFrame:
    """Send the batches (batch_id, payload, segment_ids) that have no receipt, with
    ``retry`` also those that failed for certain, and return their receipts.

    An ``unknown`` receipt is stored for each before anything is sent. Where a run ends
    between the two, the receipt stays unknown and the batch isn't sent again: only
    :func:`recover` settles it. ``run`` names the run and can't be used twice. A task
    that Spark tries again, in a stage tried again or beside another attempt, finds the marks of the first
    one and leaves its batches unknown (:func:`fence`).
    """
    spark = batches.sparkSession
    known = receipts(spark, store).select("batch_id", "seq", "status")
    free = F.col("status").isNull() | ((F.col("status") == "failed") & F.lit(retry))
    open_ = batches.select("batch_id").distinct().join(known, "batch_id", "left").where(free)
    next_seq = F.coalesce(F.col("seq") + 1, F.lit(0))
    claims = _stored(open_.withColumn("seq", next_seq).withColumn("status", F.lit("unknown")).withColumn("error", F.lit(UNANSWERED)).withColumn("body", F.lit(None)), store, f"{run}-claims")
    sent = services.submitted(batches.join(claims.select("batch_id"), "batch_id", "left_semi"), backend, fence(f"{store}/_fences/{run}"))
    return _settled(sent.join(claims.select("batch_id", "seq"), "batch_id"), batches, store, f"{run}-answers")


def fence(folder: str) -> Callable[[str], bool]:
    """A test for tasks: whether this attempt is the only one that has come to send a batch.

    Each attempt writes a mark of its own for the batch and then lists all marks. A later attempt sees the
    earlier mark and doesn't send; of two at once at least one sees both, so at most one sends and perhaps none,
    which :func:`recover` finds out. The store's listing must show what was written before it.
    """

    def alone(batch_id: str) -> bool:
        store, base = file_system(folder)
        place = f"{base}/{hashlib.sha256(batch_id.encode()).hexdigest()}"
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/{uuid.uuid4().hex}"):
            pass
        return len(store.get_file_info(arrow_fs.FileSelector(place))) == 1

    return alone


def recover(batches: DataFrame, store: str, lookup: services.Backend, run: str) -> DataFrame:
    """Ask the service for the outcome of the batches whose receipt is unknown."""
    unknown = receipts(batches.sparkSession, store).where("status = 'unknown'").select("batch_id", "seq")
    asked = services.submitted(batches.join(unknown, "batch_id", "left_semi"), lookup)
    return _settled(asked.join(unknown, "batch_id"), batches, store, f"{run}-answers")


def drive(batches: DataFrame, store: str, backend: services.Backend, lookup: services.Backend, run: str, most_attempts: int = 2) -> DataFrame:
    """Send, ask and retry until each batch has succeeded or failed ``most_attempts`` times;
    returns the receipts with their ``attempts``.

    An unknown batch is asked for and never sent again while it is unknown. All batches go
    through a round together, so ``2 * most_attempts + 2`` rounds settle them; a service that
    still leaves one open after these stops the loop, with all receipts stored. Names of
    rounds begin with ``run``, which can't be used twice.
    """
    if not 1 <= most_attempts <= 5:
        raise ValueError("a batch is sent 1 to 5 times")
    spark = batches.sparkSession
    for step in range(2 * most_attempts + 2):
        tries = attempts(spark, store)
        open_ = batches.join(tries, "batch_id", "left").where(F.col("status").isNull() | (F.col("status") == "unknown") | ((F.col("status") == "failed") & (F.col("attempts") < most_attempts)))
        if open_.isEmpty():
            return tries
        if not open_.where("status = 'unknown'").isEmpty():
            recover(batches, store, lookup, f"{run}-{step}-asked")
        send(open_.where("status IS NULL OR status = 'failed'").select(*batches.columns), store, backend, f"{run}-{step}-sent", retry=True)
    raise RuntimeError("batches are still open: the service does not settle them")


def attempts(spark: SparkSession, store: str) -> DataFrame:
    """The latest receipt of each batch with the number of times it was claimed."""
    latest = receipts(spark, store)
    try:
        rows = spark.read.schema(RECEIPTS).option("recursiveFileLookup", "true").parquet(store)
    except Exception as error:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return latest.withColumn("attempts", F.lit(0).cast("long"))
    claims = rows.where((F.col("status") == "unknown") & (F.col("error") == UNANSWERED)).groupBy("batch_id").agg(F.count("*").alias("attempts"))
    return latest.join(claims, "batch_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def _settled(answers: DataFrame, batches: DataFrame, store: str, name: str) -> DataFrame:
    judged = answers.join(batches.select("batch_id", "segment_ids"), "batch_id").withColumn(
        "status", services.outcome(F.col("http_status"), services.reply_items(F.col("body")), F.col("segment_ids"))
    )
    refused = F.coalesce(F.concat(F.lit("HTTP "), F.col("http_status").cast("string")), F.lit("another attempt has begun to send it"))
    error = F.when(F.col("status") != "succeeded", refused)
    return _stored(judged.withColumn("error", error).withColumn("seq", F.col("seq") + 1), store, name)
