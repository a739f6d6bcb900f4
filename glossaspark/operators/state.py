"""Task, batch and request states: moves as data, replays and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domains import BATCH_MOVES, TASK_MOVES
from .sequences import in_ranges


def move_allowed(moves: dict[str, tuple[str, ...]], before: Column, after: Column) -> Column:
    pairs = [F.lit(f"{a}>{b}") for a, to in moves.items() for b in to]
    return F.array_contains(F.array(*pairs), F.concat(before, F.lit(">"), after))


def task_move_allowed(before: Column, after: Column) -> Column:
    return move_allowed(TASK_MOVES, before, after)


def batch_move_allowed(before: Column, after: Column) -> Column:
    return move_allowed(BATCH_MOVES, before, after)


def attempts_agree(before: Column, after: Column, attempts_before: Column, attempts_after: Column) -> Column:
    """A move from pending to running is one attempt more, any other none."""
    starts = ((before == "pending") & (after == "running")).cast("int")
    return attempts_after == attempts_before + starts


def receipt_move_allowed(before: Column, after: Column, retry: Column) -> Column:
    """Whether a receipt may replace another; both are structs of all their fields, with
    ``status`` and ``reference`` among them. Nothing but the same receipt follows
    success or failure, except that a retry makes a failure unknown; requests in flight
    and unknown ones go anywhere. A provider's reference, once known, stays."""
    moves = (
        before.eqNullSafe(after)
        | before["status"].isin("in_flight", "unknown")
        | ((before["status"] == "failed") & (after["status"] == "unknown") & retry)
    )
    return F.coalesce(moves & (before["reference"].isNull() | before["reference"].eqNullSafe(after["reference"])), F.lit(False))


def receipt_consistent(status: Column, n_proposals: Column, reference: Column, error: Column) -> Column:
    """Success has proposals and no error; a request in flight a reference and no error;
    the others an error of at most 1000 characters; only success has proposals."""
    return F.coalesce(
        F.when(status == "succeeded", (n_proposals > 0) & error.isNull())
        .when(n_proposals > 0, False)
        .when(status == "in_flight", reference.isNotNull() & error.isNull())
        .when(status.isin("failed", "unknown"), F.coalesce(F.length(error).between(1, 1000), F.lit(False))),
        F.lit(False),
    )


def replayed(events: DataFrame, key: str, order: list[str], wanted: str, start: str, moves: dict[str, tuple[str, ...]], salt_rows: int = 0) -> DataFrame:
    """Final state of each key when its events ask for states in order and moves that
    aren't allowed are ignored: (key, state, applied, ignored).

    The moves are composed as functions: each event is a map from state to state, and
    the map of a run of events has as many entries as there are states. With
    ``salt_rows``, ranges of events (:func:`sequences.in_ranges`) are numbered apart,
    runs of that many events folded, and their maps combined: the last step holds one
    map for each run of a key. With 0 a key is folded as a whole.
    """
    states = sorted(moves)
    ordered = events.select(key, F.struct(*order).alias("__at"), wanted)
    if salt_rows:
        number = F.row_number().over(Window.partitionBy(key, "__piece").orderBy("__at"))
        run_of = F.struct(F.col("__piece").alias("piece"), F.floor(number / salt_rows).alias("run"))
        ordered = in_ranges(ordered, [key, "__at"]).withColumn("__part", run_of).drop("__piece")
    else:
        ordered = ordered.withColumn("__part", F.lit(0))
    ok = F.array(*[F.lit(f"{a}>{b}") for a, to in moves.items() for b in to])
    asked = F.transform(F.array_sort(F.collect_list(F.struct("__at", wanted))), lambda r: r[wanted])
    parts = ordered.groupBy(key, "__part").agg(asked.alias("__asked"))

    def run(state: Column, asked: Column) -> Column:
        zero = F.struct(state.alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("ignored"))

        def step(s: Column, w: Column) -> Column:
            moved = F.array_contains(ok, F.concat(s["state"], F.lit(">"), w))
            return F.struct(
                F.when(moved, w).otherwise(s["state"]).alias("state"),
                (s["applied"] + moved.cast("long")).alias("applied"),
                (s["ignored"] + (~moved).cast("long")).alias("ignored"),
            )

        return F.aggregate(asked, zero, step)

    if not salt_rows:
        return parts.select(key, run(F.lit(start), F.col("__asked")).alias("s")).select(key, "s.state", "s.applied", "s.ignored")
    maps = parts.select(key, "__part", F.map_from_entries(F.array(*[F.struct(F.lit(x), run(F.lit(x), F.col("__asked"))) for x in states])).alias("__map"))
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("ignored"))
    step = lambda s, m: F.struct(
        m[s["state"]]["state"].alias("state"),
        (s["applied"] + m[s["state"]]["applied"]).alias("applied"),
        (s["ignored"] + m[s["state"]]["ignored"]).alias("ignored"),
    )
    ordered_maps = F.transform(F.array_sort(F.collect_list(F.struct("__part", F.map_entries("__map").alias("m"))), lambda a, b: F.when(a["__part"] < b["__part"], -1).otherwise(1)), lambda x: F.map_from_entries(x["m"]))
    return maps.groupBy(key).agg(F.aggregate(ordered_maps, zero, step).alias("s")).select(key, "s.state", "s.applied", "s.ignored")


def task_rollup(batches: DataFrame, key: str, status: str) -> DataFrame:
    """Counts of a task's batches, and the status they imply."""
    counts = batches.groupBy(key).agg(
        F.count("*").alias("n_batches"),
        F.count_if(F.col(status) == "completed").alias("n_completed"),
        F.bool_and(F.col(status) == "completed").alias("all_completed"),
        F.bool_or(F.col(status) == "failed").alias("any_failed"),
        F.bool_or(F.col(status) == "running").alias("any_running"),
    )
    implied = F.when(F.col("all_completed"), "completed").when(F.col("any_failed"), "failed").when(F.col("any_running"), "running").otherwise("pending")
    return counts.withColumn("implied_status", implied)


def resume_action(status: Column) -> Column:
    """What resuming does: a failed task gets its failed batch back to pending, a paused
    one runs again; a running or pending one stays; a completed one refuses."""
    return F.when(status == "failed", "retry_failed_batch").when(status == "paused", "run").when(status == "completed", "refuse").otherwise("none")


def recovery_action(batch_status: Column, cached: Column, receipt: Column) -> Column:
    """After a crash: a running batch with cached results is completed, one without a
    receipt goes back to pending, a terminal receipt is applied, any other is asked for."""
    return (
        F.when(batch_status != "running", "none")
        .when(cached, "complete_from_cache")
        .when(receipt.isNull(), "back_to_pending")
        .when(receipt.isin("succeeded", "failed"), "apply_receipt")
        .otherwise("query_provider")
    )


def retry_eligible(receipt: Column, attempts: Column, most: int = 2) -> Column:
    """Only a definite failure is tried again; an unknown outcome never."""
    return F.coalesce((receipt == "failed") & (attempts < most), F.lit(False))


def next_batch(batches: DataFrame, key: str, index: str, status: str) -> DataFrame:
    """First batch of each task in state pending, running or failed."""
    first = [F.min(F.when(F.col(status) == s, F.col(index))).alias(f"first_{s}") for s in ("pending", "running", "failed")]
    return batches.groupBy(key).agg(*first)


def batch_error(status: Column, attempts: Column, proposals: Column, segments: Column, error: Column) -> Column:
    """The first rule that a stored batch breaks, or null."""
    return (
        F.when((status == "completed") & (proposals != segments), "completed_count")
        .when((status != "completed") & (proposals > 0), "early_proposals")
        .when((status == "running") & (attempts < 1), "running_without_attempt")
        .when((status == "failed") & (F.coalesce(error, F.lit("")) == ""), "failed_without_error")
    )


def checkpoint_errors(tasks: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """(key, error) of stored tasks (key, status) with their batches (key, batch_index, status,
    attempts, proposals, segments, error): the error of the first batch that has one, else
    the first rule that task and batches break together; null for a good one.

    A task is completed when all its batches are, and only then; failed when one is, and only
    then; a paused one has no running batch, a pending one only pending batches without attempts.
    Batches are pre-aggregated, so a task of very many is a row before the join.
    """
    wrong = batch_error(F.col("status"), F.col("attempts"), F.col("proposals"), F.col("segments"), F.col("error"))
    some = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    is_ = lambda s: F.col("status") == s
    facts = batches.withColumn("__wrong", wrong).groupBy(key).agg(
        F.min(F.when(F.col("__wrong").isNotNull(), F.struct("batch_index", "__wrong")))["__wrong"].alias("__batch"),
        some(~is_("completed")).alias("__open"),
        some(is_("failed")).alias("__failed"),
        some(is_("running")).alias("__running"),
        some(~is_("pending") | (F.col("attempts") != 0)).alias("__begun"),
    )
    fact = lambda name: F.coalesce(F.col(name), F.lit(False))
    error = (
        F.when(F.col("__batch").isNotNull(), F.col("__batch"))
        .when(is_("completed") & fact("__open"), "completed_with_open_batches")
        .when(~is_("completed") & ~fact("__open"), "all_batches_completed")
        .when(is_("failed") & ~fact("__failed"), "failed_without_failed_batch")
        .when(~is_("failed") & fact("__failed"), "failed_batch")
        .when(is_("paused") & fact("__running"), "paused_with_running_batch")
        .when(is_("pending") & fact("__begun"), "pending_but_begun")
    )
    return tasks.join(facts, key, "left").select(key, error.alias("error"))
