"""Idempotent inserts and compare-and-set over keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_outcome(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """insert for a new key, same for an equal payload, conflict for another one."""
    old = existing.select(key, F.col(payload).alias("__old"), F.lit(True).alias("__known"))
    outcome = F.when(F.col("__known").isNull(), "insert").when(F.col("__old").eqNullSafe(F.col(payload)), "same").otherwise("conflict")
    return incoming.join(old, key, "left").withColumn("outcome", outcome).drop("__old", "__known")


def upserted(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """The rows to append; a conflict stops the query where they are used."""
    outcome = upsert_outcome(existing, incoming, key, payload)
    check = F.when(F.col("outcome") == "conflict", F.raise_error(F.concat(F.lit("another payload is stored for "), F.col(key).cast("string")))).otherwise(F.col("outcome"))
    return outcome.withColumn("outcome", check).where("outcome = 'insert'").drop("outcome")


def compare_and_set(
    current: DataFrame, attempts: DataFrame, key: str, value: str, expected: str, order: str, allowed: Callable[[Column, Column, Column], Column] | None = None
) -> DataFrame:
    """Outcome of setting ``value`` where the stored one must be ``expected``: committed,
    stale, missing, or refused by ``allowed`` (a predicate of before, after and attempt).

    The attempts of a call are made by ``order``, equal ones by a hash of their value, so
    that a tie has one winner. The first allowed one that changes the
    value of a key wins; what comes after it expected a value that is no longer stored
    and is stale. Winners are found by pre-aggregation, so a key that very many
    attempts want makes no large task. :func:`committed` gives the store after them.
    """
    stored = current.select(key, F.col(value).alias("__stored"), F.lit(True).alias("__known"))
    may = allowed(F.col("__stored"), F.col(value), F.col(order)) if allowed else F.lit(True)
    outcome = (
        F.when(F.col("__known").isNull(), "missing")
        .when(~F.col("__stored").eqNullSafe(F.col(expected)), "stale")
        .when(~may, "refused")
        .otherwise("committed")
    )
    judged = attempts.join(stored, key, "left").withColumn("outcome", outcome)
    changes = (F.col("outcome") == "committed") & ~F.col("__stored").eqNullSafe(F.col(value))
    first = judged.where(changes).groupBy(key).agg(F.min(_place(order, value)).alias("__winner"))
    late = (F.col("outcome") != "missing") & (_place(order, value) > F.col("__winner"))
    return judged.join(first, key, "left").withColumn("outcome", F.when(late, "stale").otherwise(F.col("outcome"))).drop("__stored", "__known", "__winner")


def _place(order: str, value: str) -> Column:
    """Place of an attempt among those of its key."""
    return F.struct(F.col(order), F.xxhash64(value))


def committed(current: DataFrame, outcomes: DataFrame, key: str, value: str, order: str, version: str) -> DataFrame:
    """The store after :func:`compare_and_set`: winners take the place of the rows they
    expected, with the next ``version``; equal writes keep theirs."""
    won = outcomes.where("outcome = 'committed'").groupBy(key).agg(F.max_by(value, _place(order, value)).alias("__new"), F.lit(True).alias("__set"))
    changed = F.col("__set").isNotNull() & ~F.col("__new").eqNullSafe(F.col(value))
    return (
        current.join(won, key, "left")
        .withColumn(version, F.col(version) + changed.cast("int"))
        .withColumn(value, F.when(changed, F.col("__new")).otherwise(F.col(value)))
        .drop("__new", "__set")
    )


def check_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, if it has exactly these columns in this order."""
    if df.columns != list(columns):
        raise ValueError(f"a store of the columns {', '.join(columns)} was expected, not {', '.join(df.columns)}")
    return df
