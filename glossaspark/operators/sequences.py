"""Order, spans and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def exceeds(rows: DataFrame, limit: int) -> bool:
    """Whether there are more than ``limit`` rows. The scan takes partitions a few at a time and ends at the first
    row beyond the limit; ``limit`` + 1 empty rows at most reach the driver."""
    return len(rows.select(F.lit(1)).take(limit + 1)) > limit


def with_ordinal(df: DataFrame, key: str, alias: str = "ordinal", pieces: int = 64) -> DataFrame:
    """Number rows from 0 by an ordered key, without one task for all of them.

    Quantiles of the key cut the rows into ranges; counts of the ranges give each its
    first number, and rows are numbered inside their range. The quantiles only balance
    the ranges: any cuts give the same numbers. Ties of the key are numbered in an
    unspecified order; null keys come last.
    """
    cuts = df.agg(F.percentile_approx(key, [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or []
    piece = F.when(F.col(key).isNull(), len(cuts)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key)))) if cuts else F.lit(0)
    parted = df.withColumn("__piece", piece)
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        parted.groupBy("__piece")
        .agg(F.count("*").alias("__n"))
        .select("__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    )
    inside = Window.partitionBy("__piece").orderBy(F.col(key).asc_nulls_last())
    return (
        parted.withColumn("__row", F.row_number().over(inside) - 1)
        .join(F.broadcast(firsts), "__piece")  # at most one row for each piece
        .withColumn(alias, (F.col("__row") + F.col("__first")).cast("long"))
        .drop("__piece", "__row", "__first")
    )


def occurrences(df: DataFrame, keys: list[str], order: str, alias: str = "occurrence") -> DataFrame:
    """Place of a row among the rows with equal keys, from 0."""
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def overlaps(df: DataFrame, group: str, start: str, size: str) -> DataFrame:
    """Extents with ``overlaps``: the extent starts before an earlier one of its group,
    by (start, size), ends."""
    order = Window.partitionBy(group).orderBy(start, size)
    prior = F.max(F.col(start) + F.col(size)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("overlaps", F.coalesce(F.col(start) < prior, F.lit(False)))


def lagged(df: DataFrame, group: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with the values of the row before in its group, by alias, and ``__first`` for
    the first row. Ranges are sorted apart, and one begins with the last row of the range before it."""
    parted = in_ranges(df, [group, *order])
    held = F.struct(*[F.col(v).alias(a) for a, v in values.items()])
    inside = Window.partitionBy(group, "__piece").orderBy(*order)
    ends = parted.groupBy(group, "__piece").agg(F.max_by(held, F.struct(*order)).alias("__end"))
    start = ends.select(F.col(group).alias("__group"), F.col("__piece").alias("__at"), F.lag("__end").over(Window.partitionBy(group).orderBy("__piece")).alias("__start"))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__piece") == F.col("__at"))
    last = F.coalesce(F.lag(held).over(inside), "__start")
    found = parted.join(start, same).withColumn("__last", last)
    return found.withColumns({a: F.col(f"__last.{a}") for a in values} | {"__first": F.col("__last").isNull()}).drop("__piece", "__group", "__at", "__start", "__last")


def change_points(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row is one."""
    rows = lagged(df, group, order, {"__before": value})
    return rows.where(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__first", "__before")


def carried(df: DataFrame, group: str, order: str, value: Column, alias: str) -> DataFrame:
    """The last value that isn't null, up to each row. Ranges are filled apart, and one
    begins with what the ranges before it end with."""
    parted = in_ranges(df.withColumn("__value", value), [group, order])
    so_far = Window.partitionBy(group, "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parted.groupBy(group, "__piece").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(order))).alias("__end"))
    earlier = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select(F.col(group).alias("__group"), F.col("__piece").alias("__at"), F.last("__end", ignorenulls=True).over(earlier).alias("__start"))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__piece") == F.col("__at"))
    filled = F.coalesce(F.last("__value", ignorenulls=True).over(so_far), "__start")
    return parted.join(start, same).withColumn(alias, filled).drop("__value", "__piece", "__group", "__at", "__start")


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def stable_runs(df: DataFrame, group: str, order: list[str], time: str, good: Column, least_seconds: float) -> DataFrame:
    """Runs of consecutive rows that satisfy ``good`` and last ``least_seconds`` or more:
    (group, run_start, run_end, n). A row that fails ends a run."""
    numbered = running_sum(df, [group], order, F.when(good, 0).otherwise(1), "__run")
    runs = numbered.where(good).groupBy(group, "__run").agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count("*").alias("n"))
    long_enough = _micros("run_end") - _micros("run_start") >= int(least_seconds * 1_000_000)
    return runs.where(long_enough).drop("__run")


def in_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``__piece``, which rises with the keys: sampled ranges of them, so a
    group with very many rows has several. Written, since ranges are drawn anew in each
    run. Rows alike in all keys are in one piece."""
    return written(df.repartitionByRange(*keys).withColumn("__piece", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, alias: str) -> DataFrame:
    """Sum of ``value`` over the rows of a group up to each one, in order. Ranges are
    summed apart and start where the earlier ones end: no group is sorted in one task."""
    parted = in_ranges(df.withColumn("__value", value), [*group, *order])
    keys = [*group, "__piece"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        parted.groupBy(*keys)
        .agg(F.sum("__value").alias("__n"))
        .select(*[F.col(k).alias(f"{k}__") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys])
    return (
        parted.withColumn("__sum", F.sum("__value").over(inside))
        .join(firsts, same)
        .withColumn(alias, F.col("__first") + F.col("__sum"))
        .drop("__value", "__sum", "__piece", "__first", *[f"{k}__" for k in keys])
    )


def positions(df: DataFrame, group: list[str], order: list[str], alias: str = "position") -> DataFrame:
    """Place of each row in its group, from 1, for keys of any type."""
    return running_sum(df, group, order, F.lit(1).cast("long"), alias)


def within_budget(df: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Running sum of sizes in order, and whether it is still inside the budget."""
    return running_sum(df, [group], order, size, "total").withColumn("fits", F.col("total") <= budget)
