"""One-to-one matching and exact covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Right rows matched to the left row with the same keys.

    A key that several left rows share matches nothing; of several right rows the first
    by ``order`` takes the left one. Both sides are pre-aggregated, so a key that very many
    rows share is a row before anything is sorted or joined.
    """
    single = left.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in left.columns if c not in keys])
    rest = [c for c in right.columns if c not in keys]
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])
    return single.where("__n = 1").drop("__n").join(first, keys)


def unmatched(rows: DataFrame, matched: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(matched, key, "left_anti")


def cover(expected: DataFrame, given: DataFrame, group: list[str], key: str, same: list[str]) -> DataFrame:
    """Whether the given rows cover the expected ones exactly, per group.

    Counts missing, unknown and repeated keys, and rows whose ``same`` columns differ;
    accepted when all four are 0. Keys are counted before the join, so repeats don't
    multiply.
    """
    need = expected.select(*group, key, *same)
    found = given.groupBy(*group, key).agg(F.count("*").alias("__n"), *[F.min(c).alias(f"__{c}") for c in same])
    joined = need.withColumn("__need", F.lit(1)).join(found, [*group, key], "full")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same], F.lit(False))
    both = F.col("__need").isNotNull() & F.col("__n").isNotNull()
    counts = joined.groupBy(*group).agg(
        F.count_if(F.col("__n").isNull()).alias("missing"),
        F.count_if(F.col("__need").isNull()).alias("unknown"),
        F.count_if(F.col("__n") > 1).alias("repeated"),
        F.count_if(both & differs).alias("different"),
    )
    return counts.withColumn("accepted", F.expr("missing + unknown + repeated + different = 0"))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side; empty for equal sets."""
    left = a.select(key).distinct().withColumn("in_a", F.lit(True))
    right = b.select(key).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, key, "full").where("in_a IS NULL OR in_b IS NULL").select(key, F.when(F.col("in_a"), "a").otherwise("b").alias("side"))


def replaced(rows: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``updates`` (same columns) in place of the ones of their key. An
    update for a key that isn't there stops the query; so does a repeated one."""
    rest = [c for c in rows.columns if c != key]
    one = F.when(F.count("*") == 1, F.first(F.struct(*rest))).otherwise(F.raise_error(F.concat(F.lit("updated twice: "), F.col(key).cast("string"))))
    new = updates.groupBy(key).agg(one.alias("__new"))
    joined = rows.select(key, F.struct(*rest).alias("__old")).join(new, key, "full")
    absent = F.raise_error(F.concat(F.lit("nothing to update: "), F.col(key).cast("string")))
    held = F.when(F.col("__old").isNull(), absent).otherwise(F.coalesce("__new", "__old"))
    return joined.select(key, held.alias("__held")).select(key, *[F.col("__held")[c].alias(c) for c in rest]).select(*rows.columns)


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots."""
    joined = before.select(key, F.col(value).alias("__old")).join(after.select(key, F.col(value).alias("__new")), key, "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed")
    return joined.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(key, change.alias("change"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def stable_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place where each came first."""
    return df.groupBy(key).agg(F.min(order).alias("first_at"))


def _above(path: Column) -> Column:
    """The folders above a path, from the outermost in."""
    parts = F.split(path, "/", -1)
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def contained(paths: DataFrame, roots: DataFrame, group: str, path: str, root: str) -> DataFrame:
    """Pairs (group, path, root) of which one is the other or lies below it. Both sides
    are given once; each name is joined with the folders above the other, by equality, so a
    group of very many paths isn't paired with all its roots."""
    below = paths.select(group, path, F.explode(F.concat(_above(F.col(path)), F.array(path))).alias(root)).join(roots, [group, root])
    above = roots.select(group, root, F.explode(_above(F.col(root))).alias(path)).join(paths, [group, path])
    return below.select(group, path, root).unionByName(above.select(group, path, root))
