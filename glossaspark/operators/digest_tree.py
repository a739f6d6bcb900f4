"""Snapshots of files with digests by branch, so that a comparison reads what has changed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matching


def folder_of(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def store(files: DataFrame, place: str, branches: int = 256) -> None:
    """Write a snapshot of files (path, digest) below ``place``, once.

    A folder belongs to one of ``branches``; a branch's files are one part of the table, and its
    digest is the sum of 64-bit hashes of its files, two of them, with their number: it needs no order
    and is added up before the shuffle, so a folder of any size is no group of one task. Repeated paths are
    files each; null paths are refused.
    """
    known = F.coalesce("path", F.raise_error(F.lit("a file without a path")).cast("string"))
    rows = files.select(known.alias("path"), F.col("digest").cast("string").alias("digest")).withColumn(
        "branch", F.pmod(F.xxhash64(F.lit(branches), folder_of(F.col("path"))), F.lit(branches)).cast("int")
    )
    rows.hint("rebalance", "branch").write.partitionBy("branch").parquet(f"{place}/files")
    held = files.sparkSession.read.schema(rows.schema).parquet(f"{place}/files")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "path", "digest").cast("decimal(38,0)"))
    sums = held.groupBy("branch").agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b"))
    sums.withColumn("branches", F.lit(branches)).write.parquet(f"{place}/sums")


def changed_branches(spark: SparkSession, before: str, after: str) -> list[int]:
    """Branches whose digests differ: at most as many as a snapshot has."""
    old, new = (spark.read.parquet(f"{place}/sums") for place in (before, after))
    kinds = {r["branches"] for r in old.select("branches").union(new.select("branches")).distinct().collect()}
    if len(kinds) > 1:
        raise ValueError(f"snapshots of different numbers of branches: {sorted(kinds)}")
    whole = F.struct("n", "a", "b")
    joined = old.select("branch", whole.alias("old")).join(new.select("branch", whole.alias("new")), "branch", "full")
    return sorted(r["branch"] for r in joined.where("NOT (old <=> new)").select("branch").collect())


def changes(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(path, change) with added, removed or changed between two snapshots: the rows of
    :func:`matching.changed` over all files, of which only changed branches are read."""
    branches = changed_branches(spark, before, after)
    held = [spark.read.schema("path string, digest string, branch int").parquet(f"{p}/files").where(F.col("branch").isin(branches)) for p in (before, after)]
    return matching.changed(*held, "path", "digest")
