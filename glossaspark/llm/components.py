"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, salted_join


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new edges, and the written table that they read."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(
        both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.expr("v > u")).alias("n")).where("n > 0").select("u", F.least("u", "m").alias("m"), "n"),
        "least",
    )
    return salted_join(both.where("v > u"), least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As above."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    rest = salted_join(down, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: pairs (u, v) of integer ids. Returns (node, component) for every
    node with an edge to another one; component is the smallest id reachable.

    Self-loops, repeated edges and null ids are ignored. Each round is written to
    the shared folder; minima are pre-aggregated and the edges of a node with very
    many of them are dealt over several tasks.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = mark(current)
    while before[0]:
        larger, read = _large_star(current)
        smaller, read_too = _small_star(larger)
        after = materialize(smaller, "edges")
        drop_scratch(current, read, read_too)
        current, now = after, mark(after)
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
