"""Documents with equal shingle sets as one node of a graph, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


@dataclass
class SetGroups:
    """``signed`` is a written table of doc_id, n_shingles, set_key (null without words).

    ``nodes``: one row of ``signed`` per set, of its smallest doc_id. ``bridges``: links
    (u, v) between the nodes of ids that have several rows with different sets.
    """

    signed: DataFrame
    full: DataFrame
    reps: DataFrame
    nodes: DataFrame
    bridges: DataFrame

    @classmethod
    def of(cls, signed: DataFrame) -> SetGroups:
        full = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        reps = materialize(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
        several = full.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("z")).where("a <> z").select("doc_id")
        bridges = (
            full.join(several, "doc_id", "left_semi")
            .select("doc_id", "set_key")
            .distinct()
            .join(reps, "set_key")
            .where("doc_id <> rep")
            .select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        )
        nodes = full.join(reps.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
        return cls(signed, full, reps, nodes, bridges)

    def components(self, found: DataFrame) -> DataFrame:
        """``found``: (node, component) of linked nodes. Returns doc_id, n_shingles,
        component_id, kept for each row of ``signed``; a row without words follows the
        rows of its id that have some, a row without id stands alone."""
        labels = self.reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
            "set_key", F.coalesce("component", "rep").alias("component")
        )
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        empty = self.signed.where("set_key IS NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
        filled = self.full.join(empty, "doc_id", "left_semi").join(labels, "set_key").groupBy("doc_id").agg(F.min("component").alias("named"))
        return (
            self.signed.select("doc_id", "n_shingles", "set_key")
            .join(labels, "set_key", "left")
            .join(filled, "doc_id", "left")
            .withColumn("component", F.coalesce("component", "named"))
            .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
        )
