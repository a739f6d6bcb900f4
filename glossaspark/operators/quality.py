"""Deterministic checks of finished translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.unicode import same_nfc


def assessed(pairs: DataFrame, source: str = "source_text", target: str = "target_text") -> DataFrame:
    """``outcome`` and ``codes``: low confidence where the text is unchanged after
    Unicode normalisation. Texts that are equal as they are, and texts that normalisation
    can't change, stay in the JVM."""
    same = F.coalesce(same_nfc(F.col(source), F.col(target)), F.lit(False))
    return pairs.withColumn("outcome", F.when(same, "low_confidence").otherwise("clear")).withColumn(
        "codes", F.when(same, F.array(F.lit("source_text_unchanged"))).otherwise(F.array().cast("array<string>"))
    )


PROPOSAL = ("batch_id", "protected_tokens", "schema_version", "segment_id", "source_schema_version", "source_sha256", "target_language", "target_text", "task_id")


def proposal_id(at: str = "") -> Column:
    """Identity of a proposal from all its fields, in columns that begin with ``at``."""
    return identity.digest("proposal", identity.canonical_json(F.struct(*[F.col(at + c).alias(c) for c in PROPOSAL])))


def coverage(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """(segment_id, n, error): whether the translations cover the segments exactly and
    belong to them. ``segments`` hold all fields of a proposal but its text,
    ``translations`` segment_id, task_id, batch_id, source_sha256, target_language,
    target_text and proposal_id. The error is the first of missing, unknown, repeated,
    the field that differs, and proposal_id where the identity, computed again from the
    segment and the text, is another one; null where all is well. Translations are
    counted before the join, so repeats don't multiply.
    """
    fields = ("task_id", "batch_id", "source_sha256", "target_language")
    given = translations.groupBy("segment_id").agg(
        F.count("*").alias("n"), *[F.min(c).alias(f"t_{c}") for c in (*fields, "target_text", "proposal_id")]
    )
    joined = segments.withColumn("known", F.lit(True)).join(given, "segment_id", "full").withColumn("target_text", F.col("t_target_text"))
    error = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    for c in fields:
        error = error.when(~F.col(c).eqNullSafe(F.col(f"t_{c}")), c)
    error = error.when(~F.col("t_proposal_id").eqNullSafe(proposal_id()), "proposal_id")
    return joined.select("segment_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), error.alias("error"))


def summary(results: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Outcome of a task and its segments of low confidence in order."""
    low = F.col("outcome") == "low_confidence"
    pair = F.struct(F.col(order).alias("at"), F.col(key).alias("key"))
    ids = F.transform(F.array_sort(F.collect_list(F.when(low, pair))), lambda r: r["key"])
    return results.groupBy(group).agg(
        F.when(F.bool_or(low), "low_confidence").otherwise("clear").alias("outcome"), F.count("*").alias("n"), ids.alias("low_confidence_ids")
    )
