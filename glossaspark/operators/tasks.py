"""Translation tasks: requests, batches, identities and the check of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from .sequences import with_ordinal

REQUEST = ("engine", "kind", "protected_tokens", "scene", "segment_id", "source_schema_version", "source_sha256", "source_text", "speaker", "speaker_display")


def requests(segments: DataFrame) -> DataFrame:
    """What leaves the project: no file, encoding, line or token offsets. ``error`` names
    the first rule a segment breaks."""
    error = (
        F.when(F.col("schema_version") != 1, "schema_version")
        .when(~F.col("source_sha256").rlike(r"^[0-9a-f]{64}\z"), "source_sha256")
        .when(~text.spans_fit(F.col("source_text"), F.col("protected_tokens")), "protected_tokens")
        .when(F.length("source_text") == 0, "source_text")
    )
    return segments.select(
        F.col("id").alias("segment_id"),
        F.col("schema_version").alias("source_schema_version"),
        "engine",
        "source_sha256",
        "kind",
        "scene",
        "speaker",
        "speaker_display",
        "source_text",
        text.token_references(F.col("protected_tokens")).alias("protected_tokens"),
        error.alias("error"),
    )


def request_json(row: str = "") -> Column:
    """Canonical JSON of a request."""
    at = f"{row}." if row else ""
    token = lambda t: F.struct(t["index"].alias("index"), t["kind"].alias("kind"), t["value"].alias("value"))
    fields = [F.transform(at + c, token).alias(c) if c == "protected_tokens" else F.col(at + c).alias(c) for c in REQUEST]
    return identity.canonical_json(F.struct(*fields))


def batch_index(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    return df.withColumn("batch_index", F.floor(F.col(ordinal) / size).cast("long"))


def task_batches(rows: DataFrame, group: list[str], key: str, order: str, size: int) -> DataFrame:
    """Batches of ``size`` segments per task in order, with their ids: a digest of the
    task, the index and the ordered segment ids. A group holds one batch."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    indexed = rows.withColumn("batch_index", F.floor(number / size).cast("long"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda r: r[key])
    task = F.concat_ws("/", *[F.col(g).cast("string") for g in group])
    payload = F.struct(F.col("batch_index").alias("index"), F.col("segment_ids"), task.alias("task_id"))
    return (
        indexed.groupBy(*group, "batch_index")
        .agg(ids.alias("segment_ids"))
        .withColumn("batch_id", identity.digest("batch", identity.canonical_json(payload)))
    )


def global_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Batch index over one ordered table of any size."""
    return batch_index(with_ordinal(df, order), "ordinal", size)


def proposal_error(expected_engine: str) -> Column:
    """First rule a proposal breaks, null when accepted. Columns of the proposal are
    prefixed ``p_``, those of the joined segment ``s_`` (null where there is none). A
    field that is null breaks its rule."""
    return (
        F.when(~F.col("p_schema_version").eqNullSafe(1), "schema_version")
        .when(F.col("s_task_id").isNull(), "task_id")
        .when(F.col("s_batch_id").isNull(), "batch_id")
        .when(F.col("s_segment_id").isNull(), "segment_id")
        .when(~F.col("s_engine").eqNullSafe(expected_engine), "engine")
        .when(~F.col("p_source_schema_version").eqNullSafe(F.col("s_source_schema_version")), "source_schema_version")
        .when(~F.col("p_source_sha256").eqNullSafe(F.col("s_source_sha256")), "source_sha256")
        .when(~F.col("p_target_language").eqNullSafe(F.col("s_target_language")), "target_language")
        .when(~F.col("p_protected_tokens").eqNullSafe(F.col("s_protected_tokens")), "protected_tokens")
        .when(F.col("p_target_text").isNull() | ~text.token_references(text.tokens(F.col("p_target_text"))).eqNullSafe(F.col("s_protected_tokens")), "target_tokens")
    )


def validated(proposals: DataFrame, segments: DataFrame, expected_engine: str = "renpy") -> DataFrame:
    """Proposals with ``error_code``, null when accepted. The code of a proposal without
    its segment names the first of task, batch and segment that is unknown.

    The segment is looked up first, and with it all rules but these three are decided, so
    whole rows are shuffled once. Digests make most of a row and don't compress: they are
    shuffled as bytes, not as hex digits.
    """
    digest = "source_sha256"
    small = lambda df: df.withColumn(digest, identity.packed(F.col(digest)))
    p = small(proposals).select(*[F.col(c).alias(f"p_{c}") for c in proposals.columns])
    details = small(segments).select(*[
        F.col(c).alias(f"s_{c}")
        for c in ("task_id", "batch_id", "segment_id", "engine", "source_schema_version", "source_sha256", "target_language", "protected_tokens")
    ])
    keys = [F.col(f"p_{c}") == F.col(f"s_{c}") for c in ("task_id", "batch_id", "segment_id")]
    # without a segment the first rule that breaks, but for the version, is the task's
    judged = p.join(details, keys, "left").withColumn("code", proposal_error(expected_engine)).select(*p.columns, "code")
    batches = segments.select(F.col("task_id").alias("b_task"), F.col("batch_id").alias("b_batch")).distinct()
    tasks = segments.select(F.col("task_id").alias("t_task")).distinct()
    unknown = F.when(F.col("t_task").isNull(), "task_id").when(F.col("b_batch").isNull(), "batch_id").otherwise("segment_id")
    return (
        judged.join(batches, [F.col("p_task_id") == F.col("b_task"), F.col("p_batch_id") == F.col("b_batch")], "left")
        .join(tasks, F.col("p_task_id") == F.col("t_task"), "left")
        .withColumn("error_code", F.when(F.col("code") == "task_id", unknown).otherwise(F.col("code")))
        .select(*[(identity.unpacked(F.col(f"p_{c}")) if c == digest else F.col(f"p_{c}")).alias(c) for c in proposals.columns], "error_code")
    )
