"""The data path of a localization run: scripts to segments, official templates, tasks,
replies, checks and files. Each step is a DataFrame on the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import matching, quality, render, tasks
from ..operators.sequences import positions
from ..sources import scripts, services, templates
from ..sources.projects import by_parts
from ..sources.projects import scripts as script_files


def extracted(spark: SparkSession, project: str) -> DataFrame:
    """Segments of a project."""
    return scripts.segments(scripts.rows(script_files(spark, project)))


def mapped(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """Segments with their template entry: equal file, line, kind and text, and only one
    segment of these; the first entry in order takes it."""
    left = segments.select(
        F.replace("source_file", F.lit("\\"), F.lit("/")).alias("source_file"), "line_number", "kind", "source_text", F.col("id").alias("segment_id"), "protected_tokens"
    )
    right = entries.withColumn("place", F.struct(by_parts(F.col("template_file")).alias("parts"), "ordinal"))
    return matching.unique_match(left, right, ["source_file", "line_number", "kind", "source_text"], "place")


def crosschecked(segments: DataFrame, entries: DataFrame, found: DataFrame) -> DataFrame:
    """One row: counts by kind on both sides, what has no partner, and whether all match."""
    choice = (F.col("kind") == "menu_choice").cast("int")
    side = lambda df, name, extra: df.select(F.lit(name).alias("side"), extra.alias("choice"))
    rows = side(segments, "ours", choice).unionByName(side(entries, "theirs", choice)).unionByName(side(found, "pairs", F.lit(0)))
    count = lambda name: F.count_if(F.col("side") == name)
    choices = lambda name: F.count_if((F.col("side") == name) & (F.col("choice") == 1))
    one = rows.agg(
        count("ours").alias("segments"),
        choices("ours").alias("choices"),
        count("theirs").alias("entries"),
        choices("theirs").alias("official_choices"),
        count("pairs").alias("mapped"),
    )
    return one.withColumn("matches", F.expr("segments = entries AND choices = official_choices AND mapped = segments"))


def task(segments: DataFrame, source_language: str, target_language: str, batch_size: int = 8) -> DataFrame:
    """Requests of one task with batch index and ids. The task's id covers its whole
    ordered list of requests, by the tree digest, so the list may be long."""
    if source_language == target_language or batch_size < 1:
        raise ValueError("a task needs two languages and batches of at least one segment")
    keyed = segments.withColumn("__order", F.struct(by_parts(F.col("source_file")).alias("parts"), "line_number"))
    placed = positions(keyed, [], ["__order"], "ordinal").withColumn("ordinal", F.col("ordinal") - 1).drop("__order")
    listed = tasks.requests(placed).join(placed.select(F.col("id").alias("segment_id"), "ordinal"), "segment_id")
    wrong = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("segment_id", F.lit(": "), "error"))).otherwise(F.col("ordinal"))
    rows = listed.withColumn("ordinal", wrong.cast("long")).withColumn("json", tasks.request_json()).withColumn("one", F.lit(1))
    head = F.lit(f"{source_language}>{target_language}/{batch_size}/")
    whole = identity.tree_digest(rows.withColumn("json", F.concat(head, "json")), ["one"], "ordinal", "json", "task", "task_id")
    batched = tasks.batch_index(rows, "ordinal", batch_size).join(whole, "one").drop("one", "json", "error")
    ids = tasks.task_batches(batched.select("task_id", "segment_id", "ordinal"), ["task_id"], "segment_id", "ordinal", batch_size)
    return (
        batched.join(ids.select("task_id", "batch_index", "batch_id"), ["task_id", "batch_index"])
        .withColumn("source_language", F.lit(source_language))
        .withColumn("target_language", F.lit(target_language))
    )


def replies(requests: DataFrame, backend: services.Backend) -> tuple[DataFrame, DataFrame]:
    """Receipts (batch_id, status) and proposals of a task's batches."""
    segment = F.struct("ordinal", "segment_id", "source_text", "kind", "speaker")
    batches = requests.groupBy("task_id", "batch_id", "source_language", "target_language").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    payload = identity.canonical_json(F.struct("segments", "source_language", "target_language"))
    sent = services.submitted(batches.select("batch_id", payload.alias("payload")), backend).select("batch_id", "http_status", "body")
    parsed = batches.join(sent, "batch_id").withColumn("items", services.reply_items(F.col("body")))
    wanted = F.transform("segments", lambda s: s["segment_id"])
    judged = parsed.withColumn("status", services.outcome(F.col("http_status"), F.col("items"), wanted))
    items = judged.where("status = 'succeeded'").select("task_id", "batch_id", F.explode("items").alias("i"))
    details = requests.select("task_id", "batch_id", F.col("segment_id").alias("id"), "source_schema_version", "source_sha256", "target_language", "protected_tokens")
    proposals = items.select("task_id", "batch_id", F.col("i.segment_id").alias("id"), F.col("i.target_text").alias("target_text")).join(details, ["task_id", "batch_id", "id"])
    return judged.select("batch_id", "status"), proposals.withColumnRenamed("id", "segment_id").withColumn("schema_version", F.lit(1))


def checked(requests: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals with ``error_code``, and the quality outcome of the accepted ones."""
    valid = tasks.validated(proposals, requests.select("task_id", "batch_id", "segment_id", "engine", "source_schema_version", "source_sha256", "target_language", "protected_tokens"))
    texts = requests.select("segment_id", "source_text", "ordinal")
    return quality.assessed(valid.join(texts, "segment_id"))


def rendered(mappings: DataFrame, accepted: DataFrame, language: str) -> DataFrame:
    """Files of a language from mappings and accepted translations."""
    c = F.col
    rows = mappings.join(accepted.select("segment_id", "target_text", c("ordinal").alias("task_ordinal")), "segment_id")
    stands = render.literal_stands(scripts.string_literals(c("source_code")), c("literal_start"), c("literal_end"), c("source_text"))
    safe = stands & render.fits_literal(c("target_text"), F.substring("source_code", c("literal_start") + 1, F.lit(1))) & render.tokens_kept(c("source_text"), c("target_text"))
    content = render.fragment(c("kind"), c("source_file"), c("line_number"), c("source_code"), c("literal_start"), c("literal_end"), c("target_text"), F.lit(language), c("translation_identifier"))
    fragments = rows.select(
        "template_file",
        "segment_id",
        (c("kind") == "menu_choice").alias("requires_strings_header"),
        F.when(safe, content).otherwise(F.raise_error(F.concat(F.lit("unsafe translation of "), "segment_id"))).alias("content"),
        c("task_ordinal").alias("ordinal"),
        "translation_identifier",
    )
    return render.files(render.refused_if_repeated(fragments), language)
