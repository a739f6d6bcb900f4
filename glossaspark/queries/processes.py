"""Files, services and streams: scripts and templates made from driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sending
from ..sources import encoding, scripts, services, templates
from ..sources.compatibility import presentation
from ..storage import scratch_path
from ..streaming import stability, state_machine
from . import states
from .registry import query, table

SAID = "replace(replace(replace(text, '\"', ''), chr(10), ' '), chr(92), '')"


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each conversation, as decoded files."""
    said = F.expr(SAID.replace("chr(", "char("))
    line = F.concat(F.lit("    "), F.when(F.col("role") == "system", "").otherwise(F.concat("role", F.lit(" "))), F.lit('"'), said, F.lit('"\n'))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda r: r["line"])
    script = F.concat(F.lit('define user = Character("You")\nlabel c'), F.col("conv_id").cast("string"), F.lit(":\n"), F.array_join(lines, ""))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("lines")).select(
        F.concat(F.lit("game/c"), F.col("conv_id").cast("string"), F.lit(".rpy")).alias("path"),
        F.concat(F.lit('define user = Character("You")\nlabel c'), F.col("conv_id").cast("string"), F.lit(":\n"), F.array_join("lines", "")).alias("text"),
    )


@query(f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE role END AS speaker, {SAID} AS said FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, said ORDER BY turn) - 1 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 2 AS line FROM t)
SELECT 'game/c' || conv_id || '.rpy' AS source_file, CAST(line AS INTEGER) AS line_number, CASE WHEN speaker = '' THEN 'narration' ELSE 'dialogue' END AS kind, CASE WHEN speaker = 'user' THEN 'You' END AS speaker_display, said AS source_text,
  concat('seg_', left(sha256(concat('game/c', conv_id, '.rpy', chr(0), 'c', conv_id, chr(0), CASE WHEN speaker = '' THEN 'narration' ELSE 'dialogue' END, chr(0), speaker, chr(0), said, chr(0), n)), 24)) AS id FROM o
""")
def extract_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _scripts(spark, sf_dir).select("path", F.encode("text", "UTF-8").alias("content"))
    found = scripts.segments(scripts.rows(encoding.decoded_files(content)))
    return found.select("source_file", "line_number", "kind", "speaker_display", "source_text", "id")


@query("SELECT doc_id, 'utf-8' AS encoding, false AS has_bom, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS sha256 FROM documents")
def encoding_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return encoding.decoded_files(content).select(F.col("path").cast("long").alias("doc_id"), "encoding", "has_bom", F.length("text").alias("n_chars"), "sha256")


@query("""
SELECT p_partkey, unnest([p_name, p_type || chr(92) || chr(39)]) AS body, unnest([5, 8 + length(p_name)]) AS literal_start, unnest([7 + length(p_name), 12 + length(p_name) + length(p_type)]) AS literal_end FROM part
""".replace("unnest([5, 8 + length(p_name)]) AS literal_start", "CAST(unnest([5, 8 + length(p_name)]) AS INTEGER) AS literal_start").replace("unnest([7 + length(p_name), 12 + length(p_name) + length(p_type)]) AS literal_end", "CAST(unnest([7 + length(p_name), 12 + length(p_name) + length(p_type)]) AS INTEGER) AS literal_end"))
def string_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('show "'), "p_name", F.lit("\" '"), "p_type", F.lit("\\'' # \"x\""))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(scripts.string_literals(line)).alias("t"))
    return found.select("p_partkey", "t.body", F.col("t.start").alias("literal_start"), F.col("t.end").alias("literal_end"))


@query("""
SELECT 'brand' || p_brand || '.rpy' AS template_file, 'script.rpy' AS source_file, p_size AS line_number, CASE WHEN p_size % 2 = 0 THEN 'menu_choice' ELSE 'dialogue' END AS kind, p_name AS source_text,
  CASE WHEN p_size % 2 = 1 THEN 'id_' || p_partkey END AS translation_identifier, CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE 4 END AS INTEGER) AS literal_start FROM part
""")
def template_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    said = F.concat(F.lit("# script.rpy:"), size, F.lit("\ntranslate schinese id_"), key, F.lit(':\n\n    # aoi "'), "p_name", F.lit('"\n    aoi ""\n\n'))
    choice = F.concat(F.lit("translate schinese strings:\n\n    # script.rpy:"), size, F.lit('\n    old "'), "p_name", F.lit('"\n    new ""\n\n'))
    block = F.struct("p_partkey", F.when(F.col("p_size") % 2 == 0, choice).otherwise(said).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"])
    files = table(spark, sf_dir, "part").groupBy("p_brand").agg(blocks.alias("blocks")).select(
        F.concat(F.lit("brand"), "p_brand", F.lit(".rpy")).alias("path"), F.encode(F.array_join("blocks", ""), "UTF-8").alias("content")
    )
    found, _ = templates.read_entries(files, "schinese")
    return found.select("template_file", "source_file", "line_number", "kind", "source_text", "translation_identifier", "literal_start")


def echo(payload: str) -> tuple[int, str]:
    """Offline service: answers each segment with its text in brackets; refuses some
    batches and garbles others, by their number."""
    import json

    batch = json.loads(payload)
    if batch["number"] % 5 == 0:
        return 400, "no"
    items = [{"segment_id": s["segment_id"], "target_text": f"<{s['source_text']}>"} for s in batch["segments"]]
    if batch["number"] % 7 == 0:
        items.reverse()
    content = json.dumps({"translations": items}, ensure_ascii=False)
    return 200, json.dumps({"id": "r", "choices": [{"message": {"content": content}}]}, ensure_ascii=False)


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("segment_id"), F.col("role").alias("source_text"))
    batches = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    payload = F.to_json(F.struct(F.col("conv_id").alias("number"), "segments"))
    sent = services.submitted(batches.select(F.col("conv_id").cast("string").alias("batch_id"), payload.alias("payload")), echo)
    items = services.reply_items(F.col("body"))
    judged = batches.join(sent.select(F.col("batch_id").cast("long").alias("conv_id"), "http_status", items.alias("items")), "conv_id")
    return judged.withColumn("status", services.outcome(F.col("http_status"), F.col("items"), F.transform("segments", lambda s: s["segment_id"])))


@query("""
SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'failed' WHEN conv_id % 7 = 0 AND count(*) > 1 THEN 'unknown' ELSE 'succeeded' END AS status, CAST(CASE WHEN conv_id % 5 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS n_items FROM conversations GROUP BY conv_id
""")
def provider_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("conv_id", "status", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))


@query("""
SELECT conv_id, status, CASE status WHEN 'succeeded' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'running' END AS batch_status, CASE WHEN status = 'succeeded' THEN first END AS first_text
FROM (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'failed' WHEN conv_id % 7 = 0 AND count(*) > 1 THEN 'unknown' ELSE 'succeeded' END AS status, arg_min('<' || role || '>', turn) AS first FROM conversations GROUP BY conv_id)
""")
def run_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of each task is sent and its receipt applied: an unknown outcome leaves
    the batch running and isn't sent again."""
    done = _replies(spark, sf_dir)
    after = F.when(F.col("status") == "succeeded", "completed").when(F.col("status") == "failed", "failed").otherwise("running")
    first = F.when(F.col("status") == "succeeded", F.get("items", F.lit(0))["target_text"])
    return done.select("conv_id", "status", after.alias("batch_status"), first.alias("first_text"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("segment_id"), F.col("role").alias("source_text"))
    batches = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    return batches.select(
        F.col("conv_id").cast("string").alias("batch_id"), F.to_json(F.struct(F.col("conv_id").alias("number"), "segments")).alias("payload"), F.transform("segments", lambda s: s["segment_id"]).alias("segment_ids")
    )


@query("""
SELECT CAST(conv_id AS VARCHAR) AS batch_id, CAST(CASE WHEN conv_id % 7 = 0 AND conv_id % 5 > 0 AND count(*) > 1 THEN 2 ELSE 1 END AS BIGINT) AS seq,
  CASE WHEN conv_id % 5 = 0 THEN 'failed' WHEN conv_id % 7 = 0 AND count(*) > 1 THEN 'unknown' ELSE 'succeeded' END AS status FROM conversations GROUP BY conv_id
""")
def write_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are claimed, sent and settled; a second run sends none of them, and the
    unknown ones are asked for once more, without an answer."""
    ready = _batches(spark, sf_dir)
    store = scratch_path(spark, "receipts")
    sending.send(ready, store, echo, "one")
    sending.send(ready, store, echo, "two")
    sending.recover(ready, store, lambda payload: (504, ""), "three")
    return sending.receipts(spark, store).select("batch_id", "seq", "status")


def _answered(payload: str) -> tuple[int, str]:
    """What the service says of a batch whose answer was garbled."""
    import json

    batch = json.loads(payload)
    return echo(json.dumps(batch | {"number": 1}))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS batch_id, CASE WHEN conv_id % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CAST(CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts
FROM conversations GROUP BY conv_id
""")
def send_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches until they are settled: refused ones are sent twice, garbled ones asked for."""
    ready = _batches(spark, sf_dir)
    return sending.drive(ready, scratch_path(spark, "receipts"), echo, _answered, "loop").select("batch_id", "status", "attempts")


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ready' WHEN 2 THEN 'uncertain' ELSE 'blocked' END AS tone FROM pages
""")
def status_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.expr("element_at(array('source_ready', 'packaged_requires_import', 'uncertain', 'not_renpy'), CAST(page_id % 4 AS INT) + 1)")
    return table(spark, sf_dir, "pages").select("page_id", presentation(found)["tone"].alias("tone"))


def _stream_oracle() -> str:
    from .registry import ORACLES

    return f"SELECT user_id, state, applied + ignored AS n, applied, CAST(0 AS BIGINT) AS n_late FROM ({ORACLES['state_replay'].strip()})"


@query(_stream_oracle())
def state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as a stream: same final states as the batch replay."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    moves = events.selectExpr("user_id", "event_id", "CAST(ts AS TIMESTAMP) AS ts", f"{states.STATUS} AS wanted")
    out = scratch_path(spark, "moves")
    run = (
        state_machine.replay(moves)
        .writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "stream"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    applied = spark.read.schema(state_machine.OUT).parquet(out)
    return applied.groupBy(F.col("key").alias("user_id")).agg(
        F.max_by("after", "event_id").alias("state"), F.count("*").alias("n"), F.count_if("applied").alias("applied"), F.count_if("late").alias("n_late")
    )




@query("""
WITH e AS (SELECT *, event_type IN ('view', 'click', 'signup') AS good, min(epoch_us(ts)) OVER (PARTITION BY user_id) + 864000500000 AS until FROM events),
r AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT user_id, epoch_us(ts) AS t, until, good, min(CASE WHEN good THEN epoch_us(ts) END) OVER (PARTITION BY user_id, run) AS since FROM r),
f AS (SELECT user_id, min(until) AS until, min(CASE WHEN good AND t - since >= 172800000000 AND t <= until THEN t END) AS ended,
        arg_min(since, CASE WHEN good AND t - since >= 172800000000 AND t <= until THEN t END) AS since FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN ended IS NULL THEN 'deadline' ELSE 'stable' END AS outcome, CASE WHEN ended IS NOT NULL THEN since END AS run_start, coalesce(ended, until) AS ended
FROM f WHERE ended IS NOT NULL OR until < (SELECT max(epoch_us(ts)) FROM events)
""")
def stability_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stable for two days, or not within ten, as a stream."""
    own = stability.session(spark)
    schema = own.read.parquet(f"{sf_dir}/events.parquet").schema
    events = own.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type IN ('view', 'click', 'signup') AS good")
    out = scratch_path(spark, "stable")
    found = stability.stable(events.withWatermark("ts", "0 seconds"), "user_id", "ts", "good", 172_800, 864_000.5)
    run = found.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream")).outputMode("append").trigger(availableNow=True).start(out)
    run.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(out)
    return rows.select(F.col("key").alias("user_id"), "outcome", F.unix_micros("run_start").alias("run_start"), F.unix_micros("ended").alias("ended"))
