"""Identities, digests, ordinals and JSON over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import sequences, tasks
from .registry import query, table

#: Text with every kind of protected token, from columns of ``part``.
TOKEN_TEXT = r"concat('[', p_brand, '] {', p_type, '} [[', p_name, ' \\', p_size, ' {{x}')"


@query("""
SELECT conv_id, turn, concat('seg_', left(sha256(concat('conversations', chr(0), conv_id, chr(0), 'dialogue', chr(0), coalesce(role, ''), chr(0), text, chr(0),
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) - 1)), 24)) AS segment_id
FROM conversations
""")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.occurrences(table(spark, sf_dir, "conversations"), ["conv_id", "role", "text"], "turn")
    parts = (F.lit("conversations"), F.col("conv_id"), F.lit("dialogue"), F.col("role"), F.col("text"), F.col("occurrence"))
    return rows.select("conv_id", "turn", identity.segment_id(*parts).alias("segment_id"))


@query(r"""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256,
  CAST(len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END AS INTEGER) AS line_count
FROM (SELECT *, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents)
""")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), text.line_count(F.col("text")).alias("line_count"))


TOKENS_SQL = r"""
WITH m AS (SELECT {key} AS id, regexp_extract_all({text}, '(?s)\\.|\[\[|\{{\{{|\[[^\]]*\]|\{{[^}}]*\}}') AS v,
                  regexp_split_to_array({text}, '(?s)\\.|\[\[|\{{\{{|\[[^\]]*\]|\{{[^}}]*\}}') AS g FROM {table}),
r AS (SELECT id, v, g, unnest(range(1, len(v) + 1)) AS i FROM m)
SELECT id, CAST(i - 1 AS INTEGER) AS token_index,
  CASE WHEN starts_with(v[i], '\') OR v[i] IN ('[[', '{{{{') THEN 'escape' WHEN starts_with(v[i], '[') THEN 'interpolation' ELSE 'text_tag' END AS kind,
  v[i] AS token_value,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS token_start,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x))) AS INTEGER) AS token_end
FROM r
"""


def _token_rows(df: DataFrame, key: str, value) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.explode(text.tokens(value)).alias("t")).select(
        "id", F.col("t.index").alias("token_index"), "t.kind", F.col("t.value").alias("token_value"), F.col("t.start").alias("token_start"), F.col("t.end").alias("token_end")
    )


@query(TOKENS_SQL.format(key="page_id", text="html", table="pages"))
def protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(table(spark, sf_dir, "pages"), "page_id", F.col("html"))


@query(TOKENS_SQL.format(key="p_partkey", text=TOKEN_TEXT.replace("\\\\", "\\"), table="part"))
def protected_tokens_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(table(spark, sf_dir, "part"), "p_partkey", F.expr(TOKEN_TEXT))


@query("""
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 8 AS BIGINT) AS batch_index FROM documents
""")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.global_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8).select("doc_id", "batch_index")


@query("""
WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
g AS (SELECT conv_id, n // 2 AS i, string_agg('"t' || turn || '"', ',' ORDER BY turn) AS ids FROM b GROUP BY conv_id, n // 2)
SELECT conv_id, CAST(i AS BIGINT) AS batch_index,
  concat('batch_', left(sha256(concat('{"index":', i, ',"segment_ids":[', ids, '],"task_id":"', conv_id, '"}')), 24)) AS batch_id
FROM g
""")
def batch_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("segment_id"))
    return tasks.task_batches(rows, ["conv_id"], "segment_id", "turn", 2).select("conv_id", "batch_index", "batch_id")


@query("""
WITH g AS (SELECT source, doc_id // 64 AS leaf, string_agg('"' || sha256(text) || '"', ',' ORDER BY doc_id) AS v FROM documents GROUP BY source, doc_id // 64),
l AS (SELECT source, leaf, concat('leaf_', left(sha256(concat('[', v, ']')), 24)) AS d FROM g)
SELECT source, concat('import_', left(sha256(concat('[', string_agg('"' || d || '"', ',' ORDER BY leaf), ']')), 24)) AS import_id FROM l GROUP BY source
""")
def import_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return identity.tree_digest(rows, ["source"], "doc_id", "sha", "import", "import_id", leaf=64)


@query("""
SELECT o_orderkey, concat('request_', left(sha256(concat('{"backend_identity":"service/', o_orderpriority, '","batch":{"index":', o_custkey, ',"status":"', o_orderstatus, '"}}')), 24)) AS request_id
FROM orders
""")
def request_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.struct(
        F.concat(F.lit("service/"), "o_orderpriority").alias("backend_identity"),
        F.struct(F.col("o_custkey").alias("index"), F.col("o_orderstatus").alias("status")).alias("batch"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.digest("request", identity.canonical_json(payload)).alias("request_id"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) - 1 AS n FROM conversations)
SELECT conv_id, turn, to_json({'schema_version': 1, 'id': 'seg_' || conv_id || '_' || turn, 'line_number': turn, 'scene': conv_id::VARCHAR, 'speaker': CASE WHEN role = 'system' THEN NULL ELSE role END, 'occurrence': n, 'source_text': text})::VARCHAR AS line FROM o
""")
def segments_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.occurrences(table(spark, sf_dir, "conversations"), ["conv_id", "role", "text"], "turn")
    line = F.struct(
        F.lit(1).alias("schema_version"),
        F.concat_ws("_", F.lit("seg"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("turn").alias("line_number"),
        F.col("conv_id").cast("string").alias("scene"),
        F.when(F.col("role") != "system", F.col("role")).alias("speaker"),
        "occurrence",
        F.col("text").alias("source_text"),
    )
    return rows.select("conv_id", "turn", F.to_json(line, {"ignoreNullFields": "false"}).alias("line"))


@query("""
SELECT p_partkey, concat('{"segments":[{"kind":"', p_type, '","source_text":"', p_name, '"}],"source_language":"ja","target_language":"schinese"}') AS payload FROM part
""")
def request_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.struct(F.col("p_type").alias("kind"), F.col("p_name").alias("source_text"))
    payload = F.struct(F.array(segment).alias("segments"), F.lit("ja").alias("source_language"), F.lit("schinese").alias("target_language"))
    return table(spark, sf_dir, "part").select("p_partkey", identity.canonical_json(payload).alias("payload"))


@query("""
SELECT event_id, concat('{"completed_batches":', event_id % 7, ',"message":"', event_type, '","schema_version":2,"stage":"translating","total_batches":', event_id % 7 + user_id, ',"type":"progress"}') AS line FROM events
""")
def progress_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("event_id") % 7
    event = F.struct(
        done.alias("completed_batches"),
        F.col("event_type").alias("message"),
        F.lit(2).alias("schema_version"),
        F.lit("translating").alias("stage"),
        (done + F.col("user_id")).alias("total_batches"),
        F.lit("progress").alias("type"),
    )
    return table(spark, sf_dir, "events").select("event_id", identity.canonical_json(event).alias("line"))


@query("""
WITH t AS (SELECT conv_id, string_agg(turn || ':' || sha256(text), ',' ORDER BY turn) AS now, string_agg(turn || ':' || sha256(CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN upper(text) ELSE text END), ',' ORDER BY turn) AS stored FROM conversations GROUP BY conv_id)
SELECT conv_id, now = stored AS rebuilt FROM t
""")
def task_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("now", F.sha2("text", 256)).withColumn(
        "stored", F.sha2(F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0), F.upper("text")).otherwise(F.col("text")), 256)
    )
    now = identity.ordered_digest(rows, ["conv_id"], "turn", "now", "task", "now_id")
    stored = identity.ordered_digest(rows, ["conv_id"], "turn", "stored", "task", "stored_id")
    return now.join(stored, "conv_id").select("conv_id", (F.col("now_id") == F.col("stored_id")).alias("rebuilt"))
