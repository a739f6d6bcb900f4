"""Predicates and projections over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domains import LANGUAGE_NAMES, STAGE_PERCENT
from ..functions import paths, records, text
from ..operators import quality, render, state, tasks
from ..sources.scripts import string_literals
from .registry import query, table

#: File names and folders in every class, spread over the documents.
FILES = "element_at(array('game/a.rpy', 'game/B.RPYM', 'data/x.ks', 'notes.txt', 't/a.json', 't/b.csv', 't/c.tsv', 'img/d.png', '.rpy', 'game/.hidden/e.rpy'), CAST(doc_id % 10 AS INT) + 1)"
FILES_SQL = "['game/a.rpy', 'game/B.RPYM', 'data/x.ks', 'notes.txt', 't/a.json', 't/b.csv', 't/c.tsv', 'img/d.png', '.rpy', 'game/.hidden/e.rpy'][doc_id % 10 + 1]"
FOLDERS = "concat(element_at(array('.git', 'game', '.venv/lib', 'src/node_modules', 'x/__pycache__', 'git'), CAST(doc_id % 6 AS INT) + 1), '/', source, '.rpy')"
FOLDERS_SQL = "concat(['.git', 'game', '.venv/lib', 'src/node_modules', 'x/__pycache__', 'git'][doc_id % 6 + 1], '/', source, '.rpy')"
ODD_PATHS = "element_at(array('a/b.rpy', '/a.rpy', 'a/../b.rpy', 'a//b.rpy', 'c:/a.rpy', 'a.txt', 'game/a.rpy', 'con.rpy', 'a /b.rpy', 'x/q?.rpy', 'a.b/c.rpy', './d.rpy'), CAST(doc_id % 12 AS INT) + 1)"
ODD_PATHS_SQL = "['a/b.rpy', '/a.rpy', 'a/../b.rpy', 'a//b.rpy', 'c:/a.rpy', 'a.txt', 'game/a.rpy', 'con.rpy', 'a /b.rpy', 'x/q?.rpy', 'a.b/c.rpy', './d.rpy'][doc_id % 12 + 1]"


@query(f"""
WITH p AS (SELECT doc_id, {FILES_SQL} AS path FROM documents), s AS (SELECT *, CASE WHEN regexp_matches(path, '(^|/)\\.[^./]*$') THEN '' ELSE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) END AS x FROM p)
SELECT doc_id, CASE WHEN x IN ('.rpy', '.rpym', '.ks') THEN 'script' WHEN x = '.txt' THEN 'text' WHEN x IN ('.json', '.csv', '.tsv') THEN 'structured_text' END AS kind,
  CASE WHEN x IN ('.rpy', '.rpym') THEN 'renpy' WHEN x = '.ks' THEN 'kirikiri' END AS engine FROM s
""")
def suffix_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(FILES)
    return table(spark, sf_dir, "documents").select("doc_id", paths.file_kind(path).alias("kind"), paths.engine_hint(path).alias("engine"))


@query(f"""
SELECT doc_id, path FROM (SELECT doc_id, {FOLDERS_SQL} AS path FROM documents) WHERE NOT list_has_any(string_split(path, '/'), ['.git', '.venv', '__pycache__', 'node_modules'])
""")
def ignored_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(FOLDERS).alias("path")).where(~paths.ignored(F.col("path")))


@query(r"""
SELECT doc_id, text = '' OR (length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0e-\x1f]', '', 'g'))) * 100 < length(text) AS plausible FROM documents
""")
def text_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.plausible(F.col("text")).alias("plausible"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(CASE n % 4 WHEN 0 THEN CASE WHEN ltrim(line) LIKE chr(9) || '%' THEN 8 ELSE 4 END WHEN 2 THEN 6 ELSE 0 END AS INTEGER) AS indent FROM l
""")
def indent_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    blanks = F.expr(r"CASE line_no % 4 WHEN 0 THEN ' \t' WHEN 1 THEN '\u3000  ' WHEN 2 THEN '\t  \u00a0' ELSE '' END")
    return rows.select("doc_id", "line_no", text.indent(F.concat(blanks, F.ltrim("line"))).alias("indent"))


@query(r"""
SELECT doc_id, regexp_full_match(tag, '[A-Za-z][A-Za-z0-9_-]*') AS valid FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || source WHEN 2 THEN '1' || lang ELSE lang || ' x' END AS tag FROM documents)
""")
def language_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.expr("CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || source WHEN 2 THEN '1' || lang ELSE lang || ' x' END")
    return table(spark, sf_dir, "documents").select("doc_id", text.valid_language(tag).alias("valid"))


@query(r"""
SELECT doc_id, regexp_full_match(id, '(seg|task|batch|proposal|request)_[0-9a-f]{24}') AS valid
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'seg_' || left(sha256(text), 24) WHEN 1 THEN 'task_' || upper(left(sha256(text), 24)) ELSE 'batch_' || left(sha256(text), 23) END AS id FROM documents)
""")
def id_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("text", 256)
    made = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("seg_"), F.left(sha, F.lit(24))))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("task_"), F.upper(F.left(sha, F.lit(24)))))
        .otherwise(F.concat(F.lit("batch_"), F.left(sha, F.lit(23))))
    )
    return table(spark, sf_dir, "documents").select("doc_id", made.rlike(r"^(seg|task|batch|proposal|request)_[0-9a-f]{24}\z").alias("valid"))


@query(r"""
SELECT c_custkey, length(v) BETWEEN 1 AND 200 AND NOT regexp_matches(v, '[\x00-\x1f]') AND v = trim(v) AS valid
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN ' ' || c_name WHEN 2 THEN c_name || chr(9) || 'x' WHEN 3 THEN repeat(c_name, 20) ELSE '' END AS v FROM customer)
""")
def identity_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN ' ' || c_name WHEN 2 THEN c_name || char(9) || 'x' WHEN 3 THEN repeat(c_name, 20) ELSE '' END")
    return table(spark, sf_dir, "customer").select("c_custkey", text.checked_string(v, 200).alias("valid"))


@query(r"""
SELECT page_id, length(url) BETWEEN 1 AND 45 AND NOT regexp_matches(url, '[\x00-\x1f]') AS checked_chars, strlen(url) BETWEEN 1 AND 45 AS checked_bytes FROM pages
""")
def checked_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.checked_string(url, 45, strip=False).alias("checked_chars"), F.octet_length(url).between(1, 45).alias("checked_bytes"))


@query(f"""
SELECT doc_id, NOT list_has_any(p, ['', '.', '..']) AND NOT contains(path, ':') AND NOT contains(path, chr(92)) AND ends_with(path, '.rpy') AS safe
FROM (SELECT doc_id, path, string_split(path, '/') AS p FROM (SELECT doc_id, {ODD_PATHS_SQL} AS path FROM documents))
""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", paths.safe_template(F.expr(ODD_PATHS)).alias("safe"))


@query(f"""
WITH q AS (SELECT doc_id, path, string_split(path, '/') AS p FROM (SELECT doc_id, {ODD_PATHS_SQL} AS path FROM documents)),
s AS (SELECT *, NOT list_has_any(p, ['', '.', '..']) AND NOT contains(path, ':') AND NOT starts_with(path, '/') AS safe FROM q)
SELECT doc_id, safe, safe AND lower(p[1]) <> 'game' AND len(list_filter(p, lambda x: regexp_matches(x, '[ .]$') OR regexp_matches(x, '[<>:"\\\\|?*]') OR regexp_matches(lower(x), '^(aux|con|nul|prn|com[1-9]|lpt[1-9])(\\.|$)'))) = 0 AS writable FROM s
""")
def archive_path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(ODD_PATHS)
    return table(spark, sf_dir, "documents").select("doc_id", paths.safe_archive_entry(path).alias("safe"), paths.safe_output(path).alias("writable"))


@query(r"""
WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(regexp_replace(url, '\?.*$', ''), 'http:', 'https:') || '/v1/chat/completions' WHEN 1 THEN url WHEN 2 THEN 'http://127.0.0.1:8080/v1/chat/completions/' WHEN 3 THEN 'https://user:x@host.example.com/chat/completions' ELSE regexp_replace(url, '\?.*$', '') || '/chat/completions' END AS u FROM pages)
SELECT page_id, regexp_matches(u, '^https?://') AND NOT contains(u, '@') AND NOT regexp_matches(u, '[?#].') AND regexp_matches(u, '/chat/completions/*$') AND (starts_with(u, 'https:') OR regexp_matches(u, '^http://(localhost|127\.)')) AS valid FROM u
""")
def endpoint_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr(
        r"""CASE page_id % 5 WHEN 0 THEN replace(regexp_replace(url, '\\?.*$', ''), 'http:', 'https:') || '/v1/chat/completions' WHEN 1 THEN url
        WHEN 2 THEN 'http://127.0.0.1:8080/v1/chat/completions/' WHEN 3 THEN 'https://user:x@host.example.com/chat/completions'
        ELSE regexp_replace(url, '\\?.*$', '') || '/chat/completions' END"""
    )
    return table(spark, sf_dir, "pages").select("page_id", paths.valid_endpoint(u).alias("valid"))


@query("SELECT conv_id, turn, replace(text, left(text, 5), '[REDACTED]') AS redacted FROM conversations")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.left("text", F.lit(5))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.redacted(F.col("text"), secret).alias("redacted"))


@query("""
SELECT event_id, CAST(CASE WHEN stage = 'translating' AND total > 0 THEN 25 + round(45.0 * done / total) ELSE CASE stage WHEN 'preflight' THEN 5 WHEN 'extracting' THEN 12 WHEN 'translating' THEN 25 WHEN 'rendering' THEN 80 ELSE 100 END END AS INTEGER) AS percent,
  CAST(CASE WHEN stage = 'translating' AND total > 0 THEN 25 + round_even(45.0 * done / total, 0) ELSE CASE stage WHEN 'preflight' THEN 5 WHEN 'extracting' THEN 12 WHEN 'translating' THEN 25 WHEN 'rendering' THEN 80 ELSE 100 END END AS INTEGER) AS percent_even
FROM (SELECT event_id, ['preflight', 'extracting', 'translating', 'rendering', 'completed'][event_id % 5 + 1] AS stage, event_id % 8 AS total, (event_id // 8) % (event_id % 8 + 1) AS done FROM events)
""")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.expr("element_at(array('preflight', 'extracting', 'translating', 'rendering', 'completed'), CAST(event_id % 5 AS INT) + 1)")
    total, done = F.col("event_id") % 8, F.expr("(event_id div 8) % (event_id % 8 + 1)")
    fixed = F.create_map(*[F.lit(x) for pair in STAGE_PERCENT.items() for x in pair])[stage]
    share = F.try_divide(45.0 * done, total)
    shown = lambda f: F.when((stage == "translating") & (total > 0), 25 + f(share, 0)).otherwise(fixed).cast("int")
    return table(spark, sf_dir, "events").select("event_id", shown(F.round).alias("percent"), shown(F.bround).alias("percent_even"))


@query("SELECT page_id, regexp_replace(url, '/+$', '') || '-translated' AS output FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS url FROM pages)")
def suggest_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END")
    return table(spark, sf_dir, "pages").select("page_id", paths.suggested_output(url).alias("output"))


@query("""
SELECT doc_id, CASE tag WHEN 'schinese' THEN 'Simplified Chinese' WHEN 'zh-Hans' THEN 'Simplified Chinese' WHEN 'tchinese' THEN 'Traditional Chinese' WHEN 'zh-Hant' THEN 'Traditional Chinese' ELSE tag END AS name
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'schinese' WHEN 1 THEN 'zh-Hans' WHEN 2 THEN 'tchinese' WHEN 3 THEN 'zh-Hant' ELSE lang END AS tag FROM documents)
""")
def language_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.expr("CASE doc_id % 5 WHEN 0 THEN 'schinese' WHEN 1 THEN 'zh-Hans' WHEN 2 THEN 'tchinese' WHEN 3 THEN 'zh-Hant' ELSE lang END")
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(names, tag), tag).alias("name"))


@query("SELECT doc_id, left('StorageError: ' || text, 1000) AS message FROM documents")
def failure_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.failure_message(F.lit("StorageError"), F.col("text")).alias("message"))


PROPS = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '}', ', \"x\": 1, \"b\": true}') WHEN 2 THEN '{\"j\": \"5\"}' ELSE '[1]' END"


@query(f"""
WITH r AS (SELECT event_id, {PROPS} AS r FROM events), k AS (SELECT event_id, CASE WHEN json_type(r) = 'OBJECT' THEN json_keys(r) END AS k FROM r)
SELECT event_id, array_to_string(list_sort(list_filter(['k'], lambda x: NOT list_contains(k, x))), ',') AS missing, array_to_string(list_sort(list_filter(k, lambda x: x <> 'k')), ',') AS extra, coalesce(k = ['k'], false) AS closed
FROM (SELECT event_id, k FROM k)
""".replace("array_to_string(list_sort(list_filter(['k'], lambda x: NOT list_contains(k, x))), ',') AS missing", "CASE WHEN k IS NULL THEN NULL WHEN list_contains(k, 'k') THEN '' ELSE 'k' END AS missing"))
def closed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.expr(PROPS)
    faults = records.key_faults(record, ["k"])
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(faults["missing"], ",").alias("missing"), F.array_join(faults["extra"], ",").alias("extra"), records.closed(record, ["k"]).alias("closed")
    )


TYPED = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{\"k\": true}' WHEN 2 THEN '{\"k\": \"7\"}' WHEN 3 THEN '{\"k\": 1.5}' ELSE '{\"k\": 0}' END"


@query(f"""
SELECT event_id, coalesce(json_type(r, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(r, '$.k') AS DOUBLE) >= 1, false) AS is_count, coalesce(json_type(r, '$.k') = 'VARCHAR', false) AS is_text
FROM (SELECT event_id, {TYPED} AS r FROM events)
""".replace("CAST(json_extract_string(r, '$.k') AS DOUBLE)", "TRY_CAST(json_extract_string(r, '$.k') AS DOUBLE)"))
def typed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.expr(TYPED)
    return table(spark, sf_dir, "events").select("event_id", records.is_integer(record, "k", 1).alias("is_count"), records.is_text(record, "k").alias("is_text"))


@query("""
SELECT o_orderkey, CASE s WHEN 'succeeded' THEN n > 0 AND e IS NULL WHEN 'in_flight' THEN n = 0 AND ref IS NOT NULL AND e IS NULL ELSE n = 0 AND e IS NOT NULL AND length(e) BETWEEN 1 AND 1000 END AS consistent
FROM (SELECT o_orderkey, ['in_flight', 'succeeded', 'failed', 'unknown'][o_orderkey % 4 + 1] AS s, o_custkey % 3 AS n, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS e, CASE WHEN o_custkey % 2 = 0 THEN 'r' || o_custkey END AS ref FROM orders)
""")
def receipt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "element_at(array('in_flight', 'succeeded', 'failed', 'unknown'), CAST(o_orderkey % 4 AS INT) + 1) AS s", "o_custkey % 3 AS n", "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS e", "CASE WHEN o_custkey % 2 = 0 THEN 'r' || o_custkey END AS ref"
    )
    return rows.select("o_orderkey", state.receipt_consistent(F.col("s"), F.col("n"), F.col("ref"), F.col("e")).alias("consistent"))


@query("""
SELECT p_partkey, length(content) > 0 AND (kind = 'menu_choice') = header AND (kind = 'menu_choice') = (id IS NULL) AS consistent
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'menu_choice' WHEN 1 THEN 'dialogue' ELSE 'narration' END AS kind, p_partkey % 2 = 0 AS header, CASE WHEN p_partkey % 4 > 1 THEN p_brand END AS id, CASE WHEN p_type = 'SMALL' THEN '' ELSE p_name END AS content FROM part)
""")
def fragment_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE p_size % 3 WHEN 0 THEN 'menu_choice' WHEN 1 THEN 'dialogue' ELSE 'narration' END AS kind", "p_partkey % 2 = 0 AS header", "CASE WHEN p_partkey % 4 > 1 THEN p_brand END AS id", "CASE WHEN p_type = 'SMALL' THEN '' ELSE p_name END AS content"
    )
    return rows.select("p_partkey", render.fragment_consistent(F.col("kind"), F.col("header"), F.col("id"), F.col("content")).alias("consistent"))


SEGMENTS = r"""concat('[', p_brand, '] {i}', p_name, '{/i}') AS source_text"""


@query(r"""
SELECT 'seg_' || p_partkey AS segment_id, p_type AS kind, concat('[', p_brand, '] {i}', p_name, '{/i}') AS source_text,
  concat('[{"index":0,"kind":"interpolation","value":"[', p_brand, ']"},{"index":1,"kind":"text_tag","value":"{i}"},{"index":2,"kind":"text_tag","value":"{/i}"}]') AS tokens,
  CASE WHEN p_size % 10 = 0 THEN 'schema_version' WHEN p_partkey % 7 = 0 THEN 'source_sha256' END AS error
FROM part
""")
def request_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = (
        table(spark, sf_dir, "part")
        .selectExpr("'seg_' || p_partkey AS id", "CASE WHEN p_size % 10 = 0 THEN 2 ELSE 1 END AS schema_version", "'renpy' AS engine", "CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE sha2(p_name, 256) END AS source_sha256", "p_type AS kind", "'start' AS scene", "p_brand AS speaker", "CAST(NULL AS STRING) AS speaker_display", SEGMENTS)
        .withColumn("protected_tokens", text.tokens(F.col("source_text")))
    )
    return tasks.requests(segments).select("segment_id", "kind", "source_text", F.to_json("protected_tokens").alias("tokens"), "error")


@query(r"""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('    # script.rpy:', p_size, chr(10), '    old "', p_name, '"', chr(10), '    new "', p_type, '"', chr(10), chr(10))
  ELSE concat('# script.rpy:', p_size, chr(10), 'translate schinese id_', p_partkey, ':', chr(10), chr(10), '    # aoi "', p_name, '" with fade', chr(10), '    aoi "', p_type, '" with fade', chr(10), chr(10)) END AS content
FROM part
""")
def render_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = F.col("p_size") % 3 == 0
    code = F.when(choice, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.concat(F.lit('aoi "'), "p_name", F.lit('" with fade')))
    start = F.when(choice, 0).otherwise(4)
    content = render.fragment(
        F.when(choice, "menu_choice").otherwise("dialogue"), F.lit("script.rpy"), F.col("p_size"), code, start, start + F.length("p_name") + 2, F.col("p_type"), F.lit("schinese"), F.concat(F.lit("id_"), F.col("p_partkey").cast("string"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", content.alias("content"))


@query(r"""
SELECT p_partkey, NOT regexp_matches(t, '[\x00\r\n]') AND NOT contains(rest, '\') AND NOT contains(rest, '"') AS fits, CASE WHEN p_size % 6 = 5 THEN false ELSE NOT contains(t, '\') END AS tokens_kept
FROM (SELECT *, regexp_replace(t, '(?s)\\.', '', 'g') AS rest FROM (SELECT p_partkey, p_size, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) WHEN 2 THEN 'a "' || p_name || '"' WHEN 3 THEN 'b \"' || p_name WHEN 4 THEN p_name || '\' ELSE '[x] ' || p_name END AS t FROM part))
""".replace("ELSE NOT contains(t, '\\') END AS tokens_kept", "ELSE p_size % 6 <> 3 END AS tokens_kept"))
def render_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size") % 6, F.col("p_name")
    target = (
        F.when(size == 0, name)
        .when(size == 1, F.concat(name, F.lit("\n")))
        .when(size == 2, F.concat(F.lit('a "'), name, F.lit('"')))
        .when(size == 3, F.concat(F.lit('b \\"'), name))
        .when(size == 4, F.concat(name, F.lit("\\")))
        .otherwise(F.concat(F.lit("[x] "), name))
    )
    return table(spark, sf_dir, "part").select("p_partkey", render.fits_literal(target, F.lit('"')).alias("fits"), render.tokens_kept(name, target).alias("tokens_kept"))


@query("""
SELECT p_partkey, p_size % 5 NOT IN (1, 2, 3, 4) AS stands FROM part
""")
def literal_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded literals against code that has gained a string, moved, changed, or become a comment."""
    size, name = F.col("p_size") % 5, F.col("p_name")
    said = F.concat(F.lit('aoi "'), name, F.lit('"'))
    code = (
        F.when(size == 1, F.concat(said, F.lit(" 'more'")))
        .when(size == 2, F.concat(F.lit(" "), said))
        .when(size == 3, F.concat(F.lit('aoi "'), name, F.lit('x"')))
        .when(size == 4, F.concat(F.lit("# "), said))
        .otherwise(F.concat(said, F.lit(" # 'comment'")))
    )
    stands = render.literal_stands(string_literals(code), F.lit(4), F.length(name) + 6, name)
    return table(spark, sf_dir, "part").select("p_partkey", stands.alias("stands"))


@query("""
SELECT doc_id, 'low_confidence' AS outcome FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN nfc_normalize(text) ELSE ' ' || text END AS t FROM documents) WHERE nfc_normalize(t) = nfc_normalize(text)
""")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("source_text"), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit(" "), "text")).otherwise(F.col("text")).alias("target_text")
    )
    return quality.assessed(rows).where("outcome = 'low_confidence'").select("doc_id", "outcome")


LOG = "element_at(array('Ren''Py 8.3.4.24120703', 'Full traceback:', 'error: bad indent', 'lint ok', 'version 7.4'), CAST(event_id % 5 AS INT) + 1)"


@query(r"""
SELECT event_id, regexp_extract(line, '([0-9]+\.[0-9]+(?:\.[0-9]+)*)', 1) AS version, regexp_matches(lower(line), 'traceback|error:') AS fatal
FROM (SELECT event_id, ['Ren''Py 8.3.4.24120703', 'Full traceback:', 'error: bad indent', 'lint ok', 'version 7.4'][event_id % 5 + 1] AS line FROM events)
""")
def log_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version and fatal markers in the output of an external validator."""
    line = F.expr(LOG)
    markers = F.array(F.lit("traceback"), F.lit("error:"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract(line, r"([0-9]+\.[0-9]+(?:\.[0-9]+)*)", 1).alias("version"), F.exists(markers, lambda m: F.lower(line).contains(m)).alias("fatal")
    )


@query(r"""
SELECT page_id, nullif(array_to_string(regexp_extract_all(regexp_extract(html, 'version_tuple *= *\(([0-9]+), *([0-9]+), *([0-9]+)'), '[0-9]+'), '.'), '') AS version
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'version_tuple = (8, ' || page_id % 5 || ', 3, vc_version)' ELSE html END AS html FROM pages)
""")
def version_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr("CASE WHEN page_id % 2 = 0 THEN 'version_tuple = (8, ' || page_id % 5 || ', 3, vc_version)' ELSE html END")
    part = lambda i: F.regexp_extract(html, r"version_tuple *= *\(([0-9]+), *([0-9]+), *([0-9]+)", i)
    version = F.concat_ws(".", part(1), part(2), part(3))
    return table(spark, sf_dir, "pages").select("page_id", F.when(part(1) != "", version).alias("version"))
