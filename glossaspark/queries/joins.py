"""Joins, covers, sets, aggregates and sequences over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.unicode import path_key
from ..operators import digest_tree, matching, quality, render, sequences, store, tasks
from ..sources.projects import by_parts
from ..storage import scratch_path
from .registry import query, table

LINES = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linestatus, l_returnflag, l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a task (order) with their place, from 0."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity", (F.row_number().over(order) - 1).cast("long").alias("n")
    )


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segments = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text"), F.col("lang").alias("kind"))
    twice = segments.where("doc_id % 5 = 0").select((F.col("doc_id") + 1_000_000).alias("entry_id"), "source_text", "kind")
    entries = segments.select(F.col("doc_id").alias("entry_id"), F.when(F.col("doc_id") % 7 == 0, F.concat("source_text", F.lit("?"))).otherwise(F.col("source_text")).alias("source_text"), "kind")
    return segments, entries.unionByName(twice)


ENTRIES = """
WITH s AS (SELECT doc_id, text AS source_text, lang AS kind FROM documents),
e AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 7 = 0 THEN source_text || '?' ELSE source_text END AS source_text, kind FROM s
      UNION ALL SELECT doc_id + 1000000, source_text, kind FROM s WHERE doc_id % 5 = 0),
u AS (SELECT source_text, kind, min(doc_id) AS doc_id FROM s GROUP BY source_text, kind HAVING count(*) = 1),
f AS (SELECT source_text, kind, min(entry_id) AS entry_id FROM e GROUP BY source_text, kind),
m AS (SELECT doc_id, entry_id FROM u JOIN f USING (source_text, kind))
"""


@query(ENTRIES + "SELECT doc_id, entry_id FROM m")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, entries = _entries(spark, sf_dir)
    return matching.unique_match(segments, entries, ["source_text", "kind"], "entry_id").select("doc_id", "entry_id")


@query(ENTRIES + "SELECT entry_id FROM e WHERE entry_id NOT IN (SELECT entry_id FROM m)")
def unmatched_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, entries = _entries(spark, sf_dir)
    found = matching.unique_match(segments, entries, ["source_text", "kind"], "entry_id")
    return matching.unmatched(entries, found.select("entry_id"), "entry_id").select("entry_id")


@query(ENTRIES + "SELECT doc_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM m)")
def unmatched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, entries = _entries(spark, sf_dir)
    found = matching.unique_match(segments, entries, ["source_text", "kind"], "entry_id")
    return matching.unmatched(segments, found.select("doc_id"), "doc_id").select("doc_id")


@query("""
WITH b AS (SELECT text, count(*) AS n, min(item_id) AS item_id FROM benchmark GROUP BY text)
SELECT b.item_id, d.doc_id FROM b JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1) d ON d.text = b.text WHERE n = 1
UNION ALL SELECT item_id, NULL FROM b WHERE n = 1 AND text NOT IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)
""")
def benchmark_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    single = table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    items = table(spark, sf_dir, "benchmark").groupBy("text").agg(F.count("*").alias("k"), F.min("item_id").alias("item_id")).where("k = 1")
    return items.join(single, "text", "left").select("item_id", "doc_id")


@query("""
WITH c AS (SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations)
SELECT m.conv_id, m.turn, c.text AS speaker_display FROM conversations m LEFT JOIN c ON c.conv_id = m.conv_id AND c.role = m.role AND c.r = 1 AND c.role <> 'system'
""")
def speaker_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are defined per file, and the last definition counts."""
    rows = table(spark, sf_dir, "conversations")
    defined = rows.where("role <> 'system'").groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))
    return rows.drop("text").join(defined, ["conv_id", "role"], "left").select("conv_id", "turn", F.col("text").alias("speaker_display"))


@query(f"""
WITH l AS ({LINES}), s AS (SELECT l_orderkey AS task_id, n // 2 AS b, 'seg_' || l_orderkey || '_' || n AS seg, sha256(CAST(l_partkey AS VARCHAR)) AS sha, l_linestatus AS lang, n FROM l)
SELECT task_id, n, CASE WHEN n % 11 = 10 OR task_id % 17 = 0 THEN 'schema_version' WHEN n % 5 = 4 THEN 'batch_id' WHEN n % 7 = 6 THEN 'segment_id' WHEN task_id % 19 = 0 THEN 'source_schema_version' WHEN task_id % 13 = 0 THEN 'source_sha256'
  WHEN task_id % 23 = 0 THEN 'target_language' WHEN task_id % 29 = 0 THEN 'protected_tokens' WHEN task_id % 9 = 0 THEN 'target_tokens' END AS error_code FROM s
""")
def proposal_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some proposals hold a wrong value, others none at all."""
    lines = _lines(spark, sf_dir)
    kind = "array<struct<index:int,kind:string,value:string>>"
    tokens = F.array(F.struct(F.lit(0).alias("index"), F.lit("interpolation").alias("kind"), F.lit("[n]").alias("value"))).cast(kind)
    segments = lines.select(
        F.col("l_orderkey").alias("task_id"),
        F.floor(F.col("n") / 2).cast("string").alias("batch_id"),
        F.concat_ws("_", F.lit("seg"), F.col("l_orderkey").cast("string"), F.col("n").cast("string")).alias("segment_id"),
        F.lit("renpy").alias("engine"),
        F.lit(1).alias("source_schema_version"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("source_sha256"),
        F.lit("schinese").alias("target_language"),
        tokens.alias("protected_tokens"),
        "n",
    )
    n, task = F.col("n"), F.col("task_id")
    proposals = segments.select(
        "task_id",
        F.when(n % 5 == 4, "none").otherwise(F.col("batch_id")).alias("batch_id"),
        F.when(n % 7 == 6, F.concat(F.lit("x"), "segment_id")).otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(task % 17 != 0, F.when(n % 11 == 10, 2).otherwise(1)).alias("schema_version"),
        F.when(task % 19 != 0, F.col("source_schema_version")).alias("source_schema_version"),
        F.when(task % 13 == 0, F.lit("0")).otherwise(F.col("source_sha256")).alias("source_sha256"),
        F.when(task % 23 != 0, F.col("target_language")).alias("target_language"),
        F.when(task % 29 != 0, F.col("protected_tokens")).alias("protected_tokens"),
        F.when(task % 9 != 0, F.lit("hello [n]")).otherwise(F.when(task % 2 == 0, F.lit("none"))).alias("target_text"),
        "n",
    )
    return tasks.validated(proposals, segments.drop("n")).select("task_id", "n", "error_code")


COVER = f"""
WITH l AS ({LINES}), need AS (SELECT l_orderkey AS task_id, n, l_partkey AS v FROM l),
given AS (SELECT task_id, n, CASE WHEN task_id % 10 = 3 THEN v + 1 ELSE v END AS v FROM need WHERE NOT (task_id % 10 = 1 AND n = 0)
  UNION ALL SELECT task_id, n + 100, v FROM need WHERE task_id % 10 = 2 AND n = 0 UNION ALL SELECT task_id, n, v FROM need WHERE task_id % 10 = 4 AND n = 0),
g AS (SELECT task_id, n, count(*) AS k, min(v) AS gv FROM given GROUP BY task_id, n),
j AS (SELECT coalesce(need.task_id, g.task_id) AS task_id, need.n AS nn, g.n AS gn, k, v, gv FROM need FULL JOIN g ON g.task_id = need.task_id AND g.n = need.n)
SELECT task_id, count(*) FILTER (gn IS NULL) AS missing, count(*) FILTER (nn IS NULL) AS unknown, count(*) FILTER (k > 1) AS repeated, count(*) FILTER (nn IS NOT NULL AND gn IS NOT NULL AND v <> gv) AS different,
  count(*) FILTER (gn IS NULL OR nn IS NULL OR k > 1 OR v <> gv) = 0 AS accepted FROM j GROUP BY task_id
"""


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("task_id"), "n", F.col("l_partkey").alias("v"))
    kind = F.col("task_id") % 10
    given = need.where(~((kind == 1) & (F.col("n") == 0))).withColumn("v", F.when(kind == 3, F.col("v") + 1).otherwise(F.col("v")))
    first = need.where("n = 0")
    extra = first.where(kind == 2).withColumn("n", F.col("n") + 100).unionByName(first.where(kind == 4))
    return matching.cover(need, given.unionByName(extra), ["task_id"], "n", ["v"])


@query(COVER)
def batch_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cover(spark, sf_dir)


@query(COVER.replace("SELECT task_id, count(*) FILTER (gn IS NULL) AS missing", "SELECT task_id FROM (SELECT task_id, count(*) FILTER (gn IS NULL) AS missing") + ") WHERE NOT accepted")
def mapping_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose mappings don't cover their segments."""
    return _cover(spark, sf_dir).where(~F.col("accepted")).select("task_id")


@query(f"""
WITH l AS ({LINES}), a AS (SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY n) AS x, string_agg(CASE WHEN l_orderkey % 6 = 0 THEN l_suppkey ELSE l_partkey END, ',' ORDER BY n) AS y FROM l GROUP BY l_orderkey)
SELECT l_orderkey, x = y AS agree FROM a
""")
def checkpoint_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a task in order against those in its checkpoint."""
    second = F.when(F.col("l_orderkey") % 6 == 0, F.col("l_suppkey")).otherwise(F.col("l_partkey"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda r: r[c])
    rows = _lines(spark, sf_dir).withColumn("second", second)
    return rows.groupBy("l_orderkey").agg((listed("l_partkey") == listed("second")).alias("agree"))


@query("""
SELECT b.conv_id, b.turn AS batch_index, a.role = b.role AND a.text = b.text AS aligned
FROM conversations b LEFT JOIN (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN turn + 1 ELSE turn END AS turn, role, text FROM conversations) a ON a.conv_id = b.conv_id AND a.turn = b.turn
""".replace("a.role = b.role AND a.text = b.text AS aligned", "coalesce(a.role = b.role AND a.text = b.text, false) AS aligned"))
def checkpoint_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    stored = rows.select("conv_id", F.when(F.col("conv_id") % 4 == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"), F.col("role").alias("r"), F.col("text").alias("t"))
    aligned = F.coalesce((F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), F.lit(False))
    return rows.join(stored, ["conv_id", "turn"], "left").select("conv_id", F.col("turn").alias("batch_index"), aligned.alias("aligned"))


@query("""
SELECT l.l_orderkey, count(*) AS n, count(*) FILTER (p.p_partkey IS NULL) AS missing, count(*) FILTER (p.p_size > 25) AS different FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS k FROM lineitem) l LEFT JOIN part p ON p.p_partkey = l.k GROUP BY l.l_orderkey
""")
def fk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to accepted rows: missing ones, and ones with other content."""
    key = F.when(F.col("l_orderkey") % 10 == 0, F.col("l_partkey") + 1_000_000).otherwise(F.col("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", key.alias("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(True).alias("known"))
    return rows.join(parts, "p_partkey", "left").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("missing"), F.count_if(F.col("p_size") > 25).alias("different")
    )


@query("""
WITH a AS (SELECT conv_id, list(turn || role ORDER BY turn) AS x FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, x, CASE conv_id % 3 WHEN 0 THEN x WHEN 1 THEN list_reverse(x) ELSE x[1:1] END AS y FROM a)
SELECT conv_id, len(x) = len(y) AND x = y AS accepted FROM b
""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply's items stand at the places of the request's."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    x = F.transform("x", lambda r: F.concat(r["turn"].cast("string"), r["role"]))
    kind = F.col("conv_id") % 3
    zipped = rows.select("conv_id", x.alias("x"), F.when(kind == 0, x).when(kind == 1, F.reverse(x)).otherwise(F.slice(x, 1, 1)).alias("y"))
    return zipped.select("conv_id", F.forall(F.arrays_zip("x", "y"), lambda z: z["x"].eqNullSafe(z["y"])).alias("accepted"))


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(lower(text)) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 8 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = docs.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    after = docs.where("doc_id % 8 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.lower("text")).otherwise(F.col("text")), 256).alias("h"))
    return matching.changed(before, after, "doc_id", "h")


@query("""
WITH a AS (SELECT concat(coalesce(source, ''), '/', coalesce(lang, ''), '/', doc_id) AS path, sha256(text) AS h, doc_id, source, text FROM documents), b AS (SELECT path, CASE WHEN source = (SELECT min(source) FROM documents) AND doc_id % 4 = 0 THEN sha256(concat(text, ' ')) ELSE h END AS h FROM a WHERE source <> (SELECT max(source) FROM documents) OR doc_id % 5 > 0 OR source IS NULL)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h
""")
def staged_export_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored snapshots of an export, compared by branches of folders: one source is edited, one loses files."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select(path.alias("path"), "doc_id", "source", "text")
    first, last = docs.agg(F.min("source"), F.max("source")).first()
    edited = (F.col("source") == first) & (F.col("doc_id") % 4 == 0)
    gone = F.coalesce((F.col("source") == last) & (F.col("doc_id") % 5 == 0), F.lit(False))
    before, after = scratch_path(spark, "export-before"), scratch_path(spark, "export-after")
    digest_tree.store(docs.select("path", F.sha2("text", 256).alias("digest")), before)
    after_text = F.when(edited, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    digest_tree.store(docs.where(~gone).select("path", F.sha2(after_text, 256).alias("digest")), after)
    return digest_tree.changes(spark, before, after)


@query("""
SELECT o_orderkey, coalesce(s, o_orderstatus) AS status FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'running' ELSE 'completed' END AS s FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def batch_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of batches replaced by id."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    open_ = F.when(F.count_if(F.col("l_linestatus") == "O") > 0, "running").otherwise("completed")
    return matching.replaced(orders, lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(open_.alias("status")), "o_orderkey")


EXTENTS = "SELECT l_orderkey, l_suppkey * 7 % 90 AS start, CAST(l_quantity AS BIGINT) % 9 + 1 AS size FROM lineitem"


@query(f"""
WITH e AS ({EXTENTS}) SELECT l_orderkey, start, size, coalesce(start < max(start + size) OVER (PARTITION BY l_orderkey ORDER BY start, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM e
""")
def extent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_suppkey * 7 % 90 AS start", "CAST(l_quantity AS BIGINT) % 9 + 1 AS size")
    return sequences.overlaps(rows, "l_orderkey", "start", "size")


@query("""
SELECT l_orderkey, l_linenumber, xor(xor(l_partkey, 1111638594), 1111638594) AS start, CAST(l_quantity AS BIGINT) AS size, l_partkey >= 40 AND l_partkey + CAST(l_quantity AS BIGINT) <= 1500 AS inside FROM lineitem
""")
def xor_extent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive extents, decoded and held against the data region."""
    key = F.lit(0x42424242).cast("long")
    stored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").bitwiseXOR(key).alias("hidden"), F.col("l_quantity").cast("long").alias("size"))
    start = F.col("hidden").bitwiseXOR(key)
    return stored.select("l_orderkey", "l_linenumber", start.alias("start"), "size", ((start >= 40) & (start + F.col("size") <= 1500)).alias("inside"))


@query("""
WITH p AS (SELECT DISTINCT split_part(url, '/', 3) AS host, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '\\?.*$', '') AS path FROM pages), r AS (SELECT DISTINCT host, '/' || split_part(path, '/', 2) AS root FROM p)
SELECT p.host, p.path, r.root FROM p JOIN r ON p.host = r.host AND (p.path = r.root OR starts_with(p.path, r.root || '/') OR starts_with(r.root, p.path || '/'))
""")
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and the roots above or below them, of the same host."""
    pages = table(spark, sf_dir, "pages").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), r"\?.*$", "").alias("path")
    ).distinct()
    roots = pages.select("host", F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2))).alias("root")).distinct()
    return matching.contained(pages, roots, "host", "path", "root")


@query("""
SELECT k AS path_key, count(*) AS n FROM (SELECT lower(CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '/' || lang || '.rpy') AS k FROM documents) GROUP BY k HAVING count(*) > 1
""")
def path_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("/"), F.col("lang"), F.lit(".rpy"))
    return matching.repeated_keys(table(spark, sf_dir, "documents").select(path_key(path).alias("path_key")), "path_key")


@query("SELECT role, text, count(*) AS n FROM conversations GROUP BY role, text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.repeated_keys(table(spark, sf_dir, "conversations"), "role", "text")


@query("""
SELECT k AS custkey, CASE WHEN side_a THEN 'a' ELSE 'b' END AS side FROM (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS side_a, b.k IS NOT NULL AS side_b FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING') b ON a.k = b.k) WHERE side_a <> side_b
""")
def set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps two key sets from being equal; empty when they are."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    b = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    return matching.set_difference(a, b, "custkey")


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'")
def new_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the later state that the earlier one doesn't have."""
    pairs = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey")
    after, before = pairs.where("l_returnflag = 'R'"), pairs.where("l_returnflag <> 'R'")
    return after.drop("l_returnflag").subtract(before.drop("l_returnflag"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS r FROM lineitem WHERE l_linestatus = 'F'), a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS r FROM lineitem WHERE l_returnflag <> 'N')
SELECT b.k AS l_orderkey, count(*) FILTER (a.k IS NULL) = 0 AS kept FROM b LEFT JOIN a ON a.k = b.k AND a.r = b.r GROUP BY b.k
""")
def references_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No reference of the earlier checkpoint is missing in the later one."""
    lines = table(spark, sf_dir, "lineitem")
    before = lines.where("l_linestatus = 'F'").select("l_orderkey", "l_suppkey").distinct()
    after = lines.where("l_returnflag <> 'N'").select("l_orderkey", "l_suppkey", F.lit(True).alias("there")).distinct()
    return before.join(after, ["l_orderkey", "l_suppkey"], "left").groupBy("l_orderkey").agg((F.count_if(F.col("there").isNull()) == 0).alias("kept"))


@query("SELECT 'compiled' AS reason, source || '!' || doc_id AS name FROM documents WHERE lang = 'de' UNION ALL SELECT 'translation', source || '!' || doc_id FROM documents WHERE lang = 'fr'")
def ignored_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.concat_ws("!", "source", F.col("doc_id").cast("string")).alias("name"))
    part = lambda lang, reason: docs.where(F.col("lang") == lang).select(F.lit(reason).alias("reason"), "name")
    return part("de", "compiled").unionByName(part("fr", "translation"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, text FROM conversations")
def flatten_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = tasks.task_batches(table(spark, sf_dir, "conversations"), ["conv_id"], "text", "turn", 3)
    nested = batches.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("batch_index", "segment_ids"))).alias("b"))
    return nested.select("conv_id", F.posexplode(F.flatten(F.transform("b", lambda b: b["segment_ids"]))).alias("position", "text"))


@query("SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source")
def stable_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.stable_distinct(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("""
SELECT lang, total_docs, total_docs > 100 AS limit_reached FROM (SELECT lang, count(*) AS total_docs FROM documents GROUP BY lang)
""")
def entry_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("total_docs")).withColumn("limit_reached", F.col("total_docs") > 100)


@query("""
SELECT source, doc_id, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 65536 AS fits FROM documents
""")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.within_budget(table(spark, sf_dir, "documents"), "source", ["doc_id"], F.octet_length("text").cast("long"), 65536).select("source", "doc_id", "total", "fits")


@query("""
SELECT lang AS kind, count(*) AS ours, count(*) FILTER (doc_id % 7 <> 0) AS official, count(*) FILTER (doc_id % 7 = 0) AS missing, count(*) FILTER (doc_id % 7 = 0) = 0 AS matches FROM documents GROUP BY lang
""")
def crosscheck_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("doc_id") % 7 == 0
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(
        F.count("*").alias("ours"), F.count_if(~gone).alias("official"), F.count_if(gone).alias("missing"), (F.count_if(gone) == 0).alias("matches")
    )


@query("SELECT l_orderkey, count(*) AS n_segments, count(*) FILTER (l_linestatus = 'F') AS n_completed, CAST(ceil(count(*) / 2.0) AS BIGINT) AS n_batches FROM lineitem GROUP BY l_orderkey")
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_segments"), F.count_if(F.col("l_linestatus") == "F").alias("n_completed"), F.ceil(F.count("*") / 2).cast("long").alias("n_batches")
    )


CHOICES = "CASE WHEN p_size % 3 = 0 THEN true ELSE false END"


@query(f"""
SELECT 'game/tl/schinese/' || f AS relative_path, f AS template_file, to_json(list('seg_' || p_partkey ORDER BY late, p_partkey))::VARCHAR AS segment_ids,
  coalesce(string_agg(c, '' ORDER BY p_partkey) FILTER (NOT late), '') || CASE WHEN bool_or(late) THEN 'translate schinese strings:' || chr(10) || chr(10) ELSE '' END || coalesce(string_agg(c, '' ORDER BY p_partkey) FILTER (late), '') AS content
FROM (SELECT p_partkey, lower(replace(p_brand, '#', '')) || '.rpy' AS f, {CHOICES} AS late, p_name || chr(10) AS c FROM part) GROUP BY f
""")
def assemble_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = table(spark, sf_dir, "part").select(
        F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".rpy")).alias("template_file"),
        F.concat(F.lit("seg_"), F.col("p_partkey").cast("string")).alias("segment_id"),
        F.expr(CHOICES).alias("requires_strings_header"),
        F.concat("p_name", F.lit("\n")).alias("content"),
        F.col("p_partkey").alias("ordinal"),
    )
    return render.files(fragments, "schinese").withColumn("segment_ids", F.to_json("segment_ids"))


QUALITY = "SELECT conv_id, turn, CASE WHEN nfc_normalize(text) = nfc_normalize(CASE WHEN (conv_id + turn) % 4 = 0 THEN text ELSE text || '.' END) THEN 'low_confidence' ELSE 'clear' END AS outcome FROM conversations"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    target = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    return quality.assessed(rows.withColumn("source_text", F.col("text")).withColumn("target_text", target))


@query(QUALITY)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("conv_id", "turn", "outcome")


@query(f"""
WITH q AS ({QUALITY}) SELECT conv_id, CASE WHEN bool_or(outcome = 'low_confidence') THEN 'low_confidence' ELSE 'clear' END AS outcome, count(*) AS n, coalesce(string_agg(turn, ',' ORDER BY turn) FILTER (outcome = 'low_confidence'), '') AS low FROM q GROUP BY conv_id
""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.summary(_quality(spark, sf_dir), "conv_id", "turn", "turn")
    return found.select("conv_id", "outcome", "n", F.array_join(F.col("low_confidence_ids").cast("array<string>"), ",").alias("low"))


@query(f"""
WITH q AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 0 ELSE 1 END AS n_findings FROM ({QUALITY}))
SELECT conv_id, count(*) FILTER ((outcome = 'low_confidence') <> (n_findings > 0)) = 0 AND count(DISTINCT turn) = count(*) AND max(turn) = count(*) - 1 AS valid FROM q GROUP BY conv_id
""")
def quality_report_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes agree with findings; segments are unique and without gaps."""
    findings = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), 0).otherwise(1)
    wrong = (F.col("outcome") == "low_confidence") != (findings > 0)
    return _quality(spark, sf_dir).groupBy("conv_id").agg(
        ((F.count_if(wrong) == 0) & (F.count_distinct("turn") == F.count("*")) & (F.max("turn") == F.count("*") - 1)).alias("valid")
    )


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scene FROM conversations
""")
def scene_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("role") == "user", F.col("text"))
    return sequences.carried(table(spark, sf_dir, "conversations"), "conv_id", "turn", label, "scene").select("conv_id", "turn", "scene")


@query("SELECT conv_id, count(*) FILTER (turn <> n) = 0 AS contiguous FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM (SELECT * FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1))) GROUP BY conv_id")
def index_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("NOT (conv_id % 3 = 0 AND turn = 1)")
    placed = sequences.occurrences(rows, ["conv_id"], "turn", "n")
    return placed.groupBy("conv_id").agg((F.count_if(F.col("turn") != F.col("n")) == 0).alias("contiguous"))


@query(f"""
WITH e AS (SELECT *, lag(start + size) OVER (PARTITION BY l_orderkey ORDER BY start, size) AS prev FROM ({EXTENTS})) SELECT l_orderkey, count(*) FILTER (start < prev) = 0 AS monotonic FROM e GROUP BY l_orderkey
""")
def span_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_suppkey * 7 % 90 AS start", "CAST(l_quantity AS BIGINT) % 9 + 1 AS size")
    return sequences.overlaps(rows, "l_orderkey", "start", "size").groupBy("l_orderkey").agg((F.count_if("overlaps") == 0).alias("monotonic"))


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM p
""")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.change_points(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""
WITH b AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n FROM b WHERE event_type IN ('view', 'click', 'signup') GROUP BY user_id, run HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 86400000000
""")
def stable_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("event_type").isin("view", "click", "signup")
    return sequences.stable_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", good, 86_400)


@query("""
SELECT o_orderkey, o_orderstatus, true AS found FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT DISTINCT l_orderkey, NULL, false FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
""")
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of the keys asked for, and keys that aren't stored."""
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    stored = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(True).alias("found"))
    return keys.join(stored, "o_orderkey", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("""
SELECT l_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN o_orderstatus = p THEN 'same' ELSE 'conflict' END AS outcome
FROM (SELECT l_orderkey, max(l_linestatus) AS p FROM lineitem GROUP BY l_orderkey) i LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') o ON o.o_orderkey = i.l_orderkey
""")
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("payload"))
    incoming = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("payload"))
    return store.upsert_outcome(stored, incoming, "l_orderkey", "payload").select("l_orderkey", "outcome")


@query("""
SELECT d.source || '/' || d.doc_id || '.rpyc' AS path FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL
""")
def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled files that should be there, minus those that are."""
    compiled = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".rpy"), F.lit("c"))
    docs = table(spark, sf_dir, "documents")
    present = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return matching.unmatched(docs.select(compiled.alias("path")), present.select(compiled.alias("path")), "path")


@query("SELECT source, count(*) AS n, min(source || '/' || doc_id || '.rpyc') AS first_path FROM documents GROUP BY source")
def compiled_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".rpy"), F.lit("c"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min(compiled).alias("first_path"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return matching.unmatched(table(spark, sf_dir, "orders").select("o_orderkey"), cached, "o_orderkey")


@query("""
SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey % 100) AS member FROM orders o
""")
def batch_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a batch belongs to its task, before its cache is read."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("batch"), F.lit(True).alias("member")).distinct()
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 100).alias("batch"))
    return asked.join(members, ["o_orderkey", "batch"], "left").select("o_orderkey", "o_custkey", F.coalesce("member", F.lit(False)).alias("member"))


SORTED = "concat(CASE doc_id % 3 WHEN 0 THEN 'a/x' WHEN 1 THEN 'a-b/x' ELSE 'A/y' END, '/', doc_id, '.rpy')"


@query(f"""
SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY string_split(path, '/')) AS position FROM (SELECT source, {SORTED} AS path FROM documents)
""")
def path_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by their parts, in each project."""
    rows = table(spark, sf_dir, "documents").select("source", F.expr(SORTED).alias("path")).withColumn("parts", by_parts(F.col("path")))
    return sequences.positions(rows, ["source"], ["parts"]).select("source", "path", "position")


@query(f"""
SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY lower(path), path) AS position FROM (SELECT source, {SORTED} AS path FROM documents)
""")
def casefold_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without regard to case, ties by the exact path."""
    rows = table(spark, sf_dir, "documents").select("source", F.expr(SORTED).alias("path"))
    return sequences.positions(rows.withColumn("folded", F.lower("path")), ["source"], ["folded", "path"]).select("source", "path", "position")


@query("""
WITH f AS (SELECT 'seg_' || CASE WHEN p_partkey % 50 = 7 THEN p_partkey - 1 ELSE p_partkey END AS s, CASE WHEN p_size % 3 > 0 THEN 'id_' || CASE WHEN p_partkey % 40 = 3 THEN p_partkey - 2 ELSE p_partkey END END AS t FROM part)
SELECT 'segment' AS what, s AS id, count(*) AS n FROM f GROUP BY s HAVING count(*) > 1 UNION ALL SELECT 'translation', t, count(*) FROM f WHERE t IS NOT NULL GROUP BY t HAVING count(*) > 1
""")
def repeated_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that keep the files of a language from being assembled."""
    key = F.col("p_partkey")
    return render.repeated(
        table(spark, sf_dir, "part").select(
            F.concat(F.lit("seg_"), F.when(key % 50 == 7, key - 1).otherwise(key).cast("string")).alias("segment_id"),
            F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("id_"), F.when(key % 40 == 3, key - 2).otherwise(key).cast("string"))).alias("translation_identifier"),
        )
    )


@query("""
SELECT 's' || o_orderkey AS segment_id, CAST(CASE WHEN o_orderkey % 11 = 1 THEN 0 WHEN o_orderkey % 11 = 2 THEN 2 ELSE 1 END AS BIGINT) AS n,
  CASE o_orderkey % 11 WHEN 1 THEN 'missing' WHEN 2 THEN 'repeated' WHEN 3 THEN 'task_id' WHEN 4 THEN 'source_sha256' WHEN 5 THEN 'proposal_id' WHEN 6 THEN 'target_language' WHEN 7 THEN 'proposal_id' END AS error FROM orders
UNION ALL SELECT 'x' || o_orderkey, 1, 'unknown' FROM orders WHERE o_orderkey % 11 = 8
""")
def quality_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations with each fault: texts changed after their identity was computed, no
    language, none at all."""
    key = F.col("o_orderkey")
    kind = "array<struct<index:int,kind:string,value:string>>"
    segments = table(spark, sf_dir, "orders").select(
        key.alias("k"),
        F.concat(F.lit("s"), key.cast("string")).alias("segment_id"),
        F.col("o_custkey").cast("string").alias("task_id"),
        F.col("o_orderpriority").alias("batch_id"),
        F.lit(1).alias("schema_version"),
        F.lit(1).alias("source_schema_version"),
        F.sha2("o_orderstatus", 256).alias("source_sha256"),
        F.lit("schinese").alias("target_language"),
        F.array().cast(kind).alias("protected_tokens"),
    )
    fault = F.col("k") % 11
    right = segments.withColumn("target_text", F.concat(F.lit("said "), "segment_id"))
    named = right.withColumn("proposal_id", quality.proposal_id())
    wrong = (
        named.where(fault != 1)
        .withColumn("task_id", F.when(fault == 3, F.lit("none")).otherwise(F.col("task_id")))
        .withColumn("source_sha256", F.when(fault == 4, F.lit("0")).otherwise(F.col("source_sha256")))
        .withColumn("target_text", F.when(fault == 5, F.lit("changed")).otherwise(F.col("target_text")))
        .withColumn("target_language", F.when(fault != 6, F.col("target_language")))
        .withColumn("proposal_id", F.when(fault != 7, F.col("proposal_id")))
    )
    extra = named.where(fault == 8).withColumn("segment_id", F.concat(F.lit("x"), F.col("k").cast("string")))
    return quality.coverage(segments.drop("k"), wrong.unionByName(wrong.where(fault == 2)).unionByName(extra))
