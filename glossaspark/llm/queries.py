"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import secret_scan
from .common import scratch_path
from .filter_audit import text_filter_audit
from .metric_join import jaccard_join
from .near_dedup import near_duplicates
from .packing import packed_batches
from .quality_rules import quality_rules
from .quotations import as_mails, link_quotations, reply_order
from .separator_scan import separator_scan, write_token_files
from .source_mix import mix_sources
from .substring_dedup import remove_repeats
from .surrogates import with_surrogates
from .token_alignment import align_tokens
from .topk_search import quantised, top_k_inner_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def _components_oracle(shingle: int, percent: int, more: str) -> str:
    """Every pair that shares a shingle is counted, components by all that is reachable."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + {shingle} - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle} + 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), b AS (
  SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), e AS (
  SELECT u, v FROM b JOIN n a ON a.doc_id = u JOIN n z ON z.doc_id = v WHERE 100 * shared >= {percent} * (a.n + z.n - shared)
), l AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id{more} FROM c LEFT JOIN n USING (doc_id)
"""


ORACLES["op5_minhash_near_dedup"] = _components_oracle(4, 80, ", doc_id = component_id AS kept")


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op7_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM s
), f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS o FROM g
), c AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 13)))) AS gone FROM f WHERE doc_id > o GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
         array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ') AS kept
  FROM d LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), max_host_docs=corpus_pipeline.LINE_DOCS)


ORACLES["op9_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)
), r AS (
  SELECT rid, count(DISTINCT q) AS n_repeat
  FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n >= 2)
  GROUP BY rid
), x AS (
  SELECT rid, host, coalesce('d' || doc_id, 'r' || rid) AS doc, unnest(list_transform(l, lambda y: trim(regexp_replace(lower(y), '[\x20\x09-\x0D]+', ' ', 'g')))) AS line FROM w
), f AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT doc) AS n FROM x GROUP BY host, line)
  JOIN (SELECT host, count(DISTINCT coalesce('d' || doc_id, 'r' || rid)) AS docs FROM d GROUP BY host) USING (host)
  WHERE n > 30 OR n > 10 AND n * 100 > docs * 10
), y AS (
  SELECT rid, sum(len(string_split(line, ' '))) AS words_lost, count(*) AS lines_lost FROM x JOIN f USING (host, line) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(words_lost, 0) AS BIGINT) AS n_lost_words, CAST(coalesce(lines_lost, 0) AS BIGINT) AS n_lost_lines
  FROM w LEFT JOIN r USING (rid) LEFT JOIN y USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * (n_words - n_lost_words) >= 50 * n_words AS kept FROM b
"""


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"),
        secret_scan.spelled(F.col("spans")).alias("spans"),
    )


def _matches(kind: str, order: int, pattern: str, more: str = "true") -> str:
    return f"""
  SELECT rid, {order} AS o, '{kind}' AS kind, m[i] AS s, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT rid, m, v, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, {"regexp_extract_all(t, '" + pattern + "', 2)" if order == 0 else "NULL"} AS v, regexp_split_to_array(t, '{pattern}') AS g FROM d))
  WHERE {more}"""


def _secret_oracle() -> str:
    q = lambda p: p.replace("'", "''")
    weights = ", ".join(str(secret_scan._weight(i)) for i in range(secret_scan.WINDOW + 1))
    allowed = " OR ".join(f"regexp_matches(s, '{q(p)}')" for p in secret_scan.ALLOWED)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), b AS ({_matches("assign", 0, q(secret_scan.ASSIGN), "length(v[i]) >= 12")}
  UNION ALL {_matches("access", 1, q(secret_scan.ACCESS))}
  UNION ALL {_matches("hex", 2, q(secret_scan.HEX))}
), base AS (SELECT rid, o, kind, CAST(a AS BIGINT) AS a, CAST(a + length(s) AS BIGINT) AS z FROM b
), c AS (SELECT * FROM ({_matches("entropy", 3, secret_scan.CANDIDATE)}) WHERE NOT ({allowed})
), win AS (
  SELECT rid, a, p, string_split(w, '') AS ch,
         CASE WHEN regexp_full_match(w, '[0-9a-fA-F]+') THEN {secret_scan.most_weight(secret_scan.HEX_BITS)} ELSE {secret_scan.most_weight(secret_scan.MIXED_BITS)} END AS most
  FROM (SELECT *, substr(s, p, 20) AS w FROM (SELECT *, unnest(range(1, length(s) - 18)) AS p FROM c))
  WHERE regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9+/]') AND NOT (contains(w, '/') AND regexp_matches(s, '{secret_scan.PATH.replace("++", "+")}'))
), e AS (
  SELECT rid, 3 AS o, 'entropy' AS kind, CAST(a + min(p) - 1 AS BIGINT) AS a, CAST(a + max(p) + 19 AS BIGINT) AS z FROM win
  WHERE list_sum(list_transform(list_distinct(ch), lambda k: [{weights}][1 + len(list_filter(ch, lambda x: x = k))])) <= most
  GROUP BY rid, c_id(a), a
), more AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM base k WHERE k.rid = e.rid AND k.a <= e.a AND k.z >= e.z)
), al AS (SELECT * FROM base UNION ALL SELECT * FROM more
), r AS (
  SELECT rid, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2,
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o, z) FILTER (o < 3) AS bs,
         string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o, z) AS sp
  FROM al GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN r USING (rid)
""".replace("c_id(a), ", "")


ORACLES["op4_secret_scan"] = _secret_oracle()


@_query
def op10_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k_inner_products(vectors, vectors.where("vec_id % 50 = 0"), k=5)


ORACLES["op10_exact_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * p.v[i])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)
    return found.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op1_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_batches(_table(spark, sf_dir, "documents"), max_tokens=4096, budget=32768, buckets=16)


#: Where the vocabulary of the token counts lies; any file of ranks will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@_query
def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scratch_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), files, vocabulary=VOCABULARY)
    found = separator_scan(spark, files)
    return found.select(F.regexp_extract("file", r"/part-(\d+)", 1).cast("int").alias("part"), F.regexp_extract("file", r"^piece=(\d+)/", 1).cast("int").alias("piece"), "doc_no", "start", "n_tokens", "closed")


#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = b"glossaspark surrogates"


@_query
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(_table(spark, sf_dir, "documents"), key=SURROGATE_KEY)


@_query
def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table quotes nothing, so its turns first become mails that quote each other."""
    return reply_order(link_quotations(as_mails(_table(spark, sf_dir, "conversations"))))


#: The links that the mails were made with, and the texts as they were before.
ORACLES["op8_quotation_linking"] = r"""
WITH m AS (
  SELECT *, turn % 4 > 0 AND regexp_matches(lag(text) OVER w, '\S') AND lag(turn) OVER w = turn - 1 AS answers
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), t AS (
  SELECT *, max(CASE WHEN coalesce(answers, false) THEN NULL ELSE turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS thread_turn FROM m
)
SELECT conv_id, turn, role, text,
       CAST(CASE WHEN NOT coalesce(answers, false) THEN 0 WHEN turn - thread_turn > 1 THEN 2 ELSE 1 END AS BIGINT) AS n_quoted,
       CAST(CASE WHEN answers THEN turn - 1 END AS BIGINT) AS parent_turn, CAST(thread_turn AS BIGINT) AS thread_turn,
       CAST(turn - thread_turn AS INTEGER) AS depth,
       CAST(row_number() OVER (PARTITION BY conv_id, thread_turn ORDER BY turn) - 1 AS BIGINT) AS position
FROM t
"""


@_query
def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLES["op11_filter_interaction_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END AS fa,
         CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 1 ELSE 0 END AS fb,
         CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 1 ELSE 0 END AS fc,
         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS fd,
         CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS fe
  FROM w LEFT JOIN l USING (doc_id)
), h AS (
  SELECT part, good, toxic, fa, fb, fc, fd, fe, count(*) AS n FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), v AS (
  SELECT part, good, toxic, n, fa + fb + fc + fd + fe AS fails, filter_order, step, filter,
         CASE filter WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS failing,
         greatest(fa * CAST(contains(earlier, 'A') AS INTEGER), fb * CAST(contains(earlier, 'B') AS INTEGER), fc * CAST(contains(earlier, 'C') AS INTEGER),
                  fd * CAST(contains(earlier, 'D') AS INTEGER), fe * CAST(contains(earlier, 'E') AS INTEGER)) AS gone
  FROM h, s
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
         coalesce(sum(n) FILTER (gone = 0 AND failing = 0), 0) AS kept, coalesce(sum(n) FILTER (gone = 0 AND failing = 1), 0) AS removed,
         coalesce(sum(n) FILTER (gone = 1 AND failing = 1), 0) AS redundant, coalesce(sum(n) FILTER (failing = 1 AND fails = 1), 0) AS unique_fails,
         coalesce(sum(n) FILTER (gone = 0 AND failing = 1 AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (gone = 0 AND failing = 1 AND toxic = 1), 0) AS toxic_lost
  FROM v GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
"""


@_query
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


ORACLES["op12_ngram_jaccard_join"] = _components_oracle(3, 90, ", doc_id = component_id AS kept")


#: Vocabularies of the alignment; any byte-level and any sentencepiece file will do.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@_query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
