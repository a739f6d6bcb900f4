"""States, receipts, checkpoints and events over the driver tables.

Event types stand for statuses: view pending, click running, signup paused, error
failed, purchase completed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domains import TASK_MOVES
from ..operators import state, store
from ..operators.versioned import VersionedStore
from ..sources.compatibility import classify, status
from ..sources.events import valid_progress
from ..storage import scratch_path
from .registry import query, table

STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'paused' WHEN 'error' THEN 'failed' ELSE 'completed' END"
BATCH = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'completed' END"
RECEIPT = "CASE event_type WHEN 'view' THEN 'in_flight' WHEN 'click' THEN 'unknown' WHEN 'signup' THEN 'in_flight' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"
ALLOWED = "(" + " OR ".join(f"(p = '{a}' AND s IN ({', '.join(repr(x) for x in to)}))" for a, to in TASK_MOVES.items()) + ")"


def _events(spark: SparkSession, sf_dir: str, status: str = STATUS) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", "value", f"{status} AS s")
    return rows.withColumn("p", F.lag("s").over(before)).withColumn("n", F.row_number().over(before) - 1)


@query(f"""
WITH e AS (SELECT event_id, user_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT *, {STATUS} AS s FROM events))
SELECT event_id, p AS before, s AS after, {ALLOWED} AS allowed FROM e WHERE p IS NOT NULL
""")
def state_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("p IS NOT NULL")
    return rows.select("event_id", F.col("p").alias("before"), F.col("s").alias("after"), state.task_move_allowed(F.col("p"), F.col("s")).alias("allowed"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, {STATUS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'pending' AS p, 0::BIGINT AS applied, 0::BIGINT AS ignored FROM e
  UNION ALL SELECT r.user_id, e.n, CASE WHEN {ALLOWED} THEN s ELSE p END, applied + CASE WHEN {ALLOWED} THEN 1 ELSE 0 END, ignored + CASE WHEN {ALLOWED} THEN 0 ELSE 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, arg_max(p, n) AS state, max(applied) AS applied, max(ignored) AS ignored FROM r GROUP BY user_id
""")
def state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return state.replayed(rows, "user_id", ["ts", "event_id"], "s", "pending", TASK_MOVES, salt_rows=32)


@query("""
SELECT l_orderkey, count(*) AS n_batches, count(*) FILTER (s = 'completed') AS n_completed, bool_and(s = 'completed') AS all_completed, bool_or(s = 'failed') AS any_failed, bool_or(s = 'running') AS any_running,
  CASE WHEN bool_and(s = 'completed') THEN 'completed' WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'running') THEN 'running' ELSE 'pending' END AS implied_status
FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS s FROM lineitem) GROUP BY l_orderkey
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS s")
    return state.task_rollup(rows, "l_orderkey", "s")


@query("""
SELECT l_orderkey, min(n) FILTER (s = 'pending') AS first_pending, min(n) FILTER (s = 'running') AS first_running, min(n) FILTER (s = 'failed') AS first_failed
FROM (SELECT l_orderkey, l_partkey AS n, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'pending' ELSE CASE WHEN l_linestatus = 'O' THEN 'running' ELSE 'completed' END END AS s FROM lineitem) GROUP BY l_orderkey
""")
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey AS n", "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'pending' ELSE CASE WHEN l_linestatus = 'O' THEN 'running' ELSE 'completed' END END AS s")
    return state.next_batch(rows, "l_orderkey", "n", "s")


@query(f"""
WITH e AS (SELECT event_id, s, lag(s) OVER w AS p, CAST(floor(value) AS BIGINT) % 3 AS a, lag(CAST(floor(value) AS BIGINT) % 3) OVER w AS b FROM (SELECT *, {BATCH} AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, a = b + CASE WHEN p = 'pending' AND s = 'running' THEN 1 ELSE 0 END AS agrees FROM e WHERE p IS NOT NULL
""")
def attempt_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    attempts = F.floor("value").cast("long") % 3
    rows = _events(spark, sf_dir, BATCH).withColumn("a", attempts).withColumn("b", F.lag("a").over(order)).where("p IS NOT NULL")
    return rows.select("event_id", state.attempts_agree(F.col("p"), F.col("s"), F.col("b"), F.col("a")).alias("agrees"))


RECEIPTS = f"""
SELECT event_id, user_id, ts, {{'status': s, 'reference': CASE WHEN event_id % 4 <> 0 THEN 'p' || user_id END, 'n_proposals': CASE WHEN s = 'succeeded' THEN event_id % 2 + 1 ELSE 0 END, 'error': CASE WHEN s IN ('failed', 'unknown') THEN 'e' || event_id % 2 END}} AS r
FROM (SELECT *, {RECEIPT} AS s FROM events)
"""
MAY_FOLLOW = """
(p.reference IS NULL OR p.reference IS NOT DISTINCT FROM r.reference)
  AND (p IS NOT DISTINCT FROM r OR p.status IN ('in_flight', 'unknown') OR (p.status = 'failed' AND r.status = 'unknown' AND event_id % 3 = 0))
"""


def _provider_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as receipts of their user's request."""
    receipt = F.expr("""struct(s AS status, CASE WHEN event_id % 4 <> 0 THEN concat('p', user_id) END AS reference,
        CASE WHEN s = 'succeeded' THEN event_id % 2 + 1 ELSE 0 END AS n_proposals, CASE WHEN s IN ('failed', 'unknown') THEN concat('e', event_id % 2) END AS error)""")
    return _events(spark, sf_dir, RECEIPT).select("event_id", "user_id", "ts", receipt.alias("r"))


@query(f"""
WITH e AS (SELECT event_id, r, lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ({RECEIPTS}))
SELECT event_id, {MAY_FOLLOW} AS allowed FROM e WHERE p IS NOT NULL
""")
def receipt_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _provider_receipts(spark, sf_dir).withColumn("p", F.lag("r").over(order)).where("p IS NOT NULL")
    return rows.select("event_id", state.receipt_move_allowed(F.col("p"), F.col("r"), F.col("event_id") % 3 == 0).alias("allowed"))


LATEST = f"""
SELECT user_id, arg_max(s, (epoch_us(ts), event_id)) AS v FROM (SELECT *, {STATUS} AS s FROM events) WHERE user_id % 5 <> 0 GROUP BY user_id
"""


def _latest(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return _events(spark, sf_dir, status).where("user_id % 5 <> 0").groupBy("user_id").agg(F.max_by("s", F.struct("ts", "event_id")).alias("v"))


#: Outcomes against the stored value p, then the first change of a key wins.
CAS = """
, j AS (SELECT a.*, c.user_id IS NULL AS unknown, c.v AS p FROM a LEFT JOIN c USING (user_id)),
o AS (SELECT *, CASE WHEN unknown THEN 'missing' WHEN p IS DISTINCT FROM expected THEN 'stale' WHEN NOT (MAY) THEN 'refused' ELSE 'committed' END AS outcome FROM j),
w AS (SELECT *, min(CASE WHEN outcome = 'committed' AND p IS DISTINCT FROM r THEN event_id END) OVER (PARTITION BY user_id) AS winner FROM o)
"""
OUTCOMES = "SELECT event_id, CASE WHEN outcome <> 'missing' AND event_id > winner THEN 'stale' ELSE outcome END AS outcome FROM w"
STATES = "['pending', 'running', 'paused', 'failed', 'completed']"


@query(f"""
WITH c AS ({LATEST}), a AS (SELECT event_id, user_id, s AS r, {STATES}[event_id % 5 + 1] AS expected FROM (SELECT *, {STATUS} AS s FROM events))
{CAS.replace("MAY", ALLOWED.replace("s IN", "r IN"))} {OUTCOMES}
""")
def cas_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checkpoint_attempts(spark, sf_dir).select("event_id", "outcome")


def _checkpoint_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.expr("element_at(array('pending', 'running', 'paused', 'failed', 'completed'), CAST(event_id % 5 AS INT) + 1)")
    return _events(spark, sf_dir).select("event_id", "user_id", F.col("s").alias("v"), expected.alias("expected"))


def _checkpoint_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _checkpoint_tries(spark, sf_dir)
    return store.compare_and_set(_latest(spark, sf_dir, STATUS), attempts, "user_id", "v", "expected", "event_id", lambda a, b, _: state.task_move_allowed(a, b))


@query(f"""
WITH c AS ({LATEST}), a AS (SELECT event_id, user_id, s AS r, {STATES}[event_id % 5 + 1] AS expected FROM (SELECT *, {STATUS} AS s FROM events))
{CAS.replace("MAY", ALLOWED.replace("s IN", "r IN"))}, x AS (SELECT user_id, arg_min(r, event_id) AS r FROM w WHERE event_id = winner GROUP BY user_id)
SELECT c.user_id, coalesce(x.r, c.v) AS v, CASE WHEN x.r IS NULL THEN 1 ELSE 2 END AS version FROM c LEFT JOIN x USING (user_id)
""")
def checkpoint_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store that one session makes and another one commits the attempts to, read
    again: one winner for each version."""
    path = scratch_path(spark, "checkpoints")
    VersionedStore(spark, path, "user_id", "v").create(_latest(spark, sf_dir, STATUS))
    other = spark.newSession()
    attempts = _checkpoint_tries(other, sf_dir)
    VersionedStore(other, path, "user_id", "v").compare_and_set(attempts, "expected", "event_id", lambda a, b, _: state.task_move_allowed(a, b))
    return VersionedStore(spark, path, "user_id", "v").snapshot()


@query(f"""
WITH e AS ({RECEIPTS}), c AS (SELECT user_id, arg_max(r, (epoch_us(ts), event_id)) AS v FROM e WHERE user_id % 5 <> 0 GROUP BY user_id),
a AS (SELECT e.event_id, e.user_id, e.r, CASE WHEN e.event_id % 3 < 2 THEN c.v ELSE e.r END AS expected FROM e LEFT JOIN c USING (user_id))
{CAS.replace("MAY", MAY_FOLLOW)} {OUTCOMES}
""")
def cas_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the attempts know the stored receipt, the others expect their own."""
    attempts, stored = _receipt_tries(spark, sf_dir)
    allowed = lambda a, b, n: state.receipt_move_allowed(a, b, n % 3 == 0)
    return store.compare_and_set(stored, attempts, "user_id", "v", "expected", "event_id", allowed).select("event_id", "outcome")


def _receipt_tries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    receipts = _provider_receipts(spark, sf_dir)
    stored = receipts.where("user_id % 5 <> 0").groupBy("user_id").agg(F.max_by("r", F.struct("ts", "event_id")).alias("v"))
    known = receipts.join(stored, "user_id", "left").withColumn("expected", F.when(F.col("event_id") % 3 < 2, F.col("v")).otherwise(F.col("r")))
    return known.select("event_id", "user_id", F.col("r").alias("v"), "expected"), stored


@query(f"""
WITH e AS ({RECEIPTS}), c AS (SELECT user_id, arg_max(r, (epoch_us(ts), event_id)) AS v FROM e WHERE user_id % 5 <> 0 GROUP BY user_id),
a AS (SELECT e.event_id, e.user_id, e.r, CASE WHEN e.event_id % 3 < 2 THEN c.v ELSE e.r END AS expected FROM e LEFT JOIN c USING (user_id))
{CAS.replace("MAY", MAY_FOLLOW)}, x AS (SELECT user_id, arg_min(r, event_id) AS r FROM w WHERE event_id = winner GROUP BY user_id)
SELECT c.user_id, coalesce(x.r, c.v).status AS status, coalesce(x.r, c.v).reference AS reference, CASE WHEN x.r IS NULL THEN 1 ELSE 2 END AS version FROM c LEFT JOIN x USING (user_id)
""")
def receipt_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as another session finds them after the attempts."""
    path = scratch_path(spark, "receipts")
    attempts, stored = _receipt_tries(spark, sf_dir)
    held = VersionedStore(spark, path, "user_id", "v")
    held.create(stored)
    allowed = lambda a, b, n: state.receipt_move_allowed(a, b, n % 3 == 0)
    held.compare_and_set(attempts, "expected", "event_id", allowed)
    return VersionedStore(spark.newSession(), path, "user_id", "v").snapshot(2).select("user_id", "v.status", "v.reference", "version")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'retry_failed_batch' WHEN 'P' THEN 'run' ELSE 'none' END AS action FROM orders")
def resume_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'paused' ELSE 'running' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.resume_action(status).alias("action"))


JOINED = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'pending' END AS s, c.k IS NOT NULL AS cached, r.status AS receipt, coalesce(r.n, 0) AS n
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F') c ON c.k = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k, max(CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'unknown' ELSE 'in_flight' END) AS status, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) r ON r.k = o_orderkey
"""


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    cached = lines.where("l_returnflag = 'N' AND l_linestatus = 'F'").select("o_orderkey", F.lit(True).alias("cached")).distinct()
    status = F.expr("CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'unknown' ELSE 'in_flight' END")
    receipts = lines.where("l_linestatus = 'O'").groupBy("o_orderkey").agg(F.max(status).alias("receipt"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'pending' END AS s")
    return rows.join(cached, "o_orderkey", "left").join(receipts, "o_orderkey", "left").withColumn("cached", F.coalesce("cached", F.lit(False))).fillna(0, ["n"])


@query(f"""
SELECT o_orderkey, CASE WHEN s <> 'running' THEN 'none' WHEN cached THEN 'complete_from_cache' WHEN receipt IS NULL THEN 'back_to_pending' WHEN receipt IN ('succeeded', 'failed') THEN 'apply_receipt' ELSE 'query_provider' END AS action FROM ({JOINED})
""")
def recovery_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir).select("o_orderkey", state.recovery_action(F.col("s"), F.col("cached"), F.col("receipt")).alias("action"))


@query(f"SELECT o_orderkey, coalesce(receipt = 'failed' AND n < 2, false) AS eligible FROM ({JOINED})")
def retry_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir).select("o_orderkey", state.retry_eligible(F.col("receipt"), F.col("n")).alias("eligible"))


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS x, list_sort(list(CASE WHEN l_orderkey % 4 = 0 THEN l_partkey + 1 ELSE l_partkey END)) AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey)
SELECT l_orderkey, x <> y AS conflict FROM a
""")
def replay_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completing a batch again: the same ids are a no-op, others a conflict."""
    again = F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return done.groupBy("l_orderkey").agg((F.sort_array(F.collect_list("l_partkey")) != F.sort_array(F.collect_list(again))).alias("conflict"))


@query("SELECT l_orderkey, l_partkey AS batch, 'pending' AS status, CAST(0 AS INTEGER) AS attempts FROM lineitem")
def initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("batch"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


@query("""
SELECT o_orderkey, CASE s WHEN 'completed' THEN n = done WHEN 'failed' THEN failed > 0 WHEN 'pending' THEN done = 0 AND failed = 0 ELSE done < n AND failed = 0 END AS consistent
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END AS s, count(l_partkey) AS n, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS failed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
""".replace("GROUP BY ALL", "GROUP BY o_orderkey, o_orderstatus"))
def checkpoint_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task is completed when all batches are, failed when one is, pending when none began."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(F.expr("l_linestatus = 'O' AND l_returnflag = 'R'")).alias("failed")
    )
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").fillna(0, ["n", "done", "failed"])
    s = F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END")
    ok = (
        F.when(s == "completed", F.col("n") == F.col("done"))
        .when(s == "failed", F.col("failed") > 0)
        .when(s == "pending", (F.col("done") == 0) & (F.col("failed") == 0))
        .otherwise((F.col("done") < F.col("n")) & (F.col("failed") == 0))
    )
    return rows.select("o_orderkey", ok.alias("consistent"))


STAGES = ("preflight", "extracting", "translating", "rendering", "thinking")


@query(f"""
WITH e AS (SELECT event_id, user_id, {list(STAGES)}[event_id % 5 + 1] AS stage, event_type AS message, CASE WHEN event_id % 3 > 0 THEN CAST(floor(value) AS BIGINT) % 12 END AS done, CASE WHEN event_id % 3 > 1 OR event_id % 7 = 0 THEN 6 - CASE WHEN event_id % 11 = 0 THEN 6 ELSE 0 END END AS total, ts FROM events),
v AS (SELECT *, stage <> 'thinking' AND length(message) BETWEEN 1 AND 2000 AND (done IS NULL) = (total IS NULL) AND coalesce(total <> 0 AND done <= total, true) AS valid, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS terminal FROM e)
SELECT event_id, valid, terminal FROM v
""")
def event_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events: known stage, both counts or none, total not 0, done at most
    total; the last of each run is its terminal event."""
    last = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(f"element_at(array({', '.join(repr(s) for s in STAGES)}), CAST(event_id % 5 AS INT) + 1)").alias("stage"),
        F.col("event_type").alias("message"),
        F.expr("CASE WHEN event_id % 3 > 0 THEN CAST(floor(value) AS BIGINT) % 12 END").alias("done"),
        F.expr("CASE WHEN event_id % 3 > 1 OR event_id % 7 = 0 THEN 6 - CASE WHEN event_id % 11 = 0 THEN 6 ELSE 0 END END").alias("total"),
        (F.row_number().over(last) == 1).alias("terminal"),
    )
    return rows.select("event_id", valid_progress(F.col("stage"), F.col("message"), F.col("done"), F.col("total")).alias("valid"), "terminal")


@query("""
SELECT page_id AS project, CASE WHEN n_source > 0 THEN 'source_ready' WHEN packaged AND strong THEN 'packaged_requires_import' WHEN packaged THEN 'uncertain' WHEN n_tl > 0 THEN 'uncertain' WHEN runtime AND launcher THEN 'uncertain' ELSE 'not_renpy' END AS status
FROM (SELECT page_id, n_source, n_tl, runtime, launcher, n_archive + n_compiled > 0 AS packaged, n_compiled > 0 OR (n_archive > 0 AND (launcher OR runtime)) AS strong
  FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END AS n_source, CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS n_archive, CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS n_compiled, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS n_tl, page_id % 2 = 0 AS launcher, page_id % 4 = 0 AS runtime FROM pages))
""")
def compat_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "pages").selectExpr(
        "page_id AS project", "true AS has_game", "false AS incomplete", "CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END AS sources", "CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS archives",
        "CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS compiled", "CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS translations", "page_id % 2 = 0 AS launcher", "page_id % 4 = 0 AS runtime",
    )
    return counts.select("project", status().alias("status"))


CLASSES = "concat(CASE WHEN doc_id % 3 = 0 THEN 'tl/schinese/' ELSE 'scripts/' END, source, CASE doc_id % 5 WHEN 0 THEN '.rpy' WHEN 1 THEN '.RPYM' WHEN 2 THEN '.rpyc' WHEN 3 THEN '.rpa' ELSE '.png' END)"


@query(f"""
SELECT doc_id, CASE WHEN starts_with(path, 'tl/') AND regexp_matches(lower(path), '\\.rpym?c?$') THEN 'translation' WHEN regexp_matches(lower(path), '\\.rpym?$') THEN 'source' WHEN regexp_matches(lower(path), '\\.rpym?c$') THEN 'compiled' WHEN lower(path) LIKE '%.rpa' THEN 'archive' END AS class FROM (SELECT doc_id, {CLASSES} AS path FROM documents)
""")
def compat_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify(F.expr(CLASSES)).alias("class"))


@query(f"""
SELECT source AS project, count(*) FILTER (c = 'source') AS sources, count(*) FILTER (c = 'compiled') AS compiled, count(*) FILTER (c = 'archive') AS archives, count(*) FILTER (c = 'translation') AS translations
FROM (SELECT source, CASE WHEN starts_with(path, 'tl/') AND regexp_matches(lower(path), '\\.rpym?c?$') THEN 'translation' WHEN regexp_matches(lower(path), '\\.rpym?$') THEN 'source' WHEN regexp_matches(lower(path), '\\.rpym?c$') THEN 'compiled' WHEN lower(path) LIKE '%.rpa' THEN 'archive' END AS c FROM (SELECT source, {CLASSES} AS path FROM documents)) GROUP BY source
""")
def compat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), classify(F.expr(CLASSES)).alias("c"))
    count = lambda kind, name: F.count_if(F.col("c") == kind).alias(name)
    return kinds.groupBy("project").agg(count("source", "sources"), count("compiled", "compiled"), count("archive", "archives"), count("translation", "translations"))


STORED = """
SELECT l_orderkey, l_linenumber, CASE l_partkey % 9 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE CASE WHEN l_orderkey % 3 = 0 THEN 'pending' ELSE 'completed' END END AS status,
  CASE WHEN l_orderkey % 3 = 0 AND l_partkey % 9 > 1 THEN 0 ELSE l_suppkey % 3 END AS attempts, CASE WHEN l_partkey % 9 > 2 AND l_orderkey % 3 > 0 THEN 4 - CAST(l_partkey % 50 = 3 AS INTEGER) ELSE CAST(l_partkey % 40 = 1 AS INTEGER) END AS proposals,
  4 AS segments, CASE WHEN l_suppkey % 4 > 0 THEN 'HTTP 400' END AS error FROM lineitem
"""
TASKS = "SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'failed' ELSE 'completed' END AS status FROM orders"


@query(f"""
WITH b AS ({STORED}), w AS (
  SELECT *, CASE WHEN status = 'completed' AND proposals <> segments THEN 'completed_count' WHEN status <> 'completed' AND proposals > 0 THEN 'early_proposals'
    WHEN status = 'running' AND attempts < 1 THEN 'running_without_attempt' WHEN status = 'failed' AND error IS NULL THEN 'failed_without_error' END AS wrong FROM b
), f AS (
  SELECT l_orderkey, arg_min(wrong, lpad(CAST(l_linenumber AS VARCHAR), 5, '0') || wrong) AS batch, bool_or(status <> 'completed') AS o, bool_or(status = 'failed') AS failed,
    bool_or(status = 'running') AS running, bool_or(status <> 'pending' OR attempts <> 0) AS begun FROM w GROUP BY l_orderkey
), t AS ({TASKS})
SELECT o_orderkey, CASE WHEN batch IS NOT NULL THEN batch WHEN status = 'completed' AND coalesce(o, false) THEN 'completed_with_open_batches' WHEN status <> 'completed' AND NOT coalesce(o, false) THEN 'all_batches_completed'
  WHEN status = 'failed' AND NOT coalesce(failed, false) THEN 'failed_without_failed_batch' WHEN status <> 'failed' AND coalesce(failed, false) THEN 'failed_batch'
  WHEN status = 'paused' AND coalesce(running, false) THEN 'paused_with_running_batch' WHEN status = 'pending' AND coalesce(begun, false) THEN 'pending_but_begun' END AS error
FROM t LEFT JOIN f ON l_orderkey = o_orderkey
""")
def checkpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tasks and their batches, held against all rules of a checkpoint."""
    lines = spark.sql(STORED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    tasks = spark.sql(TASKS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    batches = lines.withColumnsRenamed({"l_orderkey": "o_orderkey", "l_linenumber": "batch_index"})
    return state.checkpoint_errors(tasks, batches, "o_orderkey")
