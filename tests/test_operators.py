from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glossaspark.domains import TASK_MOVES
from glossaspark.functions import identity, paths, text
from glossaspark.operators import quality, sequences, state, store, tasks
from glossaspark.operators.versioned import VersionedStore
from glossaspark.plans import localize
from glossaspark.queries.processes import echo
from glossaspark.sources import templates
from glossaspark.streaming import sink, state_machine


def brute_tokens(s):
    out, i = [], 0
    while i < len(s):
        for kind, pattern in (("escape", r"\\.|\[\[|\{\{"), ("interpolation", r"\[[^\]]*\]"), ("text_tag", r"\{[^}]*\}")):
            m = re.compile(pattern, re.S).match(s, i)
            if m:
                out.append((len(out), kind, m[0], i, m.end()))
                i = m.end()
                break
        else:
            i += 1
    return out


def test_tokens_on_random_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab[]{}\\ \n𝄞é", k=rng.randrange(14))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = text.tokens(F.col("t"))
    for r in df.select("i", "t", c.alias("x"), text.spans_fit(F.col("t"), c).alias("ok")).collect():
        assert [tuple(x) for x in r["x"]] == brute_tokens(r["t"]) and r["ok"]


def test_lines_as_in_python(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab\n\r\x0b\x0c\x1c\x1d\x85\u2028\u2029", k=rng.randrange(9))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.lines(F.col("t")).alias("x")).collect():
        assert r["x"] == r["t"].splitlines()


def test_canonical_json_as_in_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices('a"\\/\x00\x0b\x1f\n\té\u2028𝄞u01F', k=rng.randrange(12))) for _ in range(400)] + ["\\u001F", "\\\\u001F\x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", identity.canonical_json(F.struct(F.col("t").alias("a"), F.lit(None).cast("string").alias("b"))).alias("x")).collect():
        assert r["x"] == json.dumps({"a": r["t"], "b": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_escapes_are_looked_for_before_they_are_replaced(spark):
    """The nine patterns run on texts with a control character only."""
    df = spark.range(1).select(identity.canonical_json(F.struct(F.col("id").cast("string").alias("a"))).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.match(r"Project \[CASE WHEN Contains\(", plan) and plan.count("regexp_replace") == len(identity.UPPER_ESCAPES)


def test_digests_are_shuffled_as_bytes(spark):
    """Half the length for hex digits; the bytes tell all texts apart and give them back."""
    sha = "0f" * 32
    texts = [sha, sha.upper(), "0", "0f", "\x0f", "", None, "\u0001\u000f", "g" * 64, sha + "\n", "caf\u00e9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", identity.packed(F.col("t")).alias("b")).withColumn("back", identity.unpacked(F.col("b"))).collect()
    assert [r["back"] for r in rows] == texts and len({r["b"] for r in rows}) == len(texts) and len(rows[0]["b"]) == 33
    segments = spark.createDataFrame([(1, "b", "s", "renpy", 1, sha, "fr"), (1, "b", "t", "renpy", 1, "0", "fr")], "task_id int, batch_id string, segment_id string, engine string, source_schema_version int, source_sha256 string, target_language string")
    segments = segments.withColumn("protected_tokens", F.array().cast("array<struct<index:int,kind:string,value:string>>"))
    given = segments.withColumn("source_sha256", F.when(F.col("segment_id") == "s", F.col("source_sha256"))).drop("engine").withColumn("schema_version", F.lit(1)).withColumn("target_text", F.lit("x"))
    plan = tasks.validated(segments.drop("engine").withColumn("schema_version", F.lit(1)).withColumn("target_text", F.lit("x")), segments)
    assert {(r["segment_id"], r["source_sha256"], r["error_code"]) for r in plan.collect()} == {("s", sha, None), ("t", "0", None)}
    assert {(r["segment_id"], r["source_sha256"], r["error_code"]) for r in tasks.validated(given, segments).collect()} == {("s", sha, None), ("t", None, "source_sha256")}
    assert {f.dataType.simpleString() for f in plan.schema.fields if f.name == "source_sha256"} == {"string"}


def test_only_open_pairs_of_texts_reach_python(spark):
    """Texts that normalisation can't change are compared in the JVM."""
    import unicodedata

    from glossaspark.functions.unicode import STABLE

    nfc = lambda t: unicodedata.normalize("NFC", t)
    ends = [[int(x, 16) for x in re.findall(r"x\{([0-9a-f]+)\}", part)] for part in re.findall(r"[^-]+-[^}]+\}", STABLE)]
    for c in (chr(i) for low, high in ends for i in range(low, high + 1)):
        assert nfc(c) == c and all(nfc(x + c) == nfc(x) + c for x in ("a", "e\u0301", "\u1100", "\uac00", "\u0bc6"))
    texts = ["caf\u00e9", "cafe\u0301", "cafe", "\u201cu\u201d", "\u212b", "\u00c5", "A\u030a", "", None, "\uac01", "\u1100\u1161\u11a8", "\u65e5", "\U0001d15e", "\n"]
    found = quality.assessed(spark.createDataFrame([(a, b) for a in texts for b in texts], "source_text string, target_text string"))
    for r in found.collect():
        a, b = r["source_text"], r["target_text"]
        assert (r["outcome"] == "low_confidence") == (a is not None and b is not None and nfc(a) == nfc(b)), (a, b)
    calls = re.findall(r"nfc\(.{12}", found._jdf.queryExecution().optimizedPlan().toString())
    assert calls and all(c.startswith(("nfc(CASE WHEN", "nfc(_", "nfc(if")) for c in calls), calls


def test_indent_and_strings(spark):
    df = spark.createDataFrame([(" \tx", 4), ("\t\tx", 8), ("   \t x", 5), ("x", 0), ("", 0)], "t string, n int")
    assert df.where(text.indent(F.col("t")) != F.col("n")).count() == 0
    df = spark.createDataFrame([("ok", True), (" x", False), ("x\u3000", False), ("", False), (None, False), ("a\tb", False), ("x" * 11, False)], "t string, ok boolean")
    assert df.where(text.checked_string(F.col("t"), 10) != F.col("ok")).count() == 0


@pytest.mark.parametrize(
    ("path", "suffix", "output"),
    [("a/b.RPY", ".rpy", True), (".rpy", "", True), ("a.b/c", "", True), ("x/con.rpy", ".rpy", False), ("Game/a.rpy", ".rpy", False), ("a./b.rpy", ".rpy", False), ("a/b ", "", False)],
)
def test_paths(spark, path, suffix, output):
    c = F.lit(path)
    row = spark.range(1).select(paths.suffix(c).alias("s"), paths.safe_output(c).alias("o")).first()
    assert (row["s"], row["o"]) == (suffix, output)


def test_ordinals_have_no_gaps(spark):
    rows = [(random.Random(i).randrange(500),) for i in range(997)]
    df = spark.createDataFrame(rows, "k int").repartition(7)
    out = sequences.with_ordinal(df, "k").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in out] == list(range(997)) and [r["k"] for r in out] == sorted(r[0] for r in rows)
    assert sequences.with_ordinal(df.where("false"), "k").count() == 0


def test_tree_digest_of_one_leaf_and_more(spark):
    df = spark.createDataFrame([("t", i, f"s{i}") for i in range(10)], "t string, n int, s string")
    tree = lambda leaf: identity.tree_digest(df, ["t"], "n", "s", "task", "id", leaf).first()["id"]
    assert tree(4) != tree(5) and tree(4) == tree(4)


def test_replay_in_parts_equals_whole(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.choice(sorted(TASK_MOVES))) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, n int, s string")
    whole = sorted(map(tuple, state.replayed(df, "k", ["n"], "s", "pending", TASK_MOVES).collect()))
    assert whole == sorted(map(tuple, state.replayed(df, "k", ["n"], "s", "pending", TASK_MOVES, salt_rows=7).collect()))
    now = {}
    for k, _, s in rows:
        before = now.setdefault(k, ["pending", 0, 0])
        ok = s in TASK_MOVES[before[0]]
        now[k] = [s if ok else before[0], before[1] + ok, before[2] + (not ok)]
    assert whole == sorted((k, *v) for k, v in now.items())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    assert [tuple(r) for r in store.upserted(old, new, "k", "v").collect()] == [(3, "c")]
    with pytest.raises(Exception, match="another payload"):
        store.upserted(old, new.withColumn("v", F.lit("x")), "k", "v").collect()


def test_stream_replays_once(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, wanted string"
    first = [(1, 1, "running"), (1, 2, "completed"), (2, 3, "completed"), (1, 4, "running")]
    second = [(2, 5, "running"), (1, 2, "running")]  # the second is a replay

    def put(rows, name):
        df = spark.createDataFrame([(u, e, w) for u, e, w in rows], "user_id long, event_id long, wanted string")
        df.select("user_id", "event_id", F.timestamp_seconds("event_id").alias("ts"), "wanted").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream = state_machine.replay(events).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        stream.awaitTermination()
        return sorted((r["key"], r["event_id"], r["after"], r["applied"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(first, "a")
    assert run() == [(1, 1, "running", True), (1, 2, "completed", True), (1, 4, "completed", False), (2, 3, "pending", False)]
    put(second, "b")
    assert run()[-1] == (2, 5, "running", True) and len(run()) == 5
    put([(1, 3, "paused"), (1, 6, "running")], "c")  # the first comes after the fourth
    assert (1, 3, "completed", False) in run() and len(run()) == 7
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).where("late").collect()] == [3]


def test_sink_adds_nothing_twice(spark, tmp_path):
    write = sink.append_once(str(tmp_path / "t"), "k", "v")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    write(batch((1, "a"), (1, "a"), (2, "b")), 0)
    write(batch((2, "b"), (3, "c")), 1)
    write(batch((2, "b"), (3, "c")), 1)
    held = VersionedStore(spark, str(tmp_path / "t"), "k", "v")
    stored = lambda: sorted((r["k"], r["v"]) for r in held.snapshot().collect())
    assert stored() == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(Exception, match="another payload"):
        write(batch((1, "x"), (4, "d")), 2)
    with pytest.raises(Exception, match="another payload"):
        write(batch((5, "x"), (5, "y")), 2)
    assert stored() == [(1, "a"), (2, "b"), (3, "c")]


def test_sink_reads_as_many_files_after_many_batches(spark, tmp_path):
    write = sink.append_once(str(tmp_path / "t"), "k", "v", buckets=1)
    held = VersionedStore(spark, str(tmp_path / "t"), "k", "v", 1)
    runs = []
    for n in range(12):
        write(spark.createDataFrame([(n, "a"), (100 + n, "b")], "k int, v string"), n)
        runs.append(len(held._manifest()["folders"]["0"]))
    assert max(runs) < 8 and runs[-1] < 8 and held.snapshot().count() == 24
    held.vacuum()
    assert held.snapshot().count() == 24


SCRIPT = 'define aoi = Character("Aoi")\nlabel start:\n    aoi "Hi [name]!"\n    "Wind."\n    menu:\n        "Go":\n            "On."\n'
TEMPLATE = """# game/script.rpy:3
translate french s1:

    # aoi "Hi [name]!"
    aoi ""

# game/script.rpy:4
translate french s2:

    # "Wind."
    ""

# game/script.rpy:7
translate french s3:

    # "On."
    ""

translate french strings:

    # game/script.rpy:6
    old "Go"
    new ""
"""


def test_localization_from_scripts_to_files(spark, tmp_path):
    (tmp_path / "game").mkdir()
    (tmp_path / "game/script.rpy").write_text(SCRIPT)
    segments = localize.extracted(spark, str(tmp_path)).cache()
    files = spark.createDataFrame([("script.rpy", TEMPLATE.encode())], "path string, content binary")
    entries, _ = templates.read_entries(files, "french")
    found = localize.mapped(segments, entries)
    assert localize.crosschecked(segments, entries, found).first()["matches"]
    requests = localize.task(segments, "en", "french", batch_size=3).cache()
    assert requests.select("batch_id").distinct().count() == 2 and requests.select("task_id").distinct().count() == 1

    def service(payload):
        batch = json.loads(payload)
        items = [{"segment_id": s["segment_id"], "target_text": s["source_text"].replace("Hi", "Salut").replace("Go", "Va")} for s in batch["segments"]]
        return 200, json.dumps({"choices": [{"message": {"content": json.dumps({"translations": items})}}]})

    receipts, proposals = localize.replies(requests, service)
    assert {r["status"] for r in receipts.collect()} == {"succeeded"}
    checked = localize.checked(requests, proposals)
    assert {(r["target_text"], r["error_code"], r["outcome"]) for r in checked.collect()} == {
        ("Salut [name]!", None, "clear"), ("Wind.", None, "low_confidence"), ("Va", None, "clear"), ("On.", None, "low_confidence"),
    }
    out = localize.rendered(found, checked, "french").first()
    assert out["relative_path"] == "game/tl/french/script.rpy"
    assert out["content"].endswith('translate french strings:\n\n    # game/script.rpy:6\n    old "Go"\n    new "Va"\n\n')
    assert '    # aoi "Hi [name]!"\n    aoi "Salut [name]!"\n\n' in out["content"]
    other = localize.task(segments, "en", "german", batch_size=3).first()["task_id"]
    assert other != requests.first()["task_id"]
    assert echo(json.dumps({"number": 5, "segments": []}))[0] == 400


def test_a_claimed_batch_is_not_sent_again(spark, tmp_path):
    from glossaspark.plans import sending

    batches = spark.createDataFrame([("a", "{}", ["s"]), ("b", "{}", ["s"])], "batch_id string, payload string, segment_ids array<string>")
    good = '{"id": "r", "choices": [{"message": {"content": "{\\"translations\\": [{\\"segment_id\\": \\"s\\", \\"target_text\\": \\"t\\"}]}"}}]}'
    status = lambda store: {r["batch_id"]: r["status"] for r in sending.receipts(spark, store).collect()}

    def broken(payload):
        raise OSError("the run ends here")

    store = str(tmp_path / "store")
    with pytest.raises(Exception, match="ends here"):
        sending.send(batches, store, broken, "one")
    assert status(store) == {"a": "unknown", "b": "unknown"}
    sending.send(batches, store, lambda p: (200, good), "two", retry=True)
    assert status(store) == {"a": "unknown", "b": "unknown"}
    sending.recover(batches, store, lambda p: (400, ""), "three")
    assert status(store) == {"a": "failed", "b": "failed"}
    sending.send(batches, store, lambda p: (200, good), "four")
    assert status(store) == {"a": "failed", "b": "failed"}
    sending.send(batches, store, lambda p: (200, good), "five", retry=True)
    assert status(store) == {"a": "succeeded", "b": "succeeded"}


def test_the_loop_sends_each_claim_once(spark, tmp_path):
    """A refused batch is sent twice, an unknown one is asked for, one that is never settled stops the loop."""
    import os
    import uuid

    from glossaspark.plans import sending

    good = '{"id": "r", "choices": [{"message": {"content": "{\\"translations\\": [{\\"segment_id\\": \\"s\\", \\"target_text\\": \\"t\\"}]}"}}]}'
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def backend(payload):
        open(f"{calls}/{payload}-{uuid.uuid4().hex}", "x").close()
        return {"ok": (200, good), "no": (400, ""), "lost": (504, "")}[payload]

    batches = spark.createDataFrame([(x, x, ["s"]) for x in ("ok", "no", "lost")], "batch_id string, payload string, segment_ids array<string>")
    told = lambda df: {r["batch_id"]: (r["status"], r["attempts"]) for r in df.collect()}
    out = sending.drive(batches, str(tmp_path / "a"), backend, lambda p: (200, good), "a", most_attempts=3)
    assert told(out) == {"ok": ("succeeded", 1), "no": ("failed", 3), "lost": ("succeeded", 1)}
    assert sorted(n.split("-")[0] for n in os.listdir(calls)) == ["lost", "no", "no", "no", "ok"]
    again = sending.drive(batches, str(tmp_path / "a"), backend, lambda p: (200, good), "b", most_attempts=3)
    assert told(again) == told(out) and len(os.listdir(calls)) == 5
    with pytest.raises(RuntimeError, match="still open"):
        sending.drive(batches.where("batch_id = 'lost'"), str(tmp_path / "b"), backend, lambda p: (504, ""), "c", most_attempts=1)
    assert told(sending.attempts(spark, str(tmp_path / "b"))) == {"lost": ("unknown", 1)}
    with pytest.raises(ValueError, match="1 to 5"):
        sending.drive(batches, str(tmp_path / "c"), backend, backend, "d", most_attempts=6)


def test_ranges_of_a_hot_group(spark):
    """One group with most rows, null groups and values, equal times, on ranges of any cut."""
    rng = random.Random(6)
    rows = [(rng.choice((1, 1, 1, 2, None)), i // 2, i, rng.choice(("a", "b", None))) for i in range(600)]
    rows += [(7, 0, 1000, "a")]
    df = spark.createDataFrame(rows, "g int, t int, i int, v string").repartition(5)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    changes = {r[2] for g in groups.values() for p, r in zip([None, *g], g, strict=False) if p is None or p[3] != r[3]}
    found = sequences.change_points(df, "g", ["t", "i"], "v")
    assert found.columns == df.columns and {r["i"] for r in found.collect()} == changes
    seen, wanted = {}, {}
    for r in sorted(rows, key=lambda r: r[2]):
        seen[r[0]] = r[3] if r[3] is not None else seen.get(r[0])
        wanted[r[2]] = seen[r[0]]
    assert {r["i"]: r["x"] for r in sequences.carried(df, "g", "i", F.col("v"), "x").collect()} == wanted


def test_containment_equals_all_pairs(spark):
    from glossaspark.operators import matching

    rng = random.Random(9)
    name = lambda: "/".join(rng.choice(["", "a", "b"]) for _ in range(rng.randrange(1, 6)))
    names, roots = {name() for _ in range(150)}, {name() for _ in range(60)}
    df = lambda xs, c: spark.createDataFrame([(1, x) for x in xs] + [(2, "z")], f"h int, {c} string")
    found = matching.contained(df(names, "p"), df(roots, "r"), "h", "p", "r").collect()
    below = lambda a, b: a == b or b.startswith(a + "/") or a.startswith(b + "/")
    assert sorted((r["h"], r["p"], r["r"]) for r in found) == sorted([(1, p, r) for p in names for r in roots if below(p, r)] + [(2, "z", "z")])


def test_repeated_fragments_and_other_columns_are_refused(spark):
    from glossaspark.operators import render, store

    rows = [("a.rpy", "s1", False, "x", 0, "t1"), ("a.rpy", "s2", False, "y", 1, "t1")]
    df = spark.createDataFrame(rows, "template_file string, segment_id string, requires_strings_header boolean, content string, ordinal int, translation_identifier string")
    with pytest.raises(Exception, match="translation id t1"):
        render.files(render.refused_if_repeated(df), "french").collect()
    assert render.files(render.refused_if_repeated(df.where("ordinal = 0")), "french").count() == 1
    assert store.check_columns(df, df.columns) is df
    with pytest.raises(ValueError, match="expected"):
        store.check_columns(df, ["segment_id", "template_file"])


def test_rules_of_a_checkpoint(spark):
    """Each rule broken alone, in the order in which they are told."""
    good = {"status": "completed", "attempts": 1, "proposals": 2, "segments": 2, "error": None}
    cases = [
        ("completed", [good], None),
        ("completed", [], None),
        ("running", [], "all_batches_completed"),
        ("completed", [good | {"proposals": 1}], "completed_count"),
        ("running", [good | {"status": "pending"}], "early_proposals"),
        ("running", [good | {"status": "running", "proposals": 0, "attempts": 0}], "running_without_attempt"),
        ("failed", [good | {"status": "failed", "proposals": 0, "error": ""}], "failed_without_error"),
        ("failed", [good, good | {"status": "failed", "proposals": 0, "error": "e"}], None),
        ("failed", [good, good | {"status": "pending", "proposals": 0}], "failed_without_failed_batch"),
        ("completed", [good | {"status": "pending", "proposals": 0}], "completed_with_open_batches"),
        ("running", [good | {"status": "failed", "proposals": 0, "error": "e"}], "failed_batch"),
        ("paused", [good | {"status": "running", "proposals": 0}], "paused_with_running_batch"),
        ("paused", [good | {"status": "pending", "proposals": 0}], None),
        ("pending", [good | {"status": "pending", "proposals": 0, "attempts": 1}], "pending_but_begun"),
        ("pending", [good | {"status": "pending", "proposals": 0, "attempts": 0}], None),
        ("failed", [good | {"proposals": 3}, good | {"status": "pending"}], "completed_count"),
    ]
    tasks = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(cases)], "k int, status string")
    rows = [(i, n, b["status"], b["attempts"], b["proposals"], b["segments"], b["error"]) for i, (_, batches, _) in enumerate(cases) for n, b in enumerate(batches)]
    batches = spark.createDataFrame(rows, "k int, batch_index int, status string, attempts int, proposals int, segments int, error string")
    assert {r["k"]: r["error"] for r in state.checkpoint_errors(tasks, batches, "k").collect()} == {i: c[2] for i, c in enumerate(cases)}
