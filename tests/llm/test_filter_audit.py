from __future__ import annotations

import itertools
import random

from oracle import DATA, assert_same
from pyspark.sql import functions as F

from glossaspark.llm.filter_audit import filter_audit, measured, text_filter_audit
from glossaspark.llm.queries import ORACLES, QUERIES

COLUMNS = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows):
    """rows: (part, letters that the document fails, good, toxic)."""
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                fails = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [f, len(alive), len(gone), len(fails) - len(gone), sum(r[1] == f for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {(*k, *v, total[k[0], v[0]]) for k, v in out.items()}


def found(df):
    rows = df.select(*COLUMNS).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice(("x", "y", "")), "".join(f for f in "ABCDE" if rng.random() < rng.choice((0.05, 0.5))), rng.random() < 0.3, rng.random() < 0.1) for _ in range(400)]
    rows += [("all gone", "A", True, True)] * 3 + [("clean", "", False, False)]
    df = spark.createDataFrame(rows, "part string, f string, good boolean, toxic boolean")
    assert found(filter_audit(df, {x: f"contains(f, '{x}')" for x in "ABCDE"})) == brute(rows)


def test_any_number_of_filters_and_unknown_conditions(spark):
    df = spark.createDataFrame([("x", 1, True, False), ("x", None, False, False)], "part string, v int, good boolean, toxic boolean")
    out = filter_audit(df, {"P": "v > 0", "Q": "v > 1"})
    assert {(r["filter_order"], r["step"], r["filter"], r["kept"], r["removed"]) for r in out.collect()} == {("PQ", 1, "P", 1, 1), ("PQ", 2, "Q", 1, 0), ("QP", 1, "Q", 2, 0), ("QP", 2, "P", 1, 1)}


def test_oracle(spark):
    assert_same(QUERIES["op11_filter_interaction_audit"], ORACLES["op11_filter_interaction_audit"], spark, DATA)


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    docs = edge_docs.withColumn("lang", F.when(F.col("doc_id") > 3, F.lit("en"))).withColumn("id", F.lit(0)).withColumn("repeated", F.lit(0))
    rows = measured(docs, labels).collect()
    assert len(rows) == edge_docs.count()
    # 2 twice repeats 1, 5 repeats the empty 4; the row without id repeats nothing
    assert sum(r["repeated"] for r in rows) == 3
    assert sum(r["good"] for r in rows) == 1 and sum(r["toxic"] for r in rows) == 2
    out = text_filter_audit(docs, labels).collect()
    assert len(out) == 2 * 600 and {r["part"] for r in out} == {"", "en"}
    assert all(min(r["kept"], r["removed"], r["redundant"], r["unique_fails"]) >= 0 for r in out)
    assert text_filter_audit(no_docs.withColumn("lang", F.lit("x")), labels).count() == 0
    assert text_filter_audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0
