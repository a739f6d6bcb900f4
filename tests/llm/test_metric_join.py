from __future__ import annotations

import random

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F
from test_near_dedup import brute, corpus, found

from glossaspark.llm import metric_join
from glossaspark.llm.metric_join import Anchors, jaccard_join


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_similar_sets_share_an_anchor(percent):
    """Pairs just above the limit, of all sizes, among them sets with empty blocks."""
    rng, anchors = np.random.default_rng(percent), Anchors(percent)
    for n in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(20):
            least = -(-percent * n // 100)
            both = int(rng.integers(least, n + 1))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            extra = int(rng.integers(0, 100 * both // percent - n + 1))
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : n + extra]])
            assert 100 * both >= percent * (n + extra)
            assert np.array_equal(np.sort(a), np.sort(b)) or len(np.intersect1d(anchors(a), anchors(b)))


@pytest.mark.parametrize(("members", "rounds", "percent"), [(1024, 3, 90), (12, 3, 90), (6, 0, 90), (12, 4, 70)])
def test_components_equal_brute_force(spark, monkeypatch, members, rounds, percent):
    """Regions of all sizes: compared at once, divided by pivots, or block by block."""
    monkeypatch.setattr(metric_join, "MEMBERS", members)
    texts = corpus(members + percent, 260)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(jaccard_join(docs, percent=percent, rounds=rounds, pivots=3)) == brute(texts, 3, percent)


def test_group_of_near_copies(spark, monkeypatch):
    """Copies of one text whose distances lie around the limit."""
    monkeypatch.setattr(metric_join, "MEMBERS", 16)
    rng = random.Random(4)
    base, texts = [f"v{i}" for i in range(150)], {}
    for i in range(200):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = found(jaccard_join(docs))
    assert out == brute(texts, 3, 90)
    assert 5 < len({v[1] for v in out.values()}) < 200


@pytest.mark.parametrize("frequent", [0, 400])
def test_anchors_are_shuffled_once(spark, frequent):
    """However large the list of shared anchors is; those of frequent ones apart."""
    rng = random.Random(frequent)
    held = {i: sorted(rng.sample(range(3000), 8)) + [9999] * (i < frequent) for i in range(500)}
    nodes = metric_join.materialize(spark.createDataFrame(list(held.items()), "doc_id long, anchors array<long>"), "nodes")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stars = metric_join._stars(nodes)
        plan = stars._jdf.queryExecution().executedPlan().toString()
        out = {tuple(r) for r in stars.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    members = {}
    for doc, anchors in held.items():
        for anchor in anchors:
            members.setdefault(anchor, []).append(doc)
    assert out == {(m[0], doc) for m in members.values() for doc in m[1:]}
    if not frequent:
        assert plan.count("Exchange hashpartitioning(anchor") == 1


def test_sets_are_not_shuffled_again(spark):
    rows = spark.createDataFrame([(i, [i, i + 1], 2) for i in range(50)], "doc_id long, shingles array<long>, width int")
    sets = metric_join._by_document(rows)
    stars = metric_join.materialize(rows.select("doc_id", F.lit(1).alias("pivot")), "stars")
    joined = stars.hint("merge").join(sets, "doc_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50 and plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    spark.sql(f"DROP TABLE {sets.table_name}")
    metric_join.drop_scratch(sets, stars)


def test_registered_query_equals_brute_force(spark):
    from glossaspark.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert found(QUERIES["op12_ngram_jaccard_join"](spark, DATA)) == brute(texts, 3, 90)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = jaccard_join(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0 and all(by[i]["kept"] for i in (4, 5, 6))
    assert by[9]["n_shingles"] == 1 and by[9]["component_id"] == 9
    assert by[10]["component_id"] == 7
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert jaccard_join(no_docs).count() == 0
    with pytest.raises(ValueError, match="percent"):
        jaccard_join(edge_docs, percent=100)


def test_rows_of_one_id_are_in_one_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (2, b), (4, c), (5, c), (5, None), (6, ""), (7, b + " x"), (7, c + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["component_id"]) for r in jaccard_join(docs).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 1)}
