from __future__ import annotations

import random

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from glossaspark.llm import near_dedup
from glossaspark.llm.common import materialize, salted_join
from glossaspark.llm.components import connected_components
from glossaspark.llm.near_dedup import distinct_documents, near_duplicates


def sets(texts, size):
    out = {}
    for key, text in texts.items():
        w = (text or "").encode().lower().split()
        out[key] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(texts, size, percent=80):
    s, parent = sets(texts, size), {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(s[k]), root(k), root(k) == k) for k in keys}


def corpus(seed, n):
    """Chains of copies: each copy changes a few words of an earlier document."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    out = {}
    for i in range(n):
        if i > 5 and rng.random() < 0.7:
            w = out[rng.randrange(max(0, i - 30), i)].split()
            for _ in range(rng.choice((0, 1, 2, 3, 5))):
                w[rng.randrange(len(w))] = rng.choice(words)
            out[i] = " ".join(w)
        else:
            out[i] = " ".join(rng.choices(words, k=rng.choice((3, 40, 90, 150))))
    return out


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("block", [256, 8])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = corpus(block, 260)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(near_duplicates(docs, shingle=4)) == brute(texts, 4)


def test_no_rounds_still_complete(spark):
    """Links that the stars miss come from the comparison of blocks."""
    texts = corpus(5, 160)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(near_duplicates(docs, shingle=4, rounds=0)) == brute(texts, 4)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0 and all(by[i]["kept"] for i in (4, 5, 6))
    assert by[9]["n_shingles"] == 1
    assert by[10]["component_id"] == 7
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_duplicates(no_docs).count() == 0


def test_rows_of_one_id_are_in_one_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (2, b), (4, c), (5, c), (5, None), (6, ""), (7, b + " x"), (7, c + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert out == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False), (6, 6, True), (7, 1, False)}


def test_registered_query_equals_brute_force(spark):
    """All documents of the driver's table, every pair compared."""
    from glossaspark.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert found(QUERIES["op5_minhash_near_dedup"](spark, DATA)) == brute(texts, 4)


def test_one_document_of_each_group_stays(edge_docs):
    kept = distinct_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9, 11, 12]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "u long, v long")
    out = {r["node"]: r["component"] for r in connected_components(df).distinct().collect()}
    assert out == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(df.where(F.lit(False))).count() == 0


def test_a_hot_key_is_dealt_over_several_tasks(spark):
    many = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).cast("long").alias("k"))
    one = materialize(many.where("k < 400").groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n")), "one")
    out = salted_join(many, one, "k", "id")
    assert out.columns == ["k", "id", "top"]
    plain = many.join(one.drop("n"), "k")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    assert "salts" in out._jdf.queryExecution().toString()
    none = materialize(one.where("false"), "one")
    assert salted_join(many, none, "k", "id").count() == 0
