from __future__ import annotations

import random

from glossaspark.llm.substring_dedup import FingerprintIndex, remove_repeats


def brute(texts, window=13):
    first, words = {}, {k: (t or "").encode().split() for k, t in texts.items()}
    for key in sorted(words):
        w = words[key]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), key)
    out = {}
    for key, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < key for j in range(i, i + window)}
        out[key] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words, passages = [f"v{i}" for i in range(60)], []
    out = {}
    for i in range(n):
        parts = [rng.choices(words, k=rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            if passages and rng.random() < 0.7:
                p = rng.choice(passages)
                at = rng.randrange(len(p))
                parts.append(p[at : at + rng.choice((5, 12, 13, 14, 40))])
            else:
                passages.append(rng.choices(words, k=rng.choice((12, 13, 20, 50))))
                parts.append(passages[-1])
            parts.append(rng.choices(words, k=rng.randrange(0, 9)))
        out[i] = " ".join(x for p in parts for x in p)
    out[n] = " ".join(["same"] * 40)
    out[n + 1] = " ".join(["same"] * 20)
    return out


def found(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}


def test_equal_to_brute_force(spark):
    for seed, batches, many in ((1, 4, 10_000), (2, 1, 2), (3, 7, 5)):
        texts = corpus(seed)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        assert found(remove_repeats(docs, batches=batches, many=many)) == brute(texts)


def test_other_window(spark):
    texts = corpus(9)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(remove_repeats(docs, window=8, gram=3)) == brute(texts, 8)


def test_runs_are_compacted(spark):
    index = FingerprintIndex(spark, fanout=2)
    docs = spark.createDataFrame(list(corpus(4).items()), "doc_id long, text string")
    for low in (0, 40, 80):
        shared = index.add(docs.where(f"doc_id >= {low} AND doc_id < {low + 40}"))
        so_far = index.fingerprints(docs.where(f"doc_id < {low + 40}")).groupBy("h").count().where("count > 1")
        batch = index.fingerprints(docs.where(f"doc_id >= {low} AND doc_id < {low + 40}")).select("h").distinct()
        assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, so_far.join(batch, "h").collect()))
    assert len(index.runs) == 1
    run = spark.table(index.runs[0][0])
    assert run.select("h").distinct().count() == run.count() and run.agg({"hi": "max"}).first()[0] > 80
    index.drop()
    assert not index.runs


def test_edge_rows(edge_docs, no_docs):
    rows = remove_repeats(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == 120 and by[3]["n_removed"] == 120
    assert by[3]["kept_text"] == "tail" and by[10]["kept_text"] == "end"
    assert by[4]["n_words"] == by[5]["n_words"] == 0 and by[4]["kept_text"] == ""
    assert by[None]["n_removed"] == 0 and by[None]["n_words"] == 120
    assert remove_repeats(no_docs).count() == 0
