from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import product

import sentencepiece
from oracle import DATA
from tokenizers import Tokenizer

from glossaspark.llm import token_alignment
from glossaspark.llm.queries import BYTE_LEVEL, PIECES, QUERIES
from glossaspark.llm.token_alignment import align_tokens

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    """All pairs of tokens of a text, offset by offset."""
    a_side, b_side = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    docs = []
    for text in texts:
        whole = " " + (text or "")
        e = a_side.encode(whole, add_special_tokens=False)
        # offsets of the byte-level decoder: bytes of a run of tokens are the bytes of its text
        letters = {v: k for k, v in token_alignment._byte_letters().items()}
        spelled = {c: b for b, c in letters.items()}
        a = [(i, bytes(spelled[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = []
        for i in b_side.encode(text or ""):
            p = b_side.id_to_piece(i)
            b.append((i, bytes.fromhex(p[3:5]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        if not text or any(b"".join(t for _, t in x) != whole.encode() for x in (a, b)):
            docs.append(None)
            continue
        a, b = spans(a), spans(b)
        cuts = sorted({z for *_, z in a} & {z for *_, z in b})
        links = [(x, y) for x, i, j in a for y, k, m in b if i < m and k < j]
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(x) for x, _, z in side if lo < z <= hi) for side in (a, b)))
            lo = hi
        docs.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    counts = Counter(link for d in docs if d for link in d[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [
        zero if d is None else (*d[:3], len(d[3]), sum(counts[x] == best[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(d[4].encode()).hexdigest())
        for d in docs
    ]


def test_equals_brute_force(spark, monkeypatch):
    texts = [
        "Hello world, this is a test of alignment.", "naïve café — 東京タワー 🎉🎉 ok", "x", " ", "  two  spaces\n\nlines\t", "<|endoftext|> and </s> <0x41> are text", "don't can't 12345 3.14159", "",
        None, "▁", "ﬁ ligature   nbsp", "a" * 500, "repeat repeat repeat repeat", "Hello world, this is a test of alignment.", "é combining",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = dict(enumerate(brute(texts)))
    for pairs in (1 << 17, 4, 0):
        monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", pairs)
        out = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in align_tokens(docs, BYTE_LEVEL, PIECES).collect()}
        assert out == wanted


def test_registered_query_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    out = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in QUERIES["op13_cross_tokenizer_alignment"](spark, DATA).collect()}
    assert out == {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs]), strict=True)}


def test_tokens_are_read_in_buckets_without_an_exchange(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tokens = token_alignment.tokenized(docs, BYTE_LEVEL, PIECES)
    plan = token_alignment._aligned(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    spark.sql(f"DROP TABLE {tokens.table_name}")


def test_words_are_encoded_once(spark, monkeypatch):
    """However often they stand in the corpus; a text that a word fails adds to no count."""
    words = ["tion", "Hello,", "don't", "x\n\ny", "東京タワー", "a▁b", "12", "e\u0301", "\u00a0z", "q\x1cr", "  two", "end\t"]
    rng = random.Random(13)
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(120)] + ["a▁b tion tion", " tion", "tion  tion", "tion "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, real = [], token_alignment.tokenized
    monkeypatch.setattr(token_alignment, "tokenized", lambda d, *a, **k: seen.append(d) or real(d, *a, **k))
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 500)
    counts = []
    monkeypatch.setattr(token_alignment, "drop_scratch", lambda *x: counts.extend(d.count() for d in seen if not counts))
    out = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in align_tokens(docs, BYTE_LEVEL, PIECES).collect()}
    assert out == dict(enumerate(brute(texts)))
    assert counts == [len({w for t in texts for w in token_alignment.CUT.split(t)})]


def test_texts_that_cannot_be_cut_are_one_word(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "cuts_at_spaces", lambda *_: False)
    assert token_alignment._splitter(BYTE_LEVEL, PIECES)("a b") == ["a b"]
    monkeypatch.undo()
    assert token_alignment._splitter(BYTE_LEVEL, PIECES)("a b  c\nd e") == ["a", "b  c\nd", "e"]


def test_edge_rows(spark, edge_docs, no_docs):
    rows = align_tokens(edge_docs, BYTE_LEVEL, PIECES).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_a"] == by[5]["n_a"] == 0 and by[4]["groups_sha256"] == ""
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and by[1]["groups_sha256"] == by[2]["groups_sha256"] == by[None]["groups_sha256"]
    assert by[7]["n_links"] >= by[7]["n_a"] > 60_000
    assert align_tokens(no_docs, BYTE_LEVEL, PIECES).count() == 0


def test_words_and_facts_are_shuffled_compactly(spark):
    """A word goes to its part once a block, and the facts of a part's words come back to a block compressed."""
    words = ["".join(x) for x in product(["th", "on", "er", "in", "ed", "re", "ti", "an", "es", "ou", "ha", "ble"], repeat=4)]
    rng = random.Random(17)
    texts = [" ".join(x[i : i + 500]) for x in (rng.sample(words, len(words)) for _ in range(4)) for i in range(0, len(words), 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(4)
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def written() -> dict:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = written()
    # joins as over tables too large to be broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert align_tokens(docs, BYTE_LEVEL, PIECES).where("n_links > 0").count() == len(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(n for k, n in written().items() if k not in before)
    assert 0 < moved < 5 * sum(map(len, texts))
