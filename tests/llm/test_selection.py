"""Mixing, packing, search, surrogates, quotations and the pipeline."""

from __future__ import annotations

import random
import time
import re
from itertools import combinations

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from glossaspark.llm.packing import optimal_widths, packed_batches
from glossaspark.llm.quotations import as_mails, conversations, link_quotations, parse_message, reply_order
from glossaspark.llm.source_mix import fit_lengths, mix_sources, mixed_documents, source_targets, targets_of
from glossaspark.llm.surrogates import Surrogates, entities, replaced, retried, with_surrogates
from glossaspark.llm.topk_search import quantised, top_k_inner_products

KEY = b"test key"


def test_targets_fill_and_stop():
    sizes = {"b": 10, "a": 1000, None: 500, "c": 1}
    t = source_targets(sizes)
    total = sum(sizes.values())
    assert t["b"] == 30 and t["c"] == 3
    assert sum(t.values()) == pytest.approx(total)
    assert t[None] / t["a"] == pytest.approx(1.0)  # a weighs 1, b 2, c 3, then null 1
    assert source_targets({"x": 0, "y": 0}) == {"x": 0.0, "y": 0.0}
    assert source_targets({}) == {}


def test_targets_in_spark_are_those_of_the_rule(spark):
    rng = random.Random(6)
    for case in range(6):
        names = [None, *(f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))), "", "é", "\U0001f600", "\uffff"]
        sizes = {n: 0 if case == 0 else int(10 ** (rng.random() * rng.choice((1, 3, 9)))) for n in dict.fromkeys(names)}
        rows = spark.createDataFrame([("" if n is None else "=" + n, "1" if n is None else "0=" + n, v) for n, v in sizes.items()], "key string, order string, words long")
        found = {r["key"]: (r["source_size"], r["target"]) for r in targets_of(rows, (1, 2, 3), 3).collect()}
        assert found == {("" if n is None else "=" + n): (sizes[n], t) for n, t in source_targets(sizes).items()}
    assert targets_of(spark.createDataFrame([], "key string, order string, words long")).count() == 0


def test_fit_reaches_the_best_sum():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 10))
        take = fit_lengths(lengths, counts, budget)
        assert ((0 <= take) & (take <= counts)).all()
        got = int((take * lengths).sum())
        assert got <= budget
        # the proportional part is fixed first; what is left is filled exactly if it can be
        fixed = counts * budget // int((lengths * counts).sum())
        rest = [int(x) for x, c in zip(lengths, counts - np.minimum(fixed, counts)) for _ in range(c)]
        reach = {0}
        for x in rest:
            reach |= {r + x for r in reach}
        left = budget - int((np.minimum(fixed, counts) * lengths).sum())
        assert budget >= int((lengths * counts).sum()) or got == budget - left + max(r for r in reach if r <= left)


def test_mix_invariants(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["times"] * r["size"]
        s = by.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    for size, taken, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= max(0.05 * target, 200)
    taken = mixed_documents(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r["times"] for r in rows if r["size"] or r["times"])


def test_mix_meets_its_targets(spark):
    """With some fifty documents a source, sums within a word of the target exist."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet".replace("sf0.001", "sf0.01"))
    taken = mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert not [r for r in taken.collect() if abs(r["taken"] - r["target"]) > 1]


def test_mix_edge_rows(edge_docs, no_docs):
    rows = mix_sources(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mix_sources(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
    assert mixed_documents(edge_docs).columns == edge_docs.columns


def test_widths_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)

        def waste(widths):
            return sum(c * (min(w for w in widths if w >= n) - n) for n, c in zip(lengths, counts))

        best = min(waste((*w, lengths[-1])) for r in range(k) for w in combinations(lengths[:-1], r))
        found = optimal_widths(lengths, counts, k)
        assert len(found) <= k and waste(found) == best


def test_packing_holds_all_tokens(spark, edge_docs, no_docs):
    for docs in (edge_docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = packed_batches(docs, max_tokens=500, budget=4000, buckets=5).collect()
        total = docs.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
        assert sum(r["n_tokens"] for r in rows) == total
        batches = {}
        for r in rows:
            assert r["n_tokens"] <= r["width"]
            batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        for members in batches.values():
            assert len(members) * members[0]["width"] <= 4000 or len(members) == 1
            assert sorted(r["slot"] for r in members) == list(range(len(members)))
        keys = [(r["doc_id"], r["copy"], r["segment"], r["n_tokens"], r["width"]) for r in rows if r["doc_id"] is not None]
        assert len(set(keys)) == len(keys)
        for bucket in {b for b, _ in batches}:
            sizes = [len(m) for (b, _), m in sorted(batches.items()) if b == bucket]
            assert len(set(sizes[:-1])) <= 1  # only the last batch of a bucket isn't full
    assert packed_batches(no_docs).count() == 0


def brute_top(vectors, queries, k):
    out = []
    for q, v in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v, x)), i) for i, x in vectors if i != q), key=lambda s: s)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    scale = rng.choice([1, 5, 40], 400)
    x = np.rint(rng.normal(size=(400, 12)) * scale[:, None] * np.linspace(4, 0.2, 12)).astype(int)
    x[50:90] = x[50]  # ties
    x[7] = 0
    vectors = [(i, [int(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*vectors, (None, [1] * 12), (999, None)], "vec_id long, v array<long>")
    queries = [v for v in vectors if v[0] % 10 == 0]
    for block, query_block in ((32, 8), (4096, 1024)):
        found = top_k_inner_products(df, df.where("vec_id % 10 = 0"), k=5, block=block, query_block=query_block)
        assert sorted(map(tuple, found.collect())) == brute_top(vectors, queries, 5)


def test_search_of_few_vectors(spark):
    rows = [(0, [1, 2]), (1, [3]), (2, []), (50, [4, 4])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    padded = [(i, v + [0] * (2 - len(v))) for i, v in rows]
    found = top_k_inner_products(df, df.where("vec_id % 50 = 0"), k=5)
    assert sorted(map(tuple, found.collect())) == brute_top(padded, [p for p in padded if p[0] % 50 == 0], 5)
    assert top_k_inner_products(df.where("false"), df.where("false")).count() == 0
    assert top_k_inner_products(df, df.where("false")).count() == 0


def test_search_of_huge_and_repeated_vectors(spark):
    """Numbers whose products no float or long holds, equal lengths, repeated rows and
    columns of clashing names."""
    big = float(1 << 60)
    rows = [(i, [float(3 * i), 4.0, -1.0]) for i in range(40)] + [(40, [big, 1.0, 0.0]), (41, [big, 2.0, 0.0]), (42, [3e38, 0.0, 0.0]), (43, [1e200, -1e200, 5.0]), (44, [-big, 0.0, 1.0])]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").selectExpr("*", "1 AS id", "2 AS block", "3 AS score", "4 AS qblock")
    ints = [(i, [int(x) for x in v]) for i, v in rows]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for block in (4, 4096):
        found = top_k_inner_products(df, df.where("vec_id % 4 = 0"), k=5, block=block).collect()
        scores = {}
        for q, v in ints:
            if q % 4 == 0 and q not in scores:
                scores[q] = sorted((-clip(sum(a * b for a, b in zip(v, x))), i) for i, x in ints if i != q)[:5]
        assert sorted(map(tuple, found)) == sorted((q, r + 1, i, -s) for q, top in scores.items() for r, (s, i) in enumerate(top))


def test_search_where_lengths_are_equal(spark):
    rng = np.random.default_rng(6)
    signs = rng.choice([-1, 1], (300, 16))
    vectors = [(i, [int(c) for c in v * 7]) for i, v in enumerate(signs)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    found = top_k_inner_products(df, df.where("vec_id % 10 = 0"), k=5, block=32, query_block=8)
    assert sorted(map(tuple, found.collect())) == brute_top(vectors, [v for v in vectors if v[0] % 10 == 0], 5)


def test_quantised(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", quantised(F.col("e")).alias("v"))
    assert {r["vec_id"]: r["v"] for r in df.collect()} == {0: [128, -1], 1: None, 2: None, 3: None, 4: None, 5: []}


def test_surrogates_keep_format_and_identity():
    s = Surrogates(KEY)
    text = (
        "Mail Anna.Smith@Mail.Example.org or anna.smith@mail.example.org, call +1 (743) 555-3824 or +17435553824, card 4785 3805 9239 1139 / 4785380592391139, "
        "host 70.23.22.57, Mr. James Brown met Мария Иванова, password=54be64439e3e49cf, id 123-45-6789."
    )
    out, n = replaced(text, s, {})
    assert n == 13
    found = [text[a:b] for a, b, _, _ in entities(text)]
    for x in found:
        assert x not in out
    mails = re.findall(r"[\w.]+@[\w.]+", out)
    assert mails[0].lower() == mails[1] and mails[0][0].isupper() and mails[1].endswith(".org")
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1\d{10}", out)
    assert len(phones) == 2 and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\b\d{16}\b", out)
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] and cards[0][0] == "4"
    assert re.search(r"Mr\. \w+ \w+ met [А-Я]\w+ [А-Я]\w+ова,", out)
    assert replaced(text, Surrogates(b"other"), {})[0] != out
    assert entities("Thea is on the shing. 4.0 and 3.1 are versions; 1234567890123456 is no card.") == []


def test_surrogates_are_distinct():
    s = Surrogates(KEY)
    values = [f"+1743555{i:04d}" for i in range(3000)]
    assert len({s.of("phone", v) for v in values}) == 3000
    ips = [f"10.1.{i // 250}.{i % 250}" for i in range(2000)]
    assert len({s.of("ip", v) for v in ips}) == 2000
    mails = [f"a{i}@x.example.org" for i in range(1000)]
    assert len({s.of("email", v) for v in mails}) == 1000


def test_collisions_try_again(spark):
    s = Surrogates(KEY)
    rows = [("phone", "+15550001", s.of("phone", "+15550002")), ("phone", "+15550002", s.of("phone", "+15550002")), ("card", "4785380592391139", "4785380592391139")]
    again = retried(spark.createDataFrame(rows, "kind string, value string, surrogate string"), KEY).collect()
    assert {(r["kind"], r["value"]) for r in again} == {("phone", "+15550002"), ("card", "4785380592391139")}
    assert all(r["attempt"] == 1 for r in again)


def test_mentions_of_a_name_without_title():
    s = Surrogates(KEY)
    text = "Mr John Smith called. Smith left, John's mail a.smith@x.example.org stays Smithy. Dr Zhang: Zhang. Мария Иванова и Иванов. Wei Zhang, I."
    out, n = replaced(text, s, {})
    assert n == 11 and not re.search(r"\b(?:Smith|John|Zhang|Иванова?)\b", out) and "Smithy" in out
    family, given = s.of("family", "Smith"), s.of("male", "John")
    assert out.startswith(f"Mr {given} {family} called. {family} left, {given}'s mail ")
    assert re.search(r"Dr (\w+): \1\. ", out) and re.search(r" (\w+)а и \1\. ", out)
    assert entities("Smith left, and John came; password: --------") == []


def test_names_of_no_list():
    s = Surrogates(KEY)
    text = "My name is Priya Patel and Patel it stays. Contact: Kwame Mensah, or Chidi Eze <chidi@x.example.org>. Anna Kowalska met Kwame. Regards,\nNgozi Obi. Mrs Nadia Okafor came. Nadia left Okafor."
    out, n = replaced(text, s, {})
    assert not re.search(r"\b(?:Priya|Patel|Kwame|Mensah|Chidi|Eze|Anna|Kowalska|Ngozi|Obi|Nadia|Okafor)\b", out), out
    priya, patel = (s.of("word", x).capitalize() for x in ("priya", "patel"))
    assert out.startswith(f"My name is {priya} {patel} and {patel} it stays. ")
    assert entities("The Old Town is near New York. Call me. Dear all, Write to us at once. Contact the Team.") == []


def test_surrogates_equal_brute_force(spark):
    """Entities of all texts, their attempts and the texts by plain Python; short names
    share few surrogates, so some try again."""
    rng, s = random.Random(5), Surrogates(KEY)
    names = [a + b for a in "BDFGK" for b in "aeiou"]
    phones = [f"+1555{i:04d}" for i in range(30)]
    phones += [s.of("phone", p) for p in phones[:10]]  # the corpus holds surrogates
    texts = [f"Mr {rng.choice(names)} of {rng.choice(phones)} met Mrs {rng.choice(names)}, card 4785380592391139; {rng.choice(phones)}" for _ in range(120)] + [None, "", "nothing here"]
    known = {(k, v): 0 for t in texts if t for _, _, k, v in entities(t)}
    for _ in range(8):
        now, again = {e: s.of(*e, n) for e, n in known.items()}, set()
        for e, x in now.items():
            owner = min(v for (k, v), y in now.items() if k == e[0] and y == x)
            if owner != e[1] or x == e[1] or (e[0] == "phone" and (e[0], x) in known):
                again.add(e)
        for e in again:
            known[e] += 1
        if not again:
            break
    assert sum(n > 0 for (k, _), n in known.items() if k == "phone") >= 10
    docs = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = with_surrogates(docs, key=KEY).collect()
    wanted = [replaced(t, s, known) for t in texts]
    assert sorted(map(str, ((r["text"], r["n_entities"]) for r in rows))) == sorted(map(str, wanted))
    assert len({(k, s.of(k, v, n)) for (k, v), n in known.items()}) == len(known)


def test_second_attempts_reach_rows_without_id(spark, monkeypatch):
    from glossaspark.llm import surrogates

    again = spark.createDataFrame([("phone", "+15550001", 1)], "kind string, value string, attempt int")
    monkeypatch.setattr(surrogates, "retried", lambda listed, key: again)
    docs = spark.createDataFrame([(1, "call +15550001"), (None, "call +15550001"), (None, "now +15550001"), (2, None)], "doc_id long, text string")
    rows = with_surrogates(docs, key=KEY).collect()
    wanted = Surrogates(KEY).of("phone", "+15550001", 1)
    assert len(rows) == 4 and sorted(r["text"] or "" for r in rows) == ["", f"call {wanted}", f"call {wanted}", f"now {wanted}"]


def test_collisions_that_remain_stop_the_job(spark):
    rows = [("secret", "--------", "--------")]
    with pytest.raises(RuntimeError, match="no surrogate"):
        retried(spark.createDataFrame(rows, "kind string, value string, surrogate string"), KEY, rounds=1)


def test_surrogates_edge_rows(edge_docs, no_docs):
    out = with_surrogates(edge_docs, key=KEY)
    assert sorted(out.columns) == sorted(edge_docs.columns)
    before = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    rows = out.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r["doc_id"] == 11:
            assert r["n_entities"] == 3 and "555-3824" not in r["text"] and "smith" not in r["text"] and "f33e61" not in r["text"]
        else:
            assert r["text"] == before[r["doc_id"]] and r["n_entities"] == 0
    assert with_surrogates(no_docs, key=KEY).count() == 0


MAILS = [
    (1, 0, "user", "Shall we meet on Monday?\nThe room is free.\n\nBring the plans."),
    (1, 1, "assistant", "> Shall we meet   on monday?\n> The room is free.\nYes, at nine."),
    (1, 2, "user", "On Tue, A wrote:\n> Yes, at nine.\n>> Shall we meet on Monday?\nFine."),
    (1, 3, "user", "> > Yes, at nine.\n> Fine.\nOne more thing."),
    (1, 4, "user", "> nobody said this\nHm."),
    (2, 0, "user", "Yes, at nine."),
    (2, 1, "user", "> Shall we meet on Monday?\nOther place."),
    (1, 5, "user", "> the room is FREE. Shall we\nRe-wrapped? no"),
]


def test_quotations_are_linked(spark):
    df = spark.createDataFrame(MAILS, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in link_quotations(df).collect()}
    parents = {k: r["parent_turn"] for k, r in out.items()}
    assert parents == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): None, (1, 5): None, (2, 0): None, (2, 1): None}
    assert [out[1, t]["depth"] for t in range(5)] == [0, 1, 2, 3, 0] and out[1, 3]["thread_turn"] == 0
    assert out[1, 2]["text"] == "Fine." and out[1, 3]["text"] == "One more thing." and out[1, 0]["text"] == MAILS[0][3]
    assert out[1, 2]["n_quoted"] == 2
    threads = {(r["conv_id"], r["thread_turn"]): [m["text"] for m in r["messages"]] for r in conversations(link_quotations(df)).collect()}
    assert threads[1, 0] == [MAILS[0][3], "Yes, at nine.", "Fine.", "One more thing."]


def test_long_thread(spark):
    rows = [(1, 0, "user", "message 0 says so")] + [(1, i, "user", f"> message {i - 1} says so\nmessage {i} says so") for i in range(1, 40)]
    out = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: (r["thread_turn"], r["depth"]) for r in out} == {i: (0, i) for i in range(40)}


def brute_links(rows):
    """Parent of each message by comparing all pairs of a conversation."""
    out, parsed = {}, {(c, t): parse_message(x) for c, t, _, x in rows}
    for (c, t), (_, _, quoted, _) in parsed.items():
        found = [(level, -size, -u) for level, size, h in quoted for u in [max((u for d, u in parsed if d == c and u < t and h in parsed[d, u][1]), default=None)] if u is not None]
        out[c, t] = -min(found)[2] if found else None
    return out


def test_links_across_ranges_of_turns(spark):
    """A conversation far longer than a range, with a line that it quotes everywhere."""
    rng = random.Random(8)
    rows = []
    for t in range(300):
        said = rng.choice(["I agree.", f"message {t} is new", "I agree.\n\nAnd more."])
        past = rows[rng.randrange(t)][3].split("\n")[-1] if t and rng.random() < 0.7 else None
        rows.append((1, t, "user", f"> {past}\n{said}" if past else said))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted = brute_links(rows)
    for part in (7, 1024):
        out = reply_order(link_quotations(df, part_turns=part), part).collect()
        assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in out} == wanted
        place = {r["turn"]: (r["thread_turn"], r["position"]) for r in out}
        threads = {}
        for thread, position in place.values():
            threads.setdefault(thread, []).append(position)
        assert all(sorted(x) == list(range(len(x))) for x in threads.values())
        assert all(place[t][0] == place[p][0] and place[t][1] > place[p][1] for (_, t), p in wanted.items() if p is not None)
        lists = conversations(link_quotations(df, part_turns=part), part).collect()
        assert sum(len(r["messages"]) for r in lists) == 300 and max(len(r["messages"]) for r in lists) <= part


def test_mails_of_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", "a\nb"), (1, 2, None, "c"), (1, 3, "user", ""), (1, 3, "user", ""), (None, 1, "user", "x"), (2, 1, "user", "y"), (2, None, "user", "z")]
    out = as_mails(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    texts = sorted(((r["conv_id"] or 0, r["turn"] or 0, r["text"]) for r in out), key=str)
    assert len(out) == len(rows) and (1, 1, "a\nb") in texts and (2, 1, "y") in texts and (1, 0, None) in texts
    assert (1, 2, "On turn 1 user wrote:\n> a\n> b\n\nc") in texts
    assert texts.count((1, 3, "On turn 2 someone wrote:\n> c\n> > a\n> > b\n\n")) == 2


def test_parse_message():
    assert parse_message(None) == ("", [], [], 0)
    assert parse_message("a > b")[0] == "a > b" and parse_message("a > b")[3] == 0
    own, _, quoted, n = parse_message("Hi\n> x\n> > y\n>z\n\nBye")
    assert own == "Hi\n\nBye" and n == 3 and {q[0] for q in quoted} == {1, 2}


def test_quotation_edge_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "user", "> x"), (1, None, "user", "> x"), (2, 0, "user", ""), (3, 0, "user", "q " * 40_000), (3, 1, "user", "> " + "q " * 40_000 + "\nok"), (3, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit(1)).withColumn("own", F.lit("x"))
    out = link_quotations(df).collect()
    assert len(out) == len(rows)
    assert [r["parent_turn"] for r in out if r["text"] == "ok"] == [0]
    assert link_quotations(df.where("false")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    total, now = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, DATA).cache()
        assert after.columns == docs.columns
        if name in ("quality", "near_duplicates"):
            assert after.join(now.select("doc_id"), "doc_id", "left_anti").count() == 0
            assert after.count() == after.select("doc_id").distinct().count() > total // 2
        if name == "surrogates":
            assert after.count() == now.count()
            assert after.where(r"text RLIKE '[0-9]{3}[)] 555-[0-9]{4}'").join(now.select("text"), "text").count() == 0
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert packed.agg(F.sum("n_tokens")).first()[0] == now.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_mentions_in_capitals_and_many_names():
    surrogates = Surrogates(KEY)
    text, n = replaced("My name is Kwame Mensah. MENSAH wrote, Mensah_1 and Mensahs stay. Mrs Anna Petrov came; PETROV left.", surrogates, {})
    assert n == 6 and "MENSAH" not in text and "PETROV" not in text and "Mensah_1" in text and "Mensahs" in text
    family = text.split("My name is ")[1].split(".")[0].split()[-1]
    assert f". {family.upper()} wrote" in text
    letters = "abcdefghijklmnopqrst"
    many = [f"Q{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in "ab"][:16_000]
    long = " ".join(f"Mr {x} left, {x} said so." for x in many)
    started = time.time()
    assert len(entities(long)) == 2 * len(many) and time.time() - started < 20
