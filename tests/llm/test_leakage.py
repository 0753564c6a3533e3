import random

import numpy as np

from pagequarry.llm import leakage as K


def brute_force(docs, items, n):
    grams = {}
    for i, t in items:
        w = K.words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs if t for w in [K.words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def data():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(50)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 40])))) for i in range(20)] + [(20, None), (21, "")]
    docs = []
    for d in range(200):
        text = [word() for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            w = rng.choice(items[:20])[1].split()
            a = rng.randrange(len(w))
            text[5:5] = [x.upper() + "," for x in w[a : a + rng.randrange(8, 20)]]
        docs.append((d, "\n".join(text)))
    return [*docs, (500, None), (501, ""), docs[0]], items


def frames(spark):
    docs, items = data()
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_by_brute_force_with_any_filter(spark, monkeypatch):
    d, e, docs, items = frames(spark)
    want = brute_force(docs, items, 12)
    assert want
    for size in (K.MAX_FILTER_BYTES, 1):  # a filter that is too small lets more through to the join, and no more
        monkeypatch.setattr(K, "MAX_FILTER_BYTES", size)
        rows = K.leaked_spans(d, e, "doc_id", "text", "item_id", "text").collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["last_word"] - r["first_word"] >= 11 and r["n_windows"] >= 1 for r in rows)


def test_the_filter_holds_what_was_added():
    rng = np.random.default_rng(2)
    own, other = (rng.integers(0, 2**64, 20_000, dtype=np.uint64) for _ in range(2))
    f = K.GramFilter(K.GramFilter.empty(len(own)))
    f.add(own)
    assert f.may_hold(own).all() and f.may_hold(other).mean() < 0.01


def test_passages_apart_and_their_removal(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(14)) for c in "pq")
    docs = [(1, f"Before, {first.upper()}. Between {second}! After"), (2, "nothing here"), (3, None), (4, f"İİ {first} end")]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, k string")
    e = spark.createDataFrame([(7, f"{first} x {second}")], "item_id long, text string")
    runs = sorted(tuple(r) for r in K.leaked_runs(d, e, "doc_id", "text", "item_id", "text").collect())
    assert runs == [(1, 7, 1, 14), (1, 7, 16, 29), (4, 7, 1, 14)] or runs[:2] == [(1, 7, 1, 14), (1, 7, 16, 29)]
    clean = K.without_leaked_spans(d, e, "doc_id", "text", "item_id", "text")
    got = {r["doc_id"]: r["clean_text"] for r in clean.collect()}
    assert got == {1: "Before, . Between ! After", 2: "nothing here", 3: None, 4: "İİ  end"} and clean.columns == [*d.columns, "clean_text"]


def test_clean_corpus_keeps_the_rest(spark):
    d, e, docs, items = frames(spark)
    bad = {x for x, _ in brute_force(docs, items, 12)}
    kept = K.without_leaks(d, e, "doc_id", "text", "item_id", "text")
    assert {r["doc_id"] for r in kept.collect()} == {x for x, _ in docs} - bad and kept.columns == d.columns


def test_empty_sides_and_long_texts(spark):
    d, e, _, _ = frames(spark)
    assert K.leaked_spans(d.limit(0), e, "doc_id", "text", "item_id", "text").count() == 0
    assert K.leaked_spans(d, e.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    passage = " ".join(f"p{k}" for k in range(12))
    long = spark.createDataFrame([(1, "filler " * 200_000 + passage + " tail" * 1000)], "doc_id long, text string")
    item = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert [tuple(r) for r in K.leaked_spans(long, item, "doc_id", "text", "item_id", "text").collect()] == [(1, 7, 200_000, 200_011, 1)]
