import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import langid as G
from pagequarry.runtime import tokenizer_folder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_samples.parquet")


@pytest.fixture(scope="module")
def vocabulary():
    return G.Vocabulary.load(f"{tokenizer_folder()}/piece_bpe_32k.model")


def test_held_out_accuracy(samples, vocabulary):
    rows = [(r["lang"], r["text"]) for r in samples.collect()]
    random.Random(0).shuffle(rows)
    model = G.fit(rows[: len(rows) // 2], vocabulary)
    right = plain = 0
    held = rows[len(rows) // 2 :]
    for lang, text in held:
        right += model.languages[int(model.total(G.words_of(text)).argmax())] == lang
        plain += model.languages[int(model.total(G.words_of(G.plain_form(text).upper())).argmax())] == lang
    assert right >= 0.98 * len(held) and plain >= 0.95 * len(held)


def test_forward_sums_all_segmentations():
    words = G.Vocabulary(["▁a", "ab", "b", "a", "c", "bc", "abc", "▁ab"])
    p = np.random.default_rng(1).dirichlet(np.ones(words.size), 2).T
    model = G.LanguageModel(["x", "y"], words, p)
    for word in ("abc", "cab", "aabbc", "b", "abcabc"):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(word)]
            pieces = [word[a:b] for a, b in zip([0, *ends], ends)]
            ids = [words.ids.get("▁" + q, words.ids.get(q)) if k == 0 else words.ids.get(q) for k, q in enumerate(pieces)]
            if all(i is not None for i in ids):
                want += p[ids].prod(0)
        assert np.allclose(model.score([word])[0], np.log(want))


def test_long_runs_are_scored_whole(samples, vocabulary, monkeypatch):
    """A run without spaces is no other than its letters: rescaling changes nothing, and no piece is lost at a cut."""
    model = G.fit([(r["lang"], r["text"]) for r in samples.limit(60).collect()], vocabulary)
    words = ["internationalisation", "überraschung", "语言模型", "b" * 39]
    plain = model.score(words)
    monkeypatch.setattr(G, "_PLAIN", 0)
    assert np.allclose(plain, model.score(words))
    monkeypatch.undo()
    run = "".join(words) * 20
    assert np.isfinite(model.score([run])).all() and np.allclose(model.total([run, "a", run]), model.score([run, "a", run]).sum(0))
    assert run not in model.places and vocabulary.longest > 12


def test_totals_with_a_full_memory(samples, vocabulary, monkeypatch):
    model = G.fit([(r["lang"], r["text"]) for r in samples.limit(60).collect()], vocabulary)
    tokens = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    want = model.score(tokens).sum(0)
    monkeypatch.setattr(G, "_CACHE_WORDS", 90)
    got = np.zeros(len(model.languages))
    for a in range(0, 200, 60):
        model.learn(set(tokens[a : a + 60]))
        assert len(model.places) <= 90 + 60
        got += model.total(tokens[a : a + 60])
    assert np.allclose(got, want)


def test_segments_of_mixed_documents(spark, samples):
    by = {r["lang"]: r["text"] for r in samples.collect()}
    rows = [(1, f"{by['en']}\n\n{by['fr']}\n \n{by['zh']}", "en-US", 9), (2, None, "fr", 9), (3, "", None, 9), (4, "12 | 34.5 | 6\n" * 9, "en", 9), (5, by["de"].upper(), "xx", 9), (6, by["ja"], "Japanese", 9), (7, (by["it"] + " ") * 400, None, 9), (1, f"{by['en']}\n\n{by['fr']}\n \n{by['zh']}", "en-US", 9)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, seg_no int")
    got = {tuple(r) for r in G.mislabelled_segments(df, "id", "text", "lang", samples).collect()}
    assert got == {(1, 1, "fr"), (1, 2, "zh"), (5, 0, "de"), (7, 0, "it")}
    seg = G.segment_languages(df, "id", "text", samples)
    assert seg.filter("id = 4").first()["lang"] is None and seg.filter("confidence is not null and (confidence > 1 or confidence < 0.2)").isEmpty()
    docs = {r["id"]: r for r in G.document_languages(seg.distinct()).collect()}
    assert docs[1]["n_languages"] == 3 and docs[7]["lang"] == "it" and 4 not in docs
    assert G.segment_languages(df.limit(0), "id", "text", samples).count() == 0


def test_labels(spark):
    rows = [("EN", "en"), ("en_GB", "en"), (" pt-BR ", "pt"), ("Spanish (Mexico)", "es"), ("deu", "de"), ("zho-Hans", "zh"), ("xx", None), ("und", None), ("", None), (None, None), ("unknown", None), ("eng", "en"), ("english", "en"), ("item", None)]
    df = spark.createDataFrame(rows, "label string, want string").select("label", "want", G.labelled_language(F.col("label")).alias("got"))
    assert [tuple(r) for r in df.collect() if r["got"] != r["want"]] == []


def test_no_samples_is_an_error(spark, samples):
    with pytest.raises(ValueError):
        G.segment_languages(samples.selectExpr("1L as id", "text"), "id", "text", samples.limit(0))
