import itertools

import numpy as np
import pytest

from pagequarry.llm import quality as Q

COMMON = ["the", "a", "of", "and", "it", "is", "to"]
PROSE = "It is the end of the day and a good one. The cat is on the mat, and it is to stay.\n"
TABLE = "| a1 | 22 | 33 |\n" * 12
JUNK = "x9q-zzkw//%%~~ 8f8f8f8f8f8f8f#### ====\n"


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([(w, "en") for w in COMMON] + [(None, "en")], "word string, lang string")


def test_statistics_by_brute_force(spark, common):
    rows = [(1, PROSE * 3, "k"), (2, TABLE, "k"), (3, "", "k"), (4, None, "k"), (5, " \n\t", "k"), (6, "Ünïcode wörds, «quoted»! 你好。", "k"), (1, PROSE * 3, "k"), (7, PROSE * 4000, None)]
    df = spark.createDataFrame(rows, "id long, text string, kind string")
    got = {r["id"]: r for r in Q.text_quality(df, "id", "text", common).collect()}
    for i, text, _ in rows:
        r = got[i]
        words = (text or "").split()
        if not words:
            assert r["n_words"] == (None if text is None else 0) and r["mean_word_length"] is None and r["kind"] is None
            continue
        chars = [c for c in text if not c.isspace()]
        lines = [x for x in text.split("\n") if x.strip()]
        strip = lambda w: w.strip("".join({c for c in w if not c.isalnum()}))
        assert r["n_words"] == len(words)
        assert r["mean_word_length"] == pytest.approx(len(chars) / len(words))
        assert r["symbol_ratio"] == pytest.approx(sum(not c.isalnum() for c in chars) / len(chars))
        assert r["ended_share"] == pytest.approx(sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines))
        assert r["common_share"] == pytest.approx(sum(w.lower() in COMMON or strip(w.lower()) in COMMON for w in words) / len(words))
    assert Q.text_quality(df.filter("id = 4"), "id", "text", common).count() == 1


def test_kinds_of_lines(spark, common):
    rows = [(k, t * n) for k, (t, n) in enumerate([(PROSE, 6), (TABLE, 1), ("- the list of it\n- a thing to do\n", 6), (JUNK, 8)] * 8)]
    df = spark.createDataFrame(rows, "id long, text string")
    kinds = {r["id"]: r["kind"] for r in Q.text_quality(df, "id", "text", common).collect()}
    assert [kinds[k] for k in range(4)] == ["prose", "table", "list", "junk"]


def test_poor_texts_need_two_tests(spark, common):
    df = spark.createDataFrame([(1, PROSE * 2), (2, TABLE), (3, "ab cd " * 30), (4, "| 1 |")], "id long, text string")
    assert {r["id"] for r in Q.poor_quality(Q.text_quality(df, "id", "text", common)).collect()} == {2, 3}


def test_empty_table(spark, common):
    assert Q.text_quality(common.selectExpr("1L as id", "word as text").limit(0), "id", "text", common.limit(0)).count() == 0


def model_of(features):
    code = Q.codes(Q.bins(np.concatenate(features)))
    lengths = np.array([*map(len, features)])
    return Q.LineModel(Q.seed_counts(code, Q.seed_labels(np.concatenate(features)), lengths))


def random_features(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return [np.stack([rng.uniform(0, 200, n), rng.integers(0, 2, n), rng.random(n), rng.random(n), rng.integers(0, 2, n), rng.integers(0, 3, n), rng.random(n), rng.uniform(2, 10, n)], 1) for n in lengths]


def test_labels_in_step_equal_labels_one_by_one():
    features = random_features((5, 1, 9, 3))
    model = model_of(features)
    lengths = np.array([0, *map(len, features), 0])
    together = model.label(Q.codes(Q.bins(np.concatenate(features))), lengths)
    alone = np.concatenate([model.label(Q.codes(Q.bins(f)), np.array([len(f)])) for f in features])
    assert (together == alone).all()
    # Viterbi against all paths
    f = features[3]
    e = model.scores[Q.codes(Q.bins(f))]
    best = max(itertools.product(range(4), repeat=3), key=lambda p: model.start[p[0]] + sum(e[t, p[t]] for t in range(3)) + sum(model.move[p[t], p[t + 1]] for t in range(2)))
    assert tuple(model.label(Q.codes(Q.bins(f)), np.array([3]))) == best


def test_expected_counts_are_those_of_all_paths():
    features = random_features((3, 2, 4), 1)
    model = model_of(features)
    code, lengths = Q.codes(Q.bins(np.concatenate(features))), np.array([3, 2, 4, 0])
    first, pairs, weights = np.zeros(4), np.zeros((4, 4)), []
    for f in features:
        e, n = model.scores[Q.codes(Q.bins(f))], len(f)
        paths = list(itertools.product(range(4), repeat=n))
        p = np.array([np.exp(model.start[x[0]] + sum(e[t, x[t]] for t in range(n)) + sum(model.move[x[t], x[t + 1]] for t in range(n - 1))) for x in paths])
        w = np.zeros((n, 4))
        for x, share in zip(paths, p / p.sum()):
            first[x[0]] += share
            for t in range(n):
                w[t, x[t]] += share
                if t:
                    pairs[x[t - 1], x[t]] += share
        weights.append(w)
    assert np.allclose(model.expect(code, lengths), Q.expected_counts(first, pairs, code, np.concatenate(weights)))


def test_accuracy_on_labelled_lines(spark, common):
    """Documents of runs of lines whose kinds are known, with lines in each kind's run that look like another's."""
    rng = np.random.default_rng(7)
    words = ["garden", "window", "painter", "river", "market", "teacher", "winter", "kitchen"]
    some = lambda n: " ".join(rng.choice(words + COMMON, n))
    make = {
        "prose": lambda: f"The {some(rng.integers(9, 25))} is of the {some(4)}." if rng.random() < 0.9 else f"and it is {some(12)}",
        "list": lambda: f"- the {some(rng.integers(1, 5))}" if rng.random() < 0.9 else f"{rng.integers(1, 9)}. a {some(2)}",
        "table": lambda: "| " + " | ".join(str(rng.integers(10, 9999)) for _ in range(4)) + " |",
        "junk": lambda: " ".join("".join(rng.choice(list("x9#~=%q7&"), rng.integers(8, 20))) for _ in range(4)),
    }
    rows, truth = [], {}
    for i in range(120):
        kinds = [k for _ in range(rng.integers(2, 6)) for k in [rng.choice(list(make))] * int(rng.integers(3, 9))]
        rows.append((i, "\n\n".join(make[k]() for k in kinds)))
        truth[i] = kinds
    got = {r["id"]: r["labels"] for r in Q.line_labels(spark.createDataFrame(rows, "id long, text string"), "id", "text", common).collect()}
    right = sum(a == b for i in truth for a, b in zip(got[i], truth[i]))
    assert right >= 0.97 * sum(map(len, truth.values())) and all(len(got[i]) == len(truth[i]) for i in truth)
