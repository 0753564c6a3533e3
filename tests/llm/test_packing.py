import random
from bisect import bisect_left, insort
from collections import Counter

import pytest

from pagequarry.llm import packing as P


def best_fit_decreasing(sizes):
    rooms, n = [], 0
    for s in sorted(sizes.elements(), reverse=True):
        k = bisect_left(rooms, s)
        n += k == len(rooms)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else 1024) - s)
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_length_once(seed):
    rng = random.Random(seed)
    sizes = Counter(rng.choice([rng.randrange(1, 1025), rng.randrange(1, 100), 340, 700]) for _ in range(3000))
    plan = P.make_plan(dict(sizes))
    used = Counter()
    for contents, times in plan:
        assert sum(s * c for s, c in contents.items()) <= 1024 and times > 0
        for s, c in contents.items():
            used[s] += c * times
    assert used == sizes
    assert sum(t for _, t in plan) <= 1.02 * best_fit_decreasing(sizes) + 2


def test_small_histograms():
    assert P.make_plan({}) == [] and P.make_plan({1024: 3}) == [({1024: 1}, 1)] * 3
    assert sum(t for _, t in P.make_plan({512: 4})) == 2 and sum(t for _, t in P.make_plan({1: 1})) == 1


def test_documents_in_containers(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 1, 50, 300, 500, 500, 500, 1024, 1025, 2048, 5000])) for k in range(700)] + [(None, 7)]
    df = spark.createDataFrame(rows + rows[:50], "id long, n_tokens int")
    got = [tuple(r) for r in P.pack(spark, df, rows_per_bucket=10).collect()]
    fill, parts = Counter(), Counter()
    for i, part, n, container in got:
        fill[container] += n
        parts[i] += n
        assert 0 < n <= 1024
    assert max(fill.values()) <= 1024 and parts == Counter({i: n for i, n in rows if n})
    assert len({(i, p) for i, p, _, _ in got}) == len(got)
    assert sorted(fill) == list(range(len(fill)))
    assert {i for i, p, _, _ in got if p >= 1} == {i for i, n in rows if n > 1024}
    whole = Counter(i for i, _, _, _ in got)
    assert all(whole[i] == 1 for i, n in rows if 0 < n <= 1024)


def test_all_of_one_length(spark):
    df = spark.range(5000).selectExpr("id", "256 as n_tokens")
    got = P.pack(spark, df).groupBy("container_id").count().collect()
    assert len(got) == 1250 and {r["count"] for r in got} == {4}


def test_counts_of_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|> " * 3, "x"), (5, "a" * 100_000, "x")], "id long, text string, n_tokens string")
    got = {r["id"]: r["n_tokens"] for r in P.token_counts(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3 and got[5] > 1024
    assert P.pack(spark, P.token_counts(df.limit(0), "id", "text")).count() == 0
