import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import near_dup as N
from pagequarry.llm.queries import p1_groups


def texts(seed=5, groups=12, singles=30):
    """Groups of edited copies, exact copies among them, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    out = []
    for _ in range(groups):
        base = [word() for _ in range(150)]
        for _ in range(rng.randrange(2, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 2, 5, 9])):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [" ".join(word() for _ in range(120)) for _ in range(singles)]
    rng.shuffle(out)
    return out


def brute_force(rows, size, similarity, min_words):
    shingler = N.Shingler(size, min_words)
    sets = {i: set(s.tolist()) for i, t in rows if (s := shingler(t)) is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize(("size", "similarity"), [(3, 0.7), (5, 0.8)])
def test_all_pairs_of_brute_force(spark, size, similarity):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id long, text string")
    members, links = N.near_duplicates(df, "id", "text", size, similarity, 80)
    got = {tuple(r) for r in N.expanded(members, links).collect()}
    assert got == brute_force(rows, size, similarity, 80)


@pytest.fixture
def small_nodes(monkeypatch):
    monkeypatch.setattr(N, "NODE_SIZE", 32)
    monkeypatch.setattr(N, "BLOCK", 32)


def test_many_alike_in_one_node(spark, small_nodes):
    """More texts alike than a node may hold: it is dense, and blocks are compared cell by cell."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "id long, text string")
    members, links = N.near_duplicates(df, "id", "text", 3, 0.7, 80)
    got = {tuple(r)[:2] for r in links.collect()}
    want = brute_force(rows, 3, 0.7, 80)
    assert got <= want and len(got) >= 0.99 * len(want)
    groups = N.near_duplicate_groups(members, links)
    assert groups.select("group_id").distinct().count() == 1 and groups.filter("n_links = 149").count() >= 140


def test_nulls_short_long_and_repeated_texts(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, "too short", "c"), (4, long, "d"), (4, long, "d"), (5, long + " end", "e"), (6, long, "f"), (None, "z", "g")]
    df = spark.createDataFrame(rows, "id long, text string, rep string")
    members, links = N.near_duplicates(df, "id", "text", 3, 0.7, 80)
    assert {tuple(r) for r in members.collect()} == {(4, 4), (5, 5), (6, 4)}
    assert {tuple(r) for r in N.expanded(members, links).collect()} == {(4, 5), (4, 6), (5, 6)}
    assert {tuple(r) for r in N.near_duplicate_groups(members, links).collect()} == {(4, 4, 1), (5, 4, 1), (6, 4, 1)}
    members, links = N.near_duplicates(df.limit(0), "id", "text")
    assert members.count() == 0 and N.expanded(members, links).count() == 0 and N.near_duplicate_groups(members, links).count() == 0


def test_groups_of_all_ids_and_short_copies(spark):
    many = " ".join(f"w{k}" for k in range(90))
    rows = [(1, None), (2, ""), (3, "Not found"), (4, "not FOUND!"), (5, "one two three four"), (6, "One, two, three, four."), (7, many), (8, many + " end"), (9, "***"), (9, "***"), (10, "found not")]
    df = spark.createDataFrame(rows, "id long, text string")
    groups = N.near_duplicate_groups(*N.near_duplicates(df, "id", "text", 3, 0.7, 1), df.select("id"))
    assert sorted(tuple(r) for r in groups.collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 3, 0), (5, 5, 0), (6, 5, 0), (7, 7, 1), (8, 7, 1), (9, 9, 0), (10, 10, 0)]


def test_order_of_words_in_a_shingle():
    shingler = N.Shingler(3, 1)
    assert all(shingler(f"a{k} b{k} c").tolist() != shingler(f"b{k} a{k} c").tolist() for k in range(50))


def test_p1_groups_has_a_row_for_every_page(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "Not found."), (3, "not found"), (4, "x")], "id long, markdown string").write.parquet(f"{tmp_path}/crawler_pages.parquet")
    assert sorted(tuple(r) for r in p1_groups(spark, str(tmp_path)).collect()) == [(1, 1, 0), (2, 2, 0), (3, 2, 0), (4, 4, 0)]


def test_string_ids_and_chains(spark):
    base = [f"w{k}" for k in range(100)]
    chain = [" ".join(base[:k] and [f"c{j}" for j in range(k)] + base[k:] or base) for k in (0, 8, 16, 24)]
    df = spark.createDataFrame([(f"id{k}", t) for k, t in enumerate(chain)], "id string, text string")
    members, links = N.near_duplicates(df, "id", "text", 3, 0.8, 80)
    groups = {r["id"]: r["group_id"] for r in N.near_duplicate_groups(members, links).collect()}
    assert groups == dict.fromkeys(groups, "id0") and len(groups) == 4
    assert links.select(F.min("jaccard")).first()[0] >= 0.8


def test_number_of_trees_follows_the_target():
    assert N.n_trees(0.7, 1.93, 10, 0.999) > N.n_trees(0.7, 1.93, 10, 0.9) >= N.n_trees(0.9, 1.93, 10, 0.9)


def sketched_pairs(similarity, n, rng):
    """Sketches of n pairs of sets of exactly the similarity, 200 tokens in each union."""
    functions, common = N._functions(), round(200 * similarity)
    one = (200 - common) // 2
    sets = [rng.integers(1, 2**63, 200, dtype=np.uint64) for _ in range(n)]
    return [np.stack([N.sketch(t, functions) for t in side]) for side in ([t[: common + one] for t in sets], [np.r_[t[:common], t[common + one :]] for t in sets])]


@pytest.mark.parametrize("similarity", [0.7, 0.8])
def test_recall_at_the_threshold_on_every_level(similarity):
    a, b = sketched_pairs(similarity, 4000, np.random.default_rng(3))
    branches = 1 / similarity + N.SURPLUS
    trees = N.n_trees(similarity, branches, N.LEVELS, 0.999)
    met, taken, offered = np.zeros((N.LEVELS + 1, len(a)), bool), 0, 0
    for root in N.roots(trees):
        pair, node = np.arange(len(a)), np.full(len(a), root, np.uint64)
        for level in range(1, N.LEVELS + 1):
            (row, child), (row_b, child_b) = N._branch(node, a[pair], branches), N._branch(node, b[pair], branches)
            assert (row == row_b).all()  # equal nodes draw equal coordinates
            taken, offered = taken + len(row), offered + len(node)
            same = child == child_b
            pair, node = pair[row[same]], child[same]
            met[level, pair] = True
    assert abs(taken / offered - branches) < 0.02
    assert (met[1:].mean(1) >= 0.998).all()


@pytest.mark.parametrize("shared", [0.3, 0.5])
def test_a_large_node_of_unlike_sets_falls_apart(shared):
    """200,000 sets that agree in a share of their coordinates, as by a common frame, and in nothing else."""
    rng = np.random.default_rng(1)
    n, branches = 200_000, 1 / 0.7 + N.SURPLUS
    coordinates = rng.integers(0, 2**16, (n, N.N_COORDINATES), dtype=np.uint16)
    coordinates[:, rng.random(N.N_COORDINATES) < shared] = 5
    rows, total = np.arange(n), 0
    node = np.full(n, N.roots(1)[0], np.uint64)
    for level in range(N.LEVELS):
        row, child = N._branch(node, coordinates[rows], branches)
        rows = rows[row]
        total += len(rows)
        _, inverse, counts = np.unique(child, return_inverse=True, return_counts=True)
        large = counts[inverse] > N.NODE_SIZE
        rows, node = rows[large], child[large]
        if not len(rows):
            break
    assert total <= 2 * N.LEVELS * n


def test_levels_go_on_until_nodes_are_small(spark, small_nodes):
    """Unlike texts in a common frame fill large nodes; pairs among them are still found."""
    rng = random.Random(4)
    frame = [f"f{k}" for k in range(60)]
    rows = []
    for i in range(300):
        own = [f"o{rng.randrange(10**6)}" for _ in range(80)]
        rows.append((2 * i, " ".join(frame + own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(frame + own[:70] + [f"n{i}"] * 10)))
    df = spark.createDataFrame(rows, "id long, text string")
    members, links = N.near_duplicates(df, "id", "text", 3, 0.7, 80)
    assert {tuple(r)[:2] for r in links.collect()} == brute_force(rows, 3, 0.7, 80)
