import pytest
from pyspark.sql import functions as F

from pagequarry.operators.shred import outline_parents, shred_table, shred_tables

SCHEMA = "id long, pos string, nav struct<items:array<struct<label:string,depth:int,pos:int,tags:array<string>>>, meta:struct<n:int>>, hops array<string>, deep array<array<int>>"
ROWS = [
    (1, "x", (([("a", 0, 7, ["t", None]), None, ("b", 1, 8, []), ("c", 3, 9, None), ("d", 2, 1, ["u"])]), (1,)), ["h0", None, "h2"], [[1, 2], None, [], [3]]),
    (2, None, None, None, None),
    (3, "y", (None, None), [], []),
    (4, "z", ([], (2,)), ["only"], [[]]),
    (None, "n", ([("q", None, None, ["v"])], None), [None], [[None]]),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_items_with_clashing_names_nulls_and_parents(records):
    rows = {(r["id"], r["pos"]): r for r in shred_table(records, "id", "nav.items", outline="depth").collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (None, 0)}
    assert rows[1, 1]["is_null"] and rows[1, 1]["label"] is None
    assert rows[1, 0]["leaf_pos"] == 7
    # c skips a level: the nearest smaller depth is b's, two above; d hangs under b
    assert [rows[1, k]["parent_pos"] for k in range(5)] == [-1, -1, 0, -1, 2]
    assert rows[None, 0]["parent_pos"] == -1


def test_inner_arrays_keep_their_places(records):
    rows = [(r["id"], r["outer_pos"], r["pos"], r["value"], r["is_null"]) for r in shred_table(records, "id", "nav.items[].tags").collect()]
    assert sorted(rows, key=repr) == sorted([(1, [0], 0, "t", False), (1, [0], 1, None, True), (1, [4], 0, "u", False), (None, [0], 0, "v", False)], key=repr)


def test_plain_and_nested_arrays(records):
    hops = {(r["id"], r["pos"], r["value"]) for r in shred_table(records, "id", "hops").collect()}
    assert hops == {(1, 0, "h0"), (1, 1, None), (1, 2, "h2"), (4, 0, "only"), (None, 0, None)}
    deep = {(r["id"], tuple(r["outer_pos"]), r["pos"], r["value"]) for r in shred_table(records, "id", "deep[]").collect()}
    assert deep == {(1, (0,), 0, 1), (1, (0,), 1, 2), (1, (3,), 0, 3), (None, (0,), 0, None)}


def test_several_arrays_in_one_pass(records):
    """Each list's rows are those it gives alone; leaves that a list lacks are null."""
    rows = shred_tables(records, "id", {"items": "nav.items", "hops": "hops"}, outline="depth")
    assert rows.columns == ["id", "list_name", "pos", "outer_pos", "is_null", "label", "depth", "leaf_pos", "value", "parent_pos"]
    for name, path, outline in (("items", "nav.items", "depth"), ("hops", "hops", None)):
        alone = shred_table(records, "id", path, outline=outline)
        mine = rows.filter(F.col("list_name") == name).select(*alone.columns)
        assert mine.exceptAll(alone).isEmpty() and alone.exceptAll(mine).isEmpty()
    assert rows.filter("list_name = 'hops' and (depth is not null or parent_pos is not null)").isEmpty()
    with pytest.raises(ValueError):
        shred_tables(records, "id", {"a": "hops", "b": "deep[]"})
    with pytest.raises(ValueError):
        shred_tables(records, "id", {"a": "hops", "b": "deep"} | {"c": "nav.items[].tags"})


def test_one_scan_reads_only_the_lists(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/crawler_pages.parquet")
    plan = shred_tables(pages, "id", {n: f"nav_structure.{n}" for n in ("primary_nav", "footer_nav")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "content_links" not in plan.split("ReadSchema")[1]


def test_empty_table_and_repeated_rows(spark, records):
    assert shred_table(records.limit(0), "id", "nav.items").count() == 0
    twice = records.unionByName(records)
    assert shred_table(twice, "id", "hops").count() == 2 * shred_table(records, "id", "hops").count()


def test_same_rows_as_native_explode(spark):
    path = "/root/testdata/sf0.001/crawler_pages.parquet"
    pages = spark.read.parquet(path)
    ours = shred_table(pages, "id", "nav_structure.footer_nav").select("id", "pos", "url", "depth")
    native = pages.select("id", F.posexplode("nav_structure.footer_nav").alias("pos", "i")).select("id", "pos", "i.url", "i.depth")
    assert ours.exceptAll(native).isEmpty() and native.exceptAll(ours).isEmpty()


def test_outline_by_brute_force():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        record = np.array(sorted(rng.randrange(3) for _ in range(20)))
        places = np.array([i - int(np.argmax(record == r)) for i, r in enumerate(record)])
        depth = [rng.choice([0, 1, 2, 3, None]) for _ in range(20)]
        want = []
        for i in range(20):
            near = [j for j in range(i) if record[j] == record[i] and depth[i] is not None and depth[j] is not None and depth[j] < depth[i]]
            want.append(int(places[near[-1]]) if near and depth[near[-1]] == depth[i] - 1 else -1)
        assert outline_parents(record, places, depth).tolist() == want
