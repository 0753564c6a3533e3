"""The catalogue: names, and queries on fixed inputs or small tables beside their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import plain

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SMALL = [n for n in QUERIES if n.startswith(("fixed_", "sitemap_"))] + ["url_policies", "valid_urls", "merge_runs", "merge_overrides", "free_query", "pages_of_run", "page_lookup", "merge_pages_gated", "p4_found", "p4_parent_labels"]


@pytest.fixture(scope="module")
def db():
    import glob
    import os

    found = duckdb.connect()
    found.execute("set timezone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return found


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", SMALL)
def test_rows_equal_those_of_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = db.execute(SQL[name])
    have = [c[0] for c in found.description]
    assert sorted(have) == names
    want = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want
