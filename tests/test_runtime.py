import os

import pytest

from pagequarry import runtime


def test_durable_tables_are_written_and_cleared(spark):
    df = runtime.materialize(spark.range(5).selectExpr("id", "cast(null as string) as t"), "test")
    assert df.count() == 5 and df.schema["t"].dataType.simpleString() == "string"
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    runtime.clear_durable(spark)
    assert not os.path.exists(path)


def test_folder_comes_from_the_session():
    class Named:
        class conf:
            get = staticmethod(lambda key, default=None: "file:///shared/checkpoints/" if key == "spark.checkpoint.dir" else default)

    assert runtime.durable_folder(Named) == "file:///shared/checkpoints"


def test_catalogue_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_workers_get_the_package_from_anywhere(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
from pagequarry.runtime import local_session
spark = local_session("elsewhere", 2)
print("ROWS", e.entry(spark).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_rows_delivered_twice_are_read_once(spark, tmp_path):
    from pagequarry.runtime import read_once

    rows = [(1, "a", "x"), (2, "b", "y"), (2, "b", "y"), (None, "n", "z"), (None, "n", "z"), (3, "c", None)]
    spark.createDataFrame(rows, "id long, t string, w string").repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.createDataFrame(rows[:2], "id long, t string, w string").write.mode("append").parquet(f"{tmp_path}/t.parquet")
    got = read_once(spark, str(tmp_path), "t", "id", "id", "w")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x"), (2, "y"), (3, None), (None, "z"), (None, "z")], key=repr)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from pagequarry import runtime

    class Named:
        def __init__(self, **values):
            self.__dict__.update(values)

    none = Named(get=lambda *_: None)
    cluster = Named(conf=none, sparkContext=Named(getConf=lambda: none, master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError):
        runtime.durable_folder(cluster)
