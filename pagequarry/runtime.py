"""Session, table and durable-intermediate helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}
_WRITTEN: list[str] = []
_SHIPPED: set[str] = set()


def local_session(app: str = "pagequarry", cores: int | str = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application, unless they find it themselves.

    Workers of a local master see the working folder and PYTHONPATH; those of a cluster get a zip file with the package.
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    seen = {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if spark.sparkContext.master.startswith("local") and root in seen:
        return
    folder = tempfile.mkdtemp(prefix="pagequarry-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "pagequarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted((root / "pagequarry").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_once(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table, of rows delivered twice under one key only the first (by file and place); rows with
    a null key all stay. Keys and places alone are shuffled: wide columns are read in place."""
    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    rows = read_table(spark, sf_dir, name)
    keys = rows.select(key, *place).filter(F.col(key).isNotNull())
    twice = keys.groupBy(key).agg(F.min(F.struct("__file", "__row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select(key, "first")
    again = keys.join(small_side(twice), key).filter(F.struct("__file", "__row") != F.col("first")).select("__file", "__row")
    wanted = rows.select(*columns, *place)
    return wanted.join(small_side(again), ["__file", "__row"], "left_anti").select(*columns)


def durable_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where it is unset under a local master (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: a temporary folder of one machine is lost with it")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="pagequarry-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return "file://" + _LOCAL_FOLDERS[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the durable folder and read it back.

    The lineage is cut by a table that outlives any executor. A plan that is read more than once
    (counts and then rows, rounds of an iteration) is computed once.
    """
    ship_package(df.sparkSession)
    path = f"{durable_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, as counted; otherwise df as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def clear_durable(spark: SparkSession) -> None:
    """Delete the tables that materialize has written in this session; results that still read them must be done with."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in _WRITTEN:
        where = hadoop.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.clear()


def tokenizer_folder() -> str:
    """Folder of public tokenizer files: PAGEQUARRY_TOKENIZERS, else the installed package, else /opt/tokenizers."""
    named = os.environ.get("PAGEQUARRY_TOKENIZERS")
    if named:
        return named
    try:
        import public_tokenizers

        return os.path.dirname(public_tokenizers.__file__)
    except ImportError:
        return "/opt/tokenizers"
