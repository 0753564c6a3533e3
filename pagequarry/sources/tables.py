"""Crawl tables as files: snapshots in key buckets, point lookups and exports.

A stored table is a folder with data folders, one per write, and `_commits`, numbered files that say which folders
make up the table. A write puts its data beside what is there and becomes visible by its commit, which appears under
its name at once; before that, and after any failure, the table is what it was. Pages and aliases lie in buckets by
host and key, so that `update` reads and writes only the buckets of the keys that change. One writer at a time.

Defined results: a table never written is empty; a plain folder of Parquet files is read as it is and gets buckets
with its first update; a commit that cannot be read (its writer died) is passed over; the folders of the snapshot
before the current one are kept, older ones deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..runtime import ship_package

TABLES = {
    "crawler_pages": schemas.CRAWLER_PAGES,
    "url_aliases": schemas.URL_ALIASES,
    "crawl_runs": schemas.CRAWL_RUNS,
    "domain_overrides": schemas.DOMAIN_OVERRIDES,
    "research_projects": schemas.RESEARCH_PROJECTS,
    "research_project_runs": schemas.RESEARCH_PROJECT_RUNS,
    "sitemap_urls": schemas.SITEMAP_URLS,
}
#: Tables in buckets, by the key of their rows.
KEYS = {"crawler_pages": "final_url", "url_aliases": "requested_url"}
#: Buckets of a new table (for about 1 GB each: more for more), and buckets that one host is spread over.
BUCKETS, SPREAD = 64, 16
KEPT_COMMITS = 2


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a URL: a site's rows lie in a few buckets, and no site, however large, lies in one. Letter case does not count."""
    low = F.lower(key)
    return F.pmod(F.xxhash64(F.regexp_extract(low, r"^[a-z]+://([^/:?#]*)", 1), F.pmod(F.xxhash64(low), F.lit(SPREAD))), F.lit(buckets)).cast("int")


class _Files:
    """The file system of a table's folder."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.jvm, self.root = spark._jvm, f"{folder}/{name}"
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, part: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}" if part else self.root)

    def names(self, part: str) -> list[str]:
        where = self.path(part)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def commits(self) -> list[str]:
        return [n for n in self.names("_commits") if n.endswith(".json")]

    def load(self, name: str) -> dict | None:
        stream = self.fs.open(self.path(f"_commits/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def current(self) -> dict:
        for name in reversed(self.commits()):
            if (found := self.load(name)) is not None:
                return found
        if any(not n.startswith(("_", ".")) for n in self.names("")):
            return {"folders": {"plain": ""}, "buckets": 0, "top": None}
        return {"folders": {}, "buckets": 0, "top": 0}

    def commit(self, content: dict) -> None:
        """Written under a passing name, then renamed: a commit is there as a whole or not at all."""
        passing, last = self.path(f"_commits/.{uuid.uuid4().hex}"), self.commits()
        out = self.fs.create(passing)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        number = int(last[-1].split(".")[0]) + 1 if last else 1
        if not self.fs.rename(passing, self.path(f"_commits/{number:012d}.json")):
            raise OSError(f"commit {number} of {self.root} is there already")

    def clean(self) -> None:
        """Delete what none of the last commits names."""
        names = self.commits()
        kept = [c for n in names[-KEPT_COMMITS:] if (c := self.load(n)) is not None]
        folders = {f for c in kept for f in c["folders"].values()}
        if len(names) < KEPT_COMMITS:  # what was there before the first commit
            folders.add("")
        for old in names[:-KEPT_COMMITS]:
            self.fs.delete(self.path(f"_commits/{old}"), False)
        for name in self.names(""):
            if name == "_commits":
                continue
            if name.startswith("data-"):
                for part in self.names(name) if name not in folders else ():
                    if part.startswith("bucket=") and f"{name}/{part}" not in folders:
                        self.fs.delete(self.path(f"{name}/{part}"), True)
                if name not in folders and not any(f.startswith(f"{name}/") for f in folders):
                    self.fs.delete(self.path(name), True)
            elif "" not in folders:
                self.fs.delete(self.path(name), True)


def _read(spark: SparkSession, files: _Files, name: str, folders: list[str]) -> DataFrame:
    if not folders:
        return empty_table(spark, name)
    return spark.read.schema(TABLES[name]).parquet(*[files.path(f).toString() for f in folders])


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table; an empty one where nothing was written yet."""
    ship_package(spark)
    files = _Files(spark, folder, name)
    return _read(spark, files, name, list(files.current()["folders"].values()))


def _write(df: DataFrame, files: _Files, name: str, buckets: int) -> dict[str, str]:
    """Write a data folder; its folders by bucket."""
    data = f"data-{uuid.uuid4().hex}"
    where = files.path(data).toString()
    if not buckets:
        df.write.option("compression", "zstd").parquet(where)
        return {"all": data}
    placed = df.withColumn("bucket", bucket_of(F.col(KEYS[name]), buckets)).hint("rebalance", "bucket")
    placed.write.option("compression", "zstd").partitionBy("bucket").parquet(where)
    return {n.split("=")[1]: f"{data}/{n}" for n in files.names(data) if n.startswith("bucket=")}


def replace(df: DataFrame, folder: str, name: str) -> None:
    """A new snapshot of the whole table. df may read the table it replaces."""
    spark = df.sparkSession
    files = _Files(spark, folder, name)
    before = files.current()
    buckets = (before["buckets"] or BUCKETS) if name in KEYS else 0
    files.commit({"folders": _write(df, files, name, buckets), "buckets": buckets, "top": None})
    files.clean()


def update(spark: SparkSession, folder: str, name: str, keys: DataFrame, change: Callable[[DataFrame, int], DataFrame]) -> None:
    """Change the rows of some keys. keys: one column with them. change(stored, top) gets the stored rows of the keys'
    buckets and the largest id of the table, and gives the new rows of these buckets. Other buckets are neither read
    nor written; a plain folder is read whole once."""
    ship_package(spark)
    files = _Files(spark, folder, name)
    before = files.current()
    buckets, folders, top = before["buckets"] or BUCKETS, before["folders"], before["top"]
    has_id = "id" in schemas.struct(TABLES[name]).names
    if top is None:
        top = (_read(spark, files, name, list(folders.values())).agg(F.max("id")).first()[0] or 0) if has_id else 0
    if before["buckets"]:
        touched = {str(r[0]) for r in keys.select(bucket_of(F.col(keys.columns[0]), buckets)).distinct().collect()}  # at most as many as there are buckets
    else:
        touched = set(folders)
    changed = change(_read(spark, files, name, [f for b, f in folders.items() if b in touched]), top)
    written = _write(changed, files, name, buckets)
    if has_id and written:
        top = max(top, _read(spark, files, name, list(written.values())).agg(F.max("id")).first()[0] or 0)
    files.commit({"folders": {b: f for b, f in folders.items() if b not in touched} | written, "buckets": buckets, "top": top})
    files.clean()


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The row with a key, if there is one."""
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def by_run(pages: DataFrame, run_id: str) -> DataFrame:
    return pages.filter(F.col("run_id") == run_id).orderBy("id")


def select_pages(pages: DataFrame, url_part: str | None = None, status: str | None = None, run_id: str | None = None, pending: str | None = None) -> DataFrame:
    """Pages by whichever predicates are given. % and _ in url_part are wildcards; letter case does not count.

    pending: a column that has to be null still.
    """
    if url_part is not None:
        pages = pages.filter(F.col("final_url").ilike(f"%{url_part}%"))
    if status is not None:
        pages = pages.filter(F.col("crawl_status") == status)
    if run_id is not None:
        pages = pages.filter(F.col("run_id") == run_id)
    if pending is not None:
        pages = pages.filter(F.col(pending).isNull())
    return pages


def overrides(table: DataFrame, enabled_only: bool = True) -> DataFrame:
    return table.filter("enabled") if enabled_only else table


def run_query(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """SQL with named parameters (:name)."""
    return spark.sql(text, args=parameters or None)


def export_json(df: DataFrame, path: str, single_array: bool = False) -> None:
    """JSON lines, one file per partition; single_array writes one array into one file, for results that a person reads."""
    if not single_array:
        df.write.mode("overwrite").json(path)
        return
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    rows = rows.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("string").alias("j"))).coalesce(1)  # the null row closes the array

    def wrap(batches):
        import pandas as pd

        lead = "["
        for batch in batches:
            lines = []
            for j in batch["j"].dropna():
                lines.append(lead + j)
                lead = ","
            yield pd.DataFrame({"value": pd.Series(lines, dtype=object)})
        yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})

    rows.mapInPandas(wrap, "value string").write.mode("overwrite").text(path)


def read_sitemaps(spark: SparkSession, path: str, ord: int = 0) -> DataFrame:
    """sitemap_source (file name as URL or path), sitemap_ord, xml of sitemap files, one row per file."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("sitemap_source"), F.lit(ord).alias("sitemap_ord"), F.col("value").alias("xml"))


def read_fetched(spark: SparkSession, path: str) -> DataFrame:
    """What a fetcher wrote: Parquet or, by file name, JSON lines."""
    reader = spark.read.schema(schemas.FETCHED_PAGES)
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)
