"""From fetched pages to stored pages, aliases and run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import content_hash, crawl_status
from ..functions.urls import normalize_url
from ..runtime import materialize
from ..sources import tables
from . import discover, merge
from .pages import parse_pages


def located(fetched: DataFrame, compat: bool = False) -> DataFrame:
    """fetched with final_url, redirected and redirect_chain. A page was redirected if the identity of the URL it was
    asked for differs from the one it was loaded from (compat: if the URL as written differs). A supplied chain is kept."""
    asked = F.col("requested_url") if compat else F.coalesce(normalize_url(F.col("requested_url")), F.col("requested_url"))
    out = fetched.withColumn("final_url", F.coalesce(normalize_url(F.coalesce("loaded_url", "requested_url")), "loaded_url", "requested_url"))
    out = out.withColumn("redirected", asked != F.col("final_url"))
    chain = F.when(F.coalesce(F.size("redirect_chain"), F.lit(0)) > 0, F.col("redirect_chain")).when(F.col("redirected"), F.array("requested_url", "final_url"))
    return out.withColumn("redirect_chain", chain)


def page_events(fetched: DataFrame, hints: DataFrame | None = None, overrides: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Events for merge_pages: bodies parsed, whatever their status; failed requests become rows with their error."""
    rows = located(fetched, compat)
    if hints is not None:
        rows = discover.corrected_hints(rows, hints).drop("type_hint").withColumnRenamed("hint", "type_hint")
    carried = ("seq", "requested_url", "final_url", "status_code", "redirect_chain", "redirected", "type_hint", "run_id", "body")
    good = rows.filter("error is null")
    parsed = parse_pages(good.withColumn("html", F.col("body")), "html", "final_url", overrides, ("metadata", "content", "markdown", "nav"), carried, compat)
    done = parsed.select(
        "seq", "final_url", F.col("requested_url").alias("requested_url_original"), "status_code", crawl_status(F.col("status_code")).alias("crawl_status"), "redirect_chain",
        F.col("body").alias("html_content"), "clean_html", "markdown", "markdown_enhanced", "structural_stats", "nav_structure", "metadata.title", "metadata.h1", "metadata.meta_description", "word_count",
        content_hash(F.col("clean_html")).alias("content_hash"), F.col("type_hint").alias("sitemap_type_hint"), F.lit("cheerio").alias("fetch_mode"), "extraction_method", F.col("junk_score").cast("float").alias("junk_score"), F.lit(None).cast("string").alias("last_error"), "run_id",
    )
    kinds = {f.name: f.dataType for f in schemas.struct(schemas.CRAWLER_PAGES)}
    known = {"requested_url_original": F.col("requested_url"), "final_url": F.col("final_url"), "crawl_status": F.lit("ERROR"), "last_error": F.col("error"), "run_id": F.col("run_id"), "sitemap_type_hint": F.col("type_hint"), "word_count": F.lit(0), "fetch_mode": F.lit("cheerio")}
    failed = rows.filter("error is not null").select("seq", *[known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in kinds if c not in ("id", "last_crawled_at")])
    return done.select(*failed.columns).unionByName(failed)


def alias_events(fetched: DataFrame, compat: bool = False) -> DataFrame:
    """Redirects of pages that were loaded, for merge_aliases."""
    return located(fetched, compat).filter("error is null and redirected").select("seq", "requested_url", "final_url", "status_code", "redirect_chain", "run_id")


def ingest(spark: SparkSession, folder: str, fetched: DataFrame, now: Column | None = None, hints: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Merge fetched pages into the tables in folder; returns one row of figures per run. The fetched rows are read once
    for parsing; events are written before they are merged, so that a lost executor costs no second parse. Of the tables
    only the buckets of the fetched URLs are read and written."""
    now = F.current_timestamp() if now is None else now
    overrides = tables.read(spark, folder, "domain_overrides")
    events = materialize(page_events(fetched, hints, overrides, compat), "page-events")
    aliases = materialize(alias_events(fetched, compat), "alias-events")
    tables.update(spark, folder, "crawler_pages", events.select("final_url"), lambda stored, top: merge.merge_pages(stored, events, now, top=top))
    tables.update(spark, folder, "url_aliases", aliases.select("requested_url"), lambda stored, _: merge.merge_aliases(stored, aliases, now))
    figures = events.groupBy("run_id").agg(F.count_if(F.col("last_error").isNull()).cast("int").alias("total_pages_crawled"), F.count_if(F.col("last_error").isNotNull()).cast("int").alias("total_errors"), F.max("seq").alias("seq"))
    redirects = aliases.groupBy("run_id").agg(F.count("*").cast("int").alias("total_redirects"))
    return figures.join(redirects, "run_id", "left").withColumn("total_redirects", F.coalesce("total_redirects", F.lit(0)))


def record_run(spark: SparkSession, folder: str, created: DataFrame, figures: DataFrame, finished: DataFrame) -> None:
    """Append a run to the table of runs and set its figures and end."""
    runs = tables.read(spark, folder, "crawl_runs")
    tables.replace(merge.fold_runs(runs.unionByName(created), figures, finished), folder, "crawl_runs")
