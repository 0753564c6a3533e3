"""Commands: crawl, research, backfill-markdown, backfill-nav, clear-domain. `python -m pagequarry.cli --help`."""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import backfill, discover, ingest, merge, reports
from .sources import tables


def _spark() -> SparkSession:
    return SparkSession.builder.appName("pagequarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def crawl(a: argparse.Namespace) -> None:
    """Sitemap files to URLs; with fetched pages, those of the queue are merged into the tables."""
    spark = _spark()
    seeds = spark.createDataFrame([(s, k) for k, s in enumerate(a.sitemap)], "sitemap_source string, sitemap_ord int")
    documents = None
    for s in a.sitemap:
        one = tables.read_sitemaps(spark, s).select(F.lit(s).alias("sitemap_source"), "xml")
        documents = one if documents is None else documents.unionByName(one)
    if a.listed:
        documents = documents.unionByName(tables.read_sitemaps(spark, a.listed).select(F.lit(a.listed).alias("sitemap_source"), "xml"))
    entries = discover.keep_first(discover.sitemap_entries(discover.expand_indexes(seeds, documents)))
    pages = tables.read(spark, a.tables, "crawler_pages")
    queue = discover.not_yet_crawled(entries, pages, a.recrawl, a.max_pages)
    if a.dry_run or not a.fetched:
        print(f"{entries.count()} URLs, {queue.count()} to crawl")
        for r in queue.orderBy("sitemap_ord", "pos").limit(10).collect():
            print(" ", r["url"], r["type_hint"] or "")
        return
    run = str(uuid.uuid4())
    fetched = tables.read_fetched(spark, a.fetched).withColumn("run_id", F.lit(run))
    key = discover.normalize_url(F.col("requested_url"))
    fetched = fetched.withColumn("normalized_url", key).join(queue.select("normalized_url"), "normalized_url", "left_semi").drop("normalized_url")
    start = F.current_timestamp()
    figures = ingest.ingest(spark, a.tables, fetched, hints=discover.hints_by_url(entries))
    created = spark.createDataFrame([(run, a.sitemap, a.max_pages, a.fetch_mode, entries.count())], "run_id string, seed_sitemaps array<string>, max_pages int, fetch_mode_default string, total_urls_discovered int")
    created = created.select("run_id", "seed_sitemaps", "max_pages", "fetch_mode_default", start.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), "total_urls_discovered", *[F.lit(0).alias(c) for c in ("total_pages_crawled", "total_redirects", "total_errors")], F.lit(None).cast("string").alias("notes"))
    finished = spark.createDataFrame([(run,)], "run_id string").withColumn("finished_at", F.current_timestamp())
    ingest.record_run(spark, a.tables, created, figures, finished)
    figures.show(truncate=False)


def research(a: argparse.Namespace) -> None:
    spark = _spark()
    get = lambda name: tables.read(spark, a.tables, name)
    projects, bridge = get("research_projects"), get("research_project_runs")
    if a.action == "create":
        top = projects.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = spark.createDataFrame([(top + 1, a.name, a.description, a.industry)], "id long, name string, description string, industry string").withColumn("created_at", F.current_timestamp())
        tables.replace(projects.unionByName(new), a.tables, "research_projects")
        print(top + 1)
        return
    if a.action == "list":
        reports.project_list(projects, bridge, get("crawl_runs")).show(1000, False)
        return
    named = projects.filter(F.col("name") == a.project).select(F.col("id").alias("project_id"))
    if a.action == "add-run":
        new = named.select("project_id", F.lit(a.run).alias("run_id"), F.lit(a.batch).cast("string").alias("batch_name"), F.lit(a.notes).cast("string").alias("notes"))
        tables.replace(bridge.unionByName(new), a.tables, "research_project_runs")
        return
    own = bridge.join(named, "project_id", "left_semi")
    if a.action == "show":
        rows = reports.project_runs(own, get("crawl_runs")).orderBy(F.desc("started_at"))
        rows.show(1000, False)
        reports.run_totals(rows).show()
    elif a.action == "domains":
        reports.domain_summary(reports.project_pages(get("crawler_pages"), own)).orderBy(F.desc("pages"), "domain").show(1000, False)
    else:
        rows = reports.latest(reports.project_pages(get("crawler_pages"), own, status=a.status, domain=a.domain), "last_crawled_at", a.limit, "final_url").select("id", "final_url", "domain", "crawl_status", "title", "word_count", "last_crawled_at")
        if a.export:
            tables.export_json(rows, a.export, single_array=True)
        else:
            rows.show(a.limit, False)


def fill(a: argparse.Namespace) -> None:
    spark = _spark()
    pages = tables.read(spark, a.tables, "crawler_pages")
    work = backfill.made_markdown if a.command == "backfill-markdown" else backfill.made_nav
    made = work(pages, a.url_pattern, a.force_all, a.limit)
    backfill.figures(made).show()
    if not a.dry_run:
        tables.update(spark, a.tables, "crawler_pages", made.select("final_url"), lambda stored, _: merge.patch(stored, made.drop("final_url"), "id"))


def clear_domain(a: argparse.Namespace) -> None:
    spark = _spark()
    for name in ("crawler_pages", "url_aliases"):
        stored = tables.read(spark, a.tables, name)
        hit = merge.url_holds("final_url", a.domain)
        print(name, merge.delete_like(stored, a.domain)[1].first()[0])
        tables.update(spark, a.tables, name, stored.filter(hit).select(tables.KEYS[name]), lambda part, _, hit=hit: part.filter(~hit))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequarry", description=__doc__)
    p.add_argument("--debug", action="store_true", help="Spark's own log from INFO on")
    p.add_argument("--tables", default="crawl-tables", help="folder of the crawl tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="sitemaps, queue and merge of fetched pages")
    c.add_argument("-s", "--sitemap", nargs="+", required=True)
    c.add_argument("--listed", help="further sitemap files that indexes name")
    c.add_argument("--fetched", help="what a fetcher wrote (Parquet or JSON lines)")
    c.add_argument("-m", "--max-pages", type=int, default=10_000)
    c.add_argument("-f", "--fetch-mode", default="cheerio", choices=["cheerio", "playwright"])
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--recrawl", action="store_true")
    c.set_defaults(work=crawl)
    r = sub.add_parser("research", help="projects and their runs")
    r.set_defaults(work=research)
    actions = r.add_subparsers(dest="action", required=True)
    actions.add_parser("list")
    for name in ("show", "pages", "domains", "add-run"):
        one = actions.add_parser(name)
        one.add_argument("project")
        if name == "pages":
            one.add_argument("-l", "--limit", type=int, default=50)
            one.add_argument("-s", "--status", choices=schemas.CRAWL_STATUSES)
            one.add_argument("-d", "--domain")
            one.add_argument("--export")
        if name == "add-run":
            one.add_argument("run")
            one.add_argument("-b", "--batch")
            one.add_argument("-n", "--notes")
    new = actions.add_parser("create")
    new.add_argument("name")
    new.add_argument("-d", "--description")
    new.add_argument("-i", "--industry")
    for name in ("backfill-markdown", "backfill-nav"):
        b = sub.add_parser(name)
        b.add_argument("--limit", type=int)
        b.add_argument("--url-pattern")
        b.add_argument("--dry-run", action="store_true")
        b.add_argument("--force-all", action="store_true")
        b.set_defaults(work=fill)
    d = sub.add_parser("clear-domain")
    d.add_argument("domain")
    d.set_defaults(work=clear_domain)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    _spark().sparkContext.setLogLevel("INFO" if a.debug else "WARN")
    a.work(a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
