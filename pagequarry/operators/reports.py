"""Reports over pages, runs, projects, languages and link structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nav_fingerprint
from ..functions.urls import raw_domain
from ..schemas import STATS_FIELDS


def project_list(projects: DataFrame, bridge: DataFrame, runs: DataFrame) -> DataFrame:
    """Projects with their number of runs and pages; a run linked twice counts its pages twice."""
    joined = projects.join(bridge.select(F.col("project_id").alias("id"), "run_id"), "id", "left").join(runs.select("run_id", "total_pages_crawled"), "run_id", "left")
    out = joined.groupBy("id", "name", "description", "industry", "created_at").agg(F.count_distinct("run_id").alias("runs"), F.sum("total_pages_crawled").alias("pages"))
    return out.orderBy(F.desc("created_at"), "id")


def project_runs(bridge: DataFrame, runs: DataFrame, project: int | None = None) -> DataFrame:
    links = bridge if project is None else bridge.filter(F.col("project_id") == project)
    return links.select("project_id", "run_id", "batch_name", F.col("notes").alias("link_notes")).join(runs, "run_id")


def run_totals(project_rows: DataFrame) -> DataFrame:
    return project_rows.groupBy("project_id").agg(F.count("*").alias("runs"), F.sum("total_pages_crawled").alias("pages"), F.sum("total_errors").alias("errors"))


def project_pages(pages: DataFrame, bridge: DataFrame, project: int | None = None, status: str | None = None, domain: str | None = None) -> DataFrame:
    """Pages of a project's runs; a run linked twice gives its pages twice. The bridge is joined by size, not by hint."""
    links = bridge if project is None else bridge.filter(F.col("project_id") == project)
    out = pages.join(links.select("project_id", "run_id"), "run_id")
    if status is not None:
        out = out.filter(F.col("crawl_status") == status)
    if domain is not None:
        out = out.filter(F.col("final_url").ilike(f"%{domain}%"))
    return out.withColumn("domain", raw_domain(F.col("final_url")))


def latest(df: DataFrame, time: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), tie).limit(n)


def domain_summary(pages: DataFrame) -> DataFrame:
    """Per domain: pages, good and failed ones, mean word count."""
    return pages.groupBy(raw_domain(F.col("final_url")).alias("domain")).agg(F.count("*").alias("pages"), F.count_if(F.col("crawl_status") == "OK").alias("ok"), F.count_if(F.col("crawl_status") == "ERROR").alias("errors"), F.avg("word_count").alias("avg_words"))


def status_summary(pages: DataFrame, *by: str) -> DataFrame:
    return pages.groupBy(*by, "crawl_status").agg(F.count("*").alias("pages"), F.avg("word_count").alias("avg_words"))


def daily_activity(pages: DataFrame, days: int = 30) -> DataFrame:
    return pages.groupBy(F.to_date("last_crawled_at").alias("day")).agg(F.count("*").alias("pages"), F.avg("word_count").alias("avg_words")).orderBy(F.desc("day")).limit(days)


def run_durations(runs: DataFrame) -> DataFrame:
    """Seconds and pages per second of finished runs; share of the discovered URLs that were crawled."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    done = runs.filter("finished_at is not null").withColumn("seconds", seconds.cast("long"))
    return done.select("run_id", "seconds", (F.col("total_pages_crawled") / F.nullif(F.col("seconds"), F.lit(0))).alias("pages_per_second"), (F.col("total_pages_crawled") / F.nullif(F.col("total_urls_discovered"), F.lit(0))).alias("success_rate"))


def long_chains(df: DataFrame, longer_than: int = 2) -> DataFrame:
    return df.filter(F.size("redirect_chain") > longer_than)


def clean_view(pages: DataFrame) -> DataFrame:
    return pages.filter("crawl_status = 'OK'").select("id", "final_url", "title", "h1", "meta_description", "markdown", "word_count", "content_hash", "sitemap_type_hint", "last_crawled_at", "run_id")


def crawl_quality(pages: DataFrame) -> DataFrame:
    """One row of totals over a crawl."""
    return pages.agg(
        F.count("*").alias("total"),
        F.count_distinct("final_url").alias("unique_urls"),
        F.count_if(F.size("redirect_chain") > 1).alias("redirects"),
        F.count_if(F.col("crawl_status") == "NOT_FOUND").alias("not_found"),
        F.count_if(F.col("crawl_status") == "SOFT_404").alias("soft_404"),
        F.count_if(F.col("crawl_status") == "ERROR").alias("errors"),
        F.avg(F.length("markdown")).alias("avg_markdown"),
    )


def with_structure(pages: DataFrame) -> DataFrame:
    """Pages processed, and those with any structural element."""
    return pages.agg(F.count_if(F.col("structural_stats").isNotNull()).alias("processed"), F.count_if(F.greatest(*[F.col(f"structural_stats.{f}") for f in STATS_FIELDS]) > 0).alias("with_structure"))


def nav_consensus(pages: DataFrame, site: Column, share: float = 0.6) -> DataFrame:
    """site, fingerprint, pages, page_id: the menu that at least `share` of a site's pages have, with its smallest page id.

    Only one can reach more than half. Fingerprints are counted, menus never shuffled.
    """
    marked = pages.filter("nav_structure.primary_nav is not null and size(nav_structure.primary_nav) > 0").select("id", site.alias("site"), nav_fingerprint(F.col("nav_structure.primary_nav")).alias("fingerprint")).distinct()
    counted = marked.groupBy("site", "fingerprint").agg(F.count("*").alias("pages"), F.min("id").alias("page_id"))
    totals = counted.groupBy("site").agg(F.sum("pages").alias("all_pages"))
    return counted.join(totals, "site").filter(F.col("pages") >= share * F.col("all_pages")).select("site", "fingerprint", "pages", "page_id")


def nav_deviations(pages: DataFrame, consensus: DataFrame, site: Column) -> DataFrame:
    """Per page of a site with a consensus: does its menu agree?"""
    marked = pages.filter("nav_structure.primary_nav is not null").select("id", site.alias("site"), nav_fingerprint(F.col("nav_structure.primary_nav")).alias("own")).distinct()
    return marked.join(consensus, "site").select("id", "site", (F.col("own") == F.col("fingerprint")).alias("agrees"))


# ---- languages and link structure. pages: id, crawl_id, url, title, language


def language_counts(pages: DataFrame, kind: str = "kind") -> DataFrame:
    return pages.groupBy("language").agg(F.count("*").alias("pages"), F.count_distinct(F.when(F.col(kind) == "page", F.col("id"))).alias("plain_pages"))


def majority_language(pages: DataFrame, group: str) -> DataFrame:
    """Per group the most frequent language (ties: alphabetical) and all languages in order."""
    counts = pages.groupBy(group, "language").agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max_by("language", F.struct("n", F.concat(F.lit("-"), F.translate("language", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")))).alias("primary_language"), F.sort_array(F.collect_set("language")).alias("languages"), F.sum("n").alias("pages"))


def classified(pages: DataFrame, classes: DataFrame, key: str = "id") -> DataFrame:
    """All pages with their class, null where none was given; a page of several classes has several rows."""
    return pages.join(classes, key, "left")


def cannibalisation(pages: DataFrame, subject: str) -> DataFrame:
    """Subjects that several pages of one language share: subject, language, pages, first and last page id.

    Groups instead of pairs: two pages of a group compete, and the group says so once.
    """
    return pages.filter(F.col(subject).isNotNull()).groupBy(subject, "language").agg(F.count_distinct("id").alias("pages"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("pages > 1")


def competing_pairs(pages: DataFrame, subject: str) -> DataFrame:
    """Neighbouring pairs within subject and language, in order of id: n pages give n - 1 pairs that chain the group."""
    ids = pages.filter(F.col(subject).isNotNull()).select(subject, "language", "id").distinct()
    w = Window.partitionBy(subject, "language").orderBy("id")
    return ids.withColumn("other_id", F.lead("id").over(w)).filter("other_id is not null").select(subject, "language", "id", "other_id")


def competing_details(pages: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """competing_pairs with columns of both pages (those of the second with the prefix other_). A chain has a row per
    page, so the details of a large group are joined once per page, not once per pair of its pages."""
    facts = pages.select("id", *columns).dropDuplicates(["id"])
    other = facts.select(F.col("id").alias("other_id"), *[F.col(c).alias(f"other_{c}") for c in columns])
    return competing_pairs(pages, subject).join(facts, "id").join(other, "other_id")


def links_within(links: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Links whose two ends are both pages of the set; the first `limit` by source and target."""
    ids = pages.select("final_url").distinct()
    if limit is not None:
        return links_within(links, pages).orderBy("source_url", "target_url").limit(limit)
    return links.join(ids.withColumnRenamed("final_url", "source_url"), "source_url", "left_semi").join(ids.withColumnRenamed("final_url", "target_url"), "target_url", "left_semi")


def silo_metrics(pages: DataFrame, links: DataFrame, silo: str) -> DataFrame:
    """Per silo: pages, pages without a link from another page, mean number of such links, share of pages that link to the
    silo's hub (its page of most incoming links, ties: smallest id). These formulas are this library's own."""
    own = pages.select("id", F.col("final_url").alias("target_url"), F.col(silo).alias("silo"))
    incoming = links.filter("source_url <> target_url").select("source_url", "target_url").distinct()
    counts = own.join(incoming.groupBy("target_url").agg(F.count("*").alias("inbound")), "target_url", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    per = counts.groupBy("silo").agg(F.count("*").alias("pages"), F.count_if(F.col("inbound") == 0).alias("orphans"), F.avg("inbound").alias("avg_inbound"), F.max_by("target_url", F.struct("inbound", -F.col("id"))).alias("hub"))
    toward = incoming.join(per.select(F.col("hub").alias("target_url"), "silo"), "target_url").join(own.select(F.col("target_url").alias("source_url"), "silo"), ["source_url", "silo"]).groupBy("silo").agg(F.count_distinct("source_url").alias("to_hub"))
    return per.join(toward, "silo", "left").select("silo", "pages", "orphans", "avg_inbound", "hub", (F.coalesce("to_hub", F.lit(0)) / F.col("pages")).alias("hub_support_ratio"))


def silo_counts(silos: DataFrame, assigned: DataFrame, pages: DataFrame, language: str) -> DataFrame:
    """Distinct pages per silo that are in the language or in none; silos without any keep 0."""
    known = assigned.join(pages.select(F.col("id").alias("page_id"), "language"), "page_id", "left").filter((F.col("language") == language) | F.col("language").isNull())
    return silos.join(known.groupBy("silo_id").agg(F.count_distinct("page_id").alias("n")), "silo_id", "left").select("silo_id", F.coalesce("n", F.lit(0)).alias("pages"))


def inherit_language(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """rows with language taken from source where source has one."""
    return rows.join(source.select(key, F.col("language").alias("from_source")), key, "left").withColumn("language", F.coalesce("from_source", "language")).drop("from_source")
