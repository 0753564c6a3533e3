"""From sitemaps to the URLs that remain to be crawled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..functions.urls import normalize_url, sitemap_type_hint

_LOC = r"(?s)<(?:\w+:)?url\b.*?<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"
_INDEX_LOC = r"(?s)<sitemap>.*?<loc>(.*?)</loc>.*?</sitemap>"


def is_sitemap_index(xml):
    return F.coalesce(xml.contains("<sitemapindex"), F.lit(False))


def sitemap_index_entries(sitemaps: DataFrame) -> DataFrame:
    """sitemap_source, sitemap_ord, entry, entry_pos for sitemaps(sitemap_source, sitemap_ord, xml) that are indexes."""
    found = sitemaps.filter(is_sitemap_index(F.col("xml")))
    rows = found.select("sitemap_source", "sitemap_ord", F.posexplode(F.regexp_extract_all("xml", F.lit(_INDEX_LOC), 1)).alias("entry_pos", "entry"))
    return rows.withColumn("entry", js_trim(F.col("entry"))).filter("entry <> ''")


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """url, normalized_url, sitemap_source, type_hint, sitemap_ord, pos of all URLs that sitemaps list; invalid ones left out."""
    text = F.regexp_replace(F.regexp_replace(F.col("entry"), r"<!\[CDATA\[|\]\]>", ""), "&amp;", "&")
    rows = sitemaps.filter(~is_sitemap_index(F.col("xml"))).select("sitemap_source", "sitemap_ord", F.posexplode(F.regexp_extract_all("xml", F.lit(_LOC), 1)).alias("pos", "entry"))
    rows = rows.select(text.alias("url"), "sitemap_source", "sitemap_ord", "pos")
    return rows.select("url", normalize_url(F.col("url")).alias("normalized_url"), "sitemap_source", sitemap_type_hint(F.col("sitemap_source")).alias("type_hint"), "sitemap_ord", "pos").filter("normalized_url is not null")


def expand_indexes(seeds: DataFrame, documents: DataFrame) -> DataFrame:
    """sitemap_source, sitemap_ord, xml to read for seeds(sitemap_source, sitemap_ord): indexes give way to their entries,
    one level deep; sitemaps without a document (sitemap_source, xml) are skipped."""
    own = seeds.join(documents, "sitemap_source")
    listed = sitemap_index_entries(own)
    opened = listed.join(documents.withColumnRenamed("sitemap_source", "entry"), "entry").select(F.col("entry").alias("sitemap_source"), "sitemap_ord", F.col("entry_pos").alias("sub"), "xml")
    plain = own.filter(~is_sitemap_index(F.col("xml"))).select("sitemap_source", "sitemap_ord", F.lit(-1).alias("sub"), "xml")
    # an index's entries take its place in the order
    return plain.unionByName(opened).withColumn("sitemap_ord", F.col("sitemap_ord") * 100_000 + F.col("sub") + 1).drop("sub")


def keep_first(entries: DataFrame) -> DataFrame:
    """The first entry of each normalised URL, in the order of sitemaps and places. Null URLs are left out.

    An aggregate, not a window: partial results leave each task, so an URL listed everywhere is no hot spot.
    """
    row = F.struct(*[c for c in entries.columns if c != "normalized_url"])
    first = entries.filter("normalized_url is not null").groupBy("normalized_url").agg(F.min_by(row, F.struct("sitemap_ord", "pos", "sitemap_source", "url")).alias("r"))
    return first.select("normalized_url", "r.*").select(*entries.columns)


def not_yet_crawled(entries: DataFrame, pages: DataFrame, recrawl: bool = False, max_pages: int | None = None) -> DataFrame:
    """Entries to crawl: those without a page, whatever that page's state; all with recrawl; the first max_pages of them."""
    out = entries if recrawl else entries.join(pages.select(F.col("final_url").alias("normalized_url")).distinct(), "normalized_url", "left_anti")
    return out.orderBy("sitemap_ord", "pos", "normalized_url").limit(max_pages) if max_pages is not None else out


def already_crawled(entries: DataFrame, pages: DataFrame) -> DataFrame:
    return entries.join(pages.select(F.col("final_url").alias("normalized_url")), "normalized_url", "left_semi")


def hints_by_url(entries: DataFrame) -> DataFrame:
    """normalized_url, hint: the hint given last."""
    return entries.filter("normalized_url is not null").groupBy("normalized_url").agg(F.max_by(F.struct("type_hint"), F.struct("sitemap_ord", "pos", "sitemap_source", "url"))["type_hint"].alias("hint"))


def corrected_hints(requests: DataFrame, hints: DataFrame) -> DataFrame:
    """requests(…, final_url, requested_url, type_hint) with hint: a redirected page takes the hint of the URL it led to, if that has one."""
    joined = requests.join(hints.withColumnRenamed("normalized_url", "final_url"), "final_url", "left")
    redirected = ~F.coalesce(normalize_url(F.col("requested_url")) == F.col("final_url"), F.lit(False))
    own = F.col("type_hint")
    return joined.withColumn("hint", F.when(redirected & F.col("hint").isNotNull() & ~F.col("hint").eqNullSafe(own), F.col("hint")).otherwise(own))


def counters(entries: DataFrame, pages: DataFrame, aliases: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: discovered, skipped, queued, redirects, errors."""
    discovered = entries.agg(F.count("*").alias("discovered"))
    skipped = already_crawled(entries, pages).agg(F.count("*").alias("skipped"))
    return discovered.crossJoin(skipped).crossJoin(aliases.agg(F.count("*").alias("redirects"))).crossJoin(errors.agg(F.count("*").alias("errors"))).withColumn("queued", F.col("discovered") - F.col("skipped"))


def hint_histogram(entries: DataFrame, samples: int = 3) -> DataFrame:
    """hint, n, pct, samples: how many URLs each hint has, with the alphabetically first URLs."""
    total = entries.agg(F.count("*").alias("total"))
    named = entries.withColumn("hint", F.coalesce("type_hint", F.lit("(none)")))
    ranked = named.select("hint", "url").distinct().withColumn("r", F.row_number().over(Window.partitionBy("hint").orderBy("url"))).filter(F.col("r") <= samples)
    few = ranked.groupBy("hint").agg(F.sort_array(F.collect_list("url")).alias("samples"))
    counted = named.groupBy("hint").agg(F.count("*").alias("n")).join(few, "hint").crossJoin(total)
    return counted.select("hint", "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("pct"), "samples")
