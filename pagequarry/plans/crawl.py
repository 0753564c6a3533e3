"""Queries of discovery, lookups, upserts of runs and overrides, and functions on fixed texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import discover as D
from ..operators import merge as M
from ..runtime import read_table, ship_package
from ..sources import tables
from .markup import rows_sql
from .scalars import WS, _norm

NOW = "TIMESTAMP '2026-01-01 00:00:00'"
#: URLs of a sitemap file at most, by the sitemap protocol (fixed value).
PER_FILE = 50_000


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


# ---- sitemaps: the table of listed URLs written as files and parsed back


def _sitemap_files(spark, sf_dir):
    """sitemap_source, sitemap_ord, xml: the listed URLs as sitemap files, tracking parameters, case and all."""
    rows = _t(spark, sf_dir, "sitemap_urls").distinct().withColumn("part", F.floor(F.col("pos") / PER_FILE))
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<url>\n  <loc> "), escaped, F.lit(" </loc><priority>0.5</priority></url>"))
    listed = rows.groupBy("sitemap_source", "sitemap_ord", "part").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("entries"))
    return listed.select("sitemap_source", "sitemap_ord", F.concat(F.lit("<?xml version='1.0'?><urlset>"), F.array_join("entries.entry", "\n"), F.lit("</urlset>")).alias("xml"))


def sitemap_parse(spark, sf_dir):
    e = D.sitemap_entries(_sitemap_files(spark, sf_dir))
    return e.groupBy("url", "normalized_url", "sitemap_source", "type_hint", "sitemap_ord").agg(F.count("*").alias("n"))


def sitemap_keep_first(spark, sf_dir):
    """One entry per URL over all sitemaps, that of the first sitemap and place."""
    return D.keep_first(D.sitemap_entries(_sitemap_files(spark, sf_dir))).select("normalized_url", "sitemap_source", "sitemap_ord")


def _index_files(spark, sf_dir):
    """An index of all sitemaps of each host, and the sitemaps themselves."""
    files = _sitemap_files(spark, sf_dir).groupBy("sitemap_source").agg(F.min("xml").alias("xml"))
    site = files.withColumn("index", F.concat(F.regexp_extract("sitemap_source", r"^(https?://[^/]+)", 1), F.lit("/all-sitemaps-index.xml")))
    entry = F.concat(F.lit("<sitemap><loc>"), F.replace("sitemap_source", F.lit("&"), F.lit("&amp;")), F.lit("</loc></sitemap>"))
    index = site.groupBy("index").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</sitemapindex>")).alias("xml"))
    return index.select(F.col("index").alias("sitemap_source"), "xml"), files


def sitemap_index(spark, sf_dir):
    """What the indexes list, by place."""
    index, _ = _index_files(spark, sf_dir)
    return D.sitemap_index_entries(index.withColumn("sitemap_ord", F.lit(0))).select("sitemap_source", "entry", "entry_pos")


def sitemap_expand(spark, sf_dir):
    """Sitemaps opened from the indexes, as seeds of a crawl."""
    index, files = _index_files(spark, sf_dir)
    seeds = index.select("sitemap_source", F.lit(1).alias("sitemap_ord"))
    opened = D.expand_indexes(seeds, index.unionByName(files))
    return opened.select("sitemap_source", D.is_sitemap_index(F.col("xml")).alias("is_index"))


# ---- lookups and searches


def page_lookup(spark, sf_dir):
    return tables.lookup(_t(spark, sf_dir, "crawler_pages").select("id", "final_url"), "id", 7)


def pages_of_run(spark, sf_dir):
    """Pages of the run with the smallest id, in the order of their ids."""
    pages = _t(spark, sf_dir, "crawler_pages").select("id", "final_url", "run_id").distinct()
    return tables.by_run(pages, pages.agg(F.min("run_id")).first()[0])


def free_query(spark, sf_dir):
    """SQL with named parameters over a view."""
    _t(spark, sf_dir, "crawler_pages").select("id", "crawl_status", "word_count").distinct().createOrReplaceTempView("pages_of_free_query")
    return tables.run_query(spark, "select crawl_status, count(*) as n, sum(word_count) as words from pages_of_free_query where word_count >= :least group by crawl_status", least=100)


def url_policies(spark, sf_dir):
    """Listed URLs that a policy lets through: services and blog posts, no queries or fragments."""
    u = _t(spark, sf_dir, "sitemap_urls").select("url").distinct()
    return u.filter(U.matches_policy(F.col("url"), ["/services/", "/blog/"], [r"[?#]", r"/page/\d+"]))


def valid_urls(spark, sf_dir):
    u = _t(spark, sf_dir, "sitemap_urls").select("url").union(_t(spark, sf_dir, "url_aliases").select("requested_url")).distinct()
    return u.select("url", U.is_valid_url(F.col("url")).alias("valid"))


# ---- upserts of runs and overrides


def merge_runs(spark, sf_dir):
    """Runs with their figures counted from the pages, in two partial updates, and ended where pages came later."""
    runs = _t(spark, sf_dir, "crawl_runs").distinct()
    pages = _t(spark, sf_dir, "crawler_pages").select("id", "run_id", "crawl_status", "last_crawled_at").distinct().filter("run_id is not null")
    n = pages.groupBy("run_id").agg(F.count("*").cast("int").alias("pages"), F.count_if(F.col("crawl_status") == "ERROR").cast("int").alias("errors"), F.max("last_crawled_at").alias("finished_at"))
    none = F.lit(None).cast("int")
    first = n.select("run_id", F.lit(1).cast("long").alias("seq"), F.col("pages").alias("total_pages_crawled"), F.lit(-1).alias("total_errors"))
    second = n.select("run_id", F.lit(2).cast("long").alias("seq"), none.alias("total_pages_crawled"), F.col("errors").alias("total_errors"))
    return M.fold_runs(runs, first.unionByName(second), n.select("run_id", "finished_at")).select("run_id", "notes", "finished_at", "total_pages_crawled", "total_errors", "total_redirects")


def merge_overrides(spark, sf_dir):
    """Overrides with two later events for every other domain, the second without a word on being enabled."""
    stored = _t(spark, sf_dir, "domain_overrides").distinct()
    some = stored.filter("length(domain) % 2 = 0").drop("updated_at")
    first = some.withColumn("enabled", F.lit(False)).withColumn("notes", F.lit("off")).withColumn("seq", F.lit(1).cast("long"))
    second = some.withColumn("enabled", F.lit(None).cast("boolean")).withColumn("notes", F.lit("on")).withColumn("seq", F.lit(2).cast("long"))
    out = M.merge_overrides(stored, first.unionByName(second), F.expr(NOW))
    return out.select("domain", "enabled", "notes", "updated_at", F.array_join("main_content_selectors", ",").alias("main"), "force_fetch_mode")


# ---- functions


def whitespace_normalized(spark, sf_dir):
    p = _t(spark, sf_dir, "crawler_pages").select("id", "html_content").distinct()
    return p.select("id", F.md5(X.normalize_whitespace(F.col("html_content"))).alias("html"))


def heading_positions(spark, sf_dir):
    """Where the first level-1 heading of the stored Markdown stands, in percent of its lines."""
    p = _t(spark, sf_dir, "crawler_pages").select("id", "markdown").filter("markdown is not null").distinct()
    lines = F.split("markdown", "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: x.startswith("## ")), True).cast("int")
    return p.select("id", X.position_percent(at, F.size(lines)).alias("percent"))


_DATA = "A" * 60
#: (text, what strip_base64_images, postprocess_enhanced, normalize_headings, postprocess_markdown make of it)
TEXTS = [
    (f"a ![](data:image/png;base64,{_DATA}) b", "a  b", "a  b", f"a ![](data:image/png;base64,{_DATA}) b", "a  b"),
    (f"![Door](data:image/png;base64,{_DATA})", "![Door](data:image/png;base64,...)", "![Door](data:image/png;base64,...)", f"![Door](data:image/png;base64,{_DATA})", "![Door](data:image/png;base64,...)"),
    (f"![Cup](data:x/svg;base64,{_DATA}) ![](x;base64,{_DATA})", "![Cup](embedded-base64-removed) ", "![Cup](embedded-base64-removed)", f"![Cup](data:x/svg;base64,{_DATA}) ![](x;base64,{_DATA})", "![Cup](embedded-base64-removed)"),
    ("![s](data:image/png;base64,AAAA)", "![s](data:image/png;base64,AAAA)", "![s](data:image/png;base64,AAAA)", "![s](data:image/png;base64,AAAA)", "![s](data:image/png;base64,AAAA)"),
    ("x\n\n<!-- STRUCT:FAQ:START -->\n\nQ?\n\n\n\nA.\n\n<!-- STRUCT:FAQ:END -->\n", "x\n\n<!-- STRUCT:FAQ:START -->\n\nQ?\n\n\n\nA.\n\n<!-- STRUCT:FAQ:END -->\n", "x\n\n<!-- STRUCT:FAQ:START -->\nQ?\n\nA.\n<!-- STRUCT:FAQ:END -->", "x\n\n<!-- STRUCT:FAQ:START -->\n\nQ?\n\n\n\nA.\n\n<!-- STRUCT:FAQ:END -->\n", "x\n\n<!-- STRUCT:FAQ:START -->\n\nQ?\n\nA.\n\n<!-- STRUCT:FAQ:END -->"),
    ("# A\n### B\n#### C\n## D\n###### E", "# A\n### B\n#### C\n## D\n###### E", "# A\n### B\n#### C\n## D\n###### E", "# A\n## B\n### C\n## D\n### E", "# A\n## B\n### C\n## D\n### E"),
    ("### Deep\ntext\ntext\n\ntext\n# Top", "### Deep\ntext\ntext\n\ntext\n# Top", "### Deep\ntext\ntext\n\ntext\n# Top", "# Deep\ntext\ntext\n\ntext\n# Top", "# Deep\ntext\n\n# Top"),
    ("Home > Guides\n\n\n\n© 2024 Shop\nBody", "Home > Guides\n\n\n\n© 2024 Shop\nBody", "Home > Guides\n\n© 2024 Shop\nBody", "Home > Guides\n\n\n\n© 2024 Shop\nBody", "Body"),
]


def fixed_texts(spark, sf_dir):
    ship_package(spark)
    d = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(TEXTS)], "id int, t string")
    t = F.col("t")
    return d.select("id", X.strip_base64_images(t).alias("images"), X.postprocess_enhanced(t).alias("enhanced"), X.normalize_headings(t).alias("headings"), X.postprocess_markdown(t).alias("processed"))


#: (Markdown, page heading, the text with its heading, note on its place)
HEADED = [
    ("# A\n\ntext", "A", "# A\n\ntext", None),
    ("text\n\n# B\n\nmore", "A", "# A\n\ntext\n\n\nmore", "H1 at line 3 instead of line 1"),
    ("  ## C", " A ", "# A\n\n## C", None),
    ("", "A", "# A\n\n", None),
    ("# Other\ntext", "A", "# A\n\ntext", None),
]


def fixed_h1(spark, sf_dir):
    ship_package(spark)
    d = spark.createDataFrame([(k, m, h) for k, (m, h, *_) in enumerate(HEADED)], "id int, m string, h string")
    return d.select("id", X.ensure_h1(F.col("m"), F.col("h")).alias("text"), X.h1_issue(F.col("m")).alias("issue"))


def url_options(spark, sf_dir):
    """Policies of normalisation over the listed URLs: https enforced, slashes always or as given."""
    u = F.col("url")
    rows = _t(spark, sf_dir, "sitemap_urls").select("url").distinct()
    return rows.select("url", U.normalize_url_with(u, True).alias("https"), U.normalize_url_with(u, False, "always").alias("slashed"))


def fixed_resolved(spark, sf_dir):
    ship_package(spark)
    d = spark.createDataFrame([(r, b) for r, b, *_ in RESOLVED], "reference string, base string")
    r, b = F.col("reference"), F.col("base")
    return d.select("reference", "base", U.absolute_url(r, b).alias("absolute"), U.resolve_url(r, b).alias("resolved"))


#: (reference, base, made absolute, resolved and normalised)
RESOLVED = [
    ("../b/./c?z=1&a=2#f", "https://a.example/x/y/z", "https://a.example/x/b/c?z=1&a=2#f", "https://a.example/x/b/c?a=2&z=1"),
    ("/p/", "https://a.example/x", "https://a.example/p/", "https://a.example/p"),
    ("?q=1", "https://a.example/x/y", "https://a.example/x/y?q=1", "https://a.example/x/y?q=1"),
    ("https://b.example/?utm_source=m&k=1", "https://a.example/", "https://b.example/?utm_source=m&k=1", "https://b.example/?k=1"),
    ("c", "not a base", "c", None),
]

_NORM = _norm("url", "sitemap_urls")
_FIRST_ENTRY = "(select distinct on (norm) norm, sitemap_source, sitemap_ord from (select distinct * from sitemap_urls) join " + _NORM + " n using (url) where norm is not null order by norm, sitemap_ord, pos, sitemap_source, url)"
_HINT = "case when f like 'post-sitemap%' then 'post' when f like 'page-sitemap%' then 'page' when regexp_matches(f, '^(post_)?(category|tag|author)-sitemap') then 'pagination' when f like 'sitemap-posts%' then 'post' when f like 'sitemap-pages%' then 'page' when regexp_matches(f, '^sitemap-(categories|tags)') then 'pagination' when regexp_matches(f, 'blog|article|news') then 'post' when f like '%product%' then 'product' when f like '%event%' then 'event' when f like '%portfolio%' then 'portfolio' end"

QUERIES = {
    "sitemap_parse": (sitemap_parse, f"select s.url as url, norm as normalized_url, sitemap_source, {_HINT} as type_hint, sitemap_ord, count(*) as n from (select distinct *, lower(list_last(string_split(sitemap_source, '/'))) as f from sitemap_urls) s join " + _NORM + " n on n.url = s.url where norm is not null group by all"),
    "sitemap_keep_first": (sitemap_keep_first, f"select norm as normalized_url, sitemap_source, sitemap_ord from {_FIRST_ENTRY}"),
    "sitemap_index": (sitemap_index, "select regexp_extract(s, '^(https?://[^/]+)', 1) || '/all-sitemaps-index.xml' as sitemap_source, s as entry, cast(row_number() over (partition by regexp_extract(s, '^(https?://[^/]+)', 1) order by s) - 1 as integer) as entry_pos from (select distinct sitemap_source as s from sitemap_urls)"),
    "sitemap_expand": (sitemap_expand, "select distinct sitemap_source, false as is_index from sitemap_urls"),
    "page_lookup": (page_lookup, "select distinct id, final_url from crawler_pages where id = 7"),
    "pages_of_run": (pages_of_run, "select distinct id, final_url, run_id from crawler_pages where run_id = (select min(run_id) from crawler_pages)"),
    "free_query": (free_query, "select crawl_status, count(*) as n, cast(sum(word_count) as bigint) as words from (select distinct id, crawl_status, word_count from crawler_pages) where word_count >= 100 group by crawl_status"),
    "url_policies": (url_policies, r"select distinct url from sitemap_urls where regexp_matches(url, '/services/|/blog/') and not regexp_matches(url, '[?#]|/page/\d+')"),
    "valid_urls": (valid_urls, "select url, norm is not null as valid from (" + _norm("u", "(select url as u from sitemap_urls union select requested_url from url_aliases)")[1:-1] + ")"),
    "merge_runs": (merge_runs, "with n as (select run_id, count(*) as pages, count(*) filter (where crawl_status = 'ERROR') as errors, max(last_crawled_at) as finished_at from (select distinct id, run_id, crawl_status, last_crawled_at from crawler_pages where run_id is not null) group by run_id) select r.run_id as run_id, notes, coalesce(n.finished_at, r.finished_at) as finished_at, cast(coalesce(pages, total_pages_crawled) as integer) as total_pages_crawled, cast(coalesce(errors, total_errors) as integer) as total_errors, total_redirects from crawl_runs r left join n using (run_id)"),
    "merge_overrides": (merge_overrides, "select domain, case when length(domain) % 2 = 0 then true else enabled end as enabled, case when length(domain) % 2 = 0 then 'on' else notes end as notes, case when length(domain) % 2 = 0 then timestamptz '2026-01-01 00:00:00+00' else updated_at end as updated_at, array_to_string(main_content_selectors, ',') as main, force_fetch_mode from domain_overrides"),
    "whitespace_normalized": (whitespace_normalized, f"select distinct id, md5(regexp_replace(regexp_replace(regexp_replace(html_content, '{WS}+', ' ', 'g'), '>{WS}+<', '><', 'g'), '^{WS}+|{WS}+$', '', 'g')) as html from crawler_pages"),
    "heading_positions": (heading_positions, "select id, cast(floor(coalesce(list_position(list_transform(l, lambda x: x like '## %'), true), 0) * 100 / len(l) + 0.5) as integer) as percent from (select distinct id, string_split(markdown, chr(10)) as l from crawler_pages where markdown is not null)"),
    "fixed_texts": (fixed_texts, rows_sql("id integer, images varchar, enhanced varchar, headings varchar, processed varchar", [(k, *r[1:]) for k, r in enumerate(TEXTS)])),
    "fixed_h1": (fixed_h1, rows_sql("id integer, text varchar, issue varchar", [(k, *r[2:]) for k, r in enumerate(HEADED)])),
    "fixed_resolved": (fixed_resolved, rows_sql("reference varchar, base varchar, absolute varchar, resolved varchar", RESOLVED)),
    "url_options": (url_options, r"select url, regexp_replace(regexp_replace(norm, '^http:', 'https:'), '^(https://[^/?#]*?):80([/?#]|$)', '\1\2') as https, case when regexp_matches(regexp_extract(norm, '^https?://[^/?#]*([^?#]*)', 1), '/$|\.[^/]*$') then norm else regexp_replace(norm, '^(https?://[^?#]*)', '\1/') end as slashed from " + _NORM),
}
