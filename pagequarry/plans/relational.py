"""Queries of discovery, upserts and reports over the crawl tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import discover as D
from ..operators import merge as M
from ..operators import reports as R
from ..runtime import read_table
from .scalars import _norm

NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


# ---- discovery


def dedup_keep_first(spark, sf_dir):
    return D.keep_first(_t(spark, sf_dir, "sitemap_urls"))


def anti_join_skip(spark, sf_dir):
    entries = D.keep_first(_t(spark, sf_dir, "sitemap_urls"))
    return D.not_yet_crawled(entries, _t(spark, sf_dir, "crawler_pages")).select("normalized_url", "sitemap_source", "type_hint")


def crawl_queue(spark, sf_dir):
    """The first 100 URLs of a second crawl: those without a good page, in the order of sitemaps and places."""
    entries = D.keep_first(_t(spark, sf_dir, "sitemap_urls"))
    return D.not_yet_crawled(entries, _t(spark, sf_dir, "crawler_pages").filter("crawl_status = 'OK'"), max_pages=100).select("normalized_url", "sitemap_ord", "pos")


def already_crawled(spark, sf_dir):
    return D.already_crawled(D.keep_first(_t(spark, sf_dir, "sitemap_urls")), _t(spark, sf_dir, "crawler_pages")).select("normalized_url")


def hint_override(spark, sf_dir):
    pages = _t(spark, sf_dir, "crawler_pages").select("id", F.col("requested_url_original").alias("requested_url"), "final_url", F.col("sitemap_type_hint").alias("type_hint")).distinct()
    return D.corrected_hints(pages, D.hints_by_url(_t(spark, sf_dir, "sitemap_urls"))).select("id", "hint")


def hint_histogram(spark, sf_dir):
    return D.hint_histogram(_t(spark, sf_dir, "sitemap_urls")).select("hint", "n", "pct", F.array_join("samples", " ").alias("samples"))


def crawl_counters(spark, sf_dir):
    entries, pages = D.keep_first(_t(spark, sf_dir, "sitemap_urls")), _t(spark, sf_dir, "crawler_pages")
    return D.counters(entries, pages, _t(spark, sf_dir, "url_aliases").distinct(), pages.filter("last_error is not null").select("id").distinct())


def domain_override_lookup(spark, sf_dir):
    """Pages of domains with an enabled override, and its selectors."""
    o = _t(spark, sf_dir, "domain_overrides").filter("enabled").select("domain", F.array_join("main_content_selectors", ",").alias("main"), F.array_join("remove_selectors", ",").alias("removed"))
    pages = _t(spark, sf_dir, "crawler_pages").select("id", U.domain(F.col("final_url")).alias("domain")).distinct()
    return pages.join(o, "domain", "left").select("id", "domain", "main", "removed")


# ---- upserts: pages crawled in 2024 or without a time are stored, later ones come as events in order of time


def _events(spark, sf_dir):
    from pyspark.sql import Window

    p = _t(spark, sf_dir, "crawler_pages").dropDuplicates(["id"])
    late = F.coalesce(F.col("last_crawled_at") >= F.lit("2025-01-01").cast("timestamp"), F.lit(False))
    stored = p.filter(~late)
    # one stored row per URL: that of the smallest id
    keep = stored.groupBy("final_url").agg(F.min("id").alias("id"))
    stored = stored.join(keep.select("id"), "id", "left_semi")
    events = p.filter(late).withColumn("seq", F.row_number().over(Window.partitionBy("final_url").orderBy("last_crawled_at", "id")).cast("long"))
    return stored, events.drop("id", "last_crawled_at")


_MERGED = ("final_url", "requested_url_original", "status_code", "crawl_status", "title", "h1", "word_count", "content_hash", "run_id", "last_error", "meta_description", "extraction_method", "fetch_mode", "sitemap_type_hint")


def merge_pages(spark, sf_dir):
    stored, events = _events(spark, sf_dir)
    merged = M.merge_pages(stored, events, F.expr(NOW))
    return _merged(merged)


def _merged(merged):
    contents = [F.md5(c).alias(a) for c, a in (("html_content", "html"), ("clean_html", "clean"), ("markdown", "markdown"), ("markdown_enhanced", "enhanced"))]
    return merged.select(*_MERGED, *contents, F.coalesce(F.size("redirect_chain"), F.lit(-1)).alias("hops"), F.coalesce(F.size("nav_structure.footer_nav"), F.lit(-1)).alias("footer_links"), F.col("structural_stats.faq_modules").alias("faq_modules"), F.round(F.col("junk_score").cast("double"), 4).alias("junk_score"))


def merge_pages_gated(spark, sf_dir):
    """Markdown changes only together with the HTML."""
    stored, events = _events(spark, sf_dir)
    return _merged(M.merge_pages(stored, events, F.expr(NOW), "hash_gated"))


def merge_pages_ids(spark, sf_dir):
    """Stored ids stay, new pages are numbered without gaps after the largest."""
    stored, events = _events(spark, sf_dir)
    merged = M.merge_pages(stored, events, F.expr(NOW))
    return merged.agg(F.count("*").alias("pages"), F.count_distinct("id").alias("ids"), (F.max("id") - F.lit(0)).alias("largest"))


def merge_aliases(spark, sf_dir):
    from pyspark.sql import Window

    a = _t(spark, sf_dir, "url_aliases").distinct()
    a = a.withColumn("seq", (F.row_number().over(Window.partitionBy("requested_url").orderBy("last_seen_at", "first_seen_at", "final_url", "run_id")) - 2).cast("long"))
    stored = a.filter("seq < 0").drop("seq")
    return M.merge_aliases(stored, a.filter("seq >= 0"), F.expr(NOW)).select("requested_url", "final_url", "status_code", "run_id", "first_seen_at", "last_seen_at")


def delete_domain(spark, sf_dir):
    pages = _t(spark, sf_dir, "crawler_pages").select("id", "final_url").distinct()
    kept, deleted = M.delete_like(pages, "dental")
    return kept.agg(F.count("*").alias("kept")).crossJoin(deleted)


# ---- reports


def research_list(spark, sf_dir):
    return R.project_list(_t(spark, sf_dir, "research_projects"), _t(spark, sf_dir, "research_project_runs"), _t(spark, sf_dir, "crawl_runs"))


def research_show(spark, sf_dir):
    return R.project_runs(_t(spark, sf_dir, "research_project_runs"), _t(spark, sf_dir, "crawl_runs")).select("project_id", "run_id", "batch_name", "link_notes", "started_at", "finished_at", "total_pages_crawled", "total_errors")


def research_totals(spark, sf_dir):
    return R.run_totals(R.project_runs(_t(spark, sf_dir, "research_project_runs"), _t(spark, sf_dir, "crawl_runs")))


def research_pages(spark, sf_dir):
    pages = _t(spark, sf_dir, "crawler_pages").select("id", "final_url", "crawl_status", "title", "word_count", "run_id", "last_crawled_at")
    return R.project_pages(pages, _t(spark, sf_dir, "research_project_runs"), status="OK").select("project_id", "id", "domain", "title", "word_count")


def research_pages_top(spark, sf_dir):
    pages = _t(spark, sf_dir, "crawler_pages").select("id", "final_url", "crawl_status", "run_id", "last_crawled_at").distinct()
    bridge = _t(spark, sf_dir, "research_project_runs").select("project_id", "run_id").distinct()
    return R.latest(R.project_pages(pages, bridge, domain="pets"), "last_crawled_at", 50, "id").select("project_id", "id", "final_url", "last_crawled_at").groupBy("id", "final_url", "last_crawled_at").agg(F.count("*").alias("n")).orderBy(F.desc("last_crawled_at"), "id").limit(20).select("id", "final_url", "last_crawled_at")


def research_domains(spark, sf_dir):
    pages = R.project_pages(_t(spark, sf_dir, "crawler_pages").select("final_url", "crawl_status", "word_count", "run_id"), _t(spark, sf_dir, "research_project_runs"))
    return R.domain_summary(pages)


def domain_summary(spark, sf_dir):
    return R.domain_summary(_t(spark, sf_dir, "crawler_pages"))


def status_summary(spark, sf_dir):
    return R.status_summary(_t(spark, sf_dir, "crawler_pages"))


def run_status_summary(spark, sf_dir):
    return R.status_summary(_t(spark, sf_dir, "crawler_pages"), "run_id")


def daily_activity(spark, sf_dir):
    return R.daily_activity(_t(spark, sf_dir, "crawler_pages"))


def run_duration(spark, sf_dir):
    d = R.run_durations(_t(spark, sf_dir, "crawl_runs"))
    return d.select("run_id", "seconds", F.round("pages_per_second", 6).alias("pages_per_second"), F.round("success_rate", 6).alias("success_rate"))


def latest_run(spark, sf_dir):
    return R.latest(_t(spark, sf_dir, "crawl_runs"), "started_at", 10, "run_id").select("run_id", "started_at")


def long_redirect_chains(spark, sf_dir):
    return R.long_chains(_t(spark, sf_dir, "crawler_pages")).select("id", F.size("redirect_chain").alias("hops")).distinct()


def pages_clean(spark, sf_dir):
    return R.clean_view(_t(spark, sf_dir, "crawler_pages")).distinct()


def paged_export(spark, sf_dir):
    """Third batch of hundred pages in the order of ids."""
    return _t(spark, sf_dir, "crawler_pages").select("id", "final_url").distinct().orderBy("id").offset(200).limit(100)


def url_search(spark, sf_dir):
    """Pages of one status and run whose URL holds a text, by optional predicates."""
    from ..sources.tables import select_pages

    return select_pages(_t(spark, sf_dir, "crawler_pages"), url_part="services", status="OK", pending="markdown_enhanced").select("id", "final_url").distinct()


def crawl_qa(spark, sf_dir):
    return R.crawl_quality(_t(spark, sf_dir, "crawler_pages").dropDuplicates(["id"]))


def with_structure(spark, sf_dir):
    return R.with_structure(_t(spark, sf_dir, "crawler_pages"))


_SITE = U.raw_domain


def nav_consensus(spark, sf_dir):
    return R.nav_consensus(_t(spark, sf_dir, "crawler_pages"), _SITE(F.col("final_url")), share=0.5)


def nav_consensus_default(spark, sf_dir):
    return R.nav_consensus(_t(spark, sf_dir, "crawler_pages"), _SITE(F.col("final_url")))


def nav_deviations(spark, sf_dir):
    pages = _t(spark, sf_dir, "crawler_pages")
    site = _SITE(F.col("final_url"))
    return R.nav_deviations(pages, R.nav_consensus(pages, site, share=0.5), site)


def _language_pages(spark, sf_dir):
    u = F.col("final_url")
    return _t(spark, sf_dir, "crawler_pages").select("id", "final_url", U.url_language(u).alias("language"), U.page_kind(u).alias("kind"), "h1", _SITE(u).alias("site"), F.col("sitemap_type_hint").alias("silo")).distinct()


def language_counts(spark, sf_dir):
    return R.language_counts(_language_pages(spark, sf_dir))


def majority_language(spark, sf_dir):
    return R.majority_language(_language_pages(spark, sf_dir), "site").select("site", "primary_language", F.array_join("languages", ",").alias("languages"), "pages")


def cannibalisation(spark, sf_dir):
    return R.cannibalisation(_language_pages(spark, sf_dir), "h1")


def competing_pairs(spark, sf_dir):
    return R.competing_pairs(_language_pages(spark, sf_dir), "h1")


def classified_pages(spark, sf_dir):
    """Pages of each language with the class of their folder, where they have one."""
    pages = _language_pages(spark, sf_dir).select("id", "language")
    classes = _language_pages(spark, sf_dir).filter("kind <> 'page'").select("id", F.col("kind").alias("page_class"))
    return R.classified(pages, classes)


def _links(spark, sf_dir):
    p = _t(spark, sf_dir, "crawler_pages").select("final_url", "nav_structure")
    rows = p.select(F.col("final_url").alias("source_url"), F.explode("nav_structure.content_links").alias("l")).filter("l is not null")
    more = _t(spark, sf_dir, "url_aliases").select(F.col("requested_url").alias("source_url"), F.col("final_url").alias("target_url"))
    return rows.select("source_url", F.col("l.url").alias("target_url")).unionByName(more).distinct()


def link_mesh(spark, sf_dir):
    """The first 500 links among the pages of the set."""
    return R.links_within(_links(spark, sf_dir), _t(spark, sf_dir, "crawler_pages"), 500)


def competing_details(spark, sf_dir):
    """Competing pages with what tells them apart."""
    p = _t(spark, sf_dir, "crawler_pages").select("id", "final_url", U.url_language(F.col("final_url")).alias("language"), "h1", "title", "word_count")
    return R.competing_details(p, "h1", ["final_url", "title", "word_count"])


def same_set_links(spark, sf_dir):
    return R.links_within(_links(spark, sf_dir), _t(spark, sf_dir, "crawler_pages"))


def silo_metrics(spark, sf_dir):
    m = R.silo_metrics(_language_pages(spark, sf_dir), _links(spark, sf_dir), "silo")
    return m.filter("silo is not null").select("silo", "pages", "orphans", F.round("avg_inbound", 6).alias("avg_inbound"), "hub", F.round("hub_support_ratio", 6).alias("hub_support_ratio"))


def silo_counts(spark, sf_dir):
    pages = _language_pages(spark, sf_dir)
    assigned = pages.select(F.col("id").alias("page_id"), F.col("silo").alias("silo_id")).distinct()
    silos = _t(spark, sf_dir, "sitemap_urls").select(F.col("type_hint").alias("silo_id")).filter("silo_id is not null").distinct()
    return R.silo_counts(silos, assigned, pages, "es")


def inherited_language(spark, sf_dir):
    """Documents take the language of the site's majority where their own label is missing."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"), F.col("lang").alias("language"))
    major = R.majority_language(_language_pages(spark, sf_dir).withColumn("site", F.lower("site")), "site").select("site", F.col("primary_language").alias("language"))
    return R.inherit_language(docs, major, "site").select("doc_id", "language")


def _lang_case(u: str) -> str:
    return "case " + " ".join(f"when {u} like '%/{c}/%' then '{c}'" for c in ("es", "fr", "de", "it", "pt", "ja", "zh")) + " else 'en' end"


_LANGPAGES = f"lp as (select distinct id, final_url, {_lang_case('final_url')} as language, case when lower(final_url) like '%/blog/%' then 'blog' when lower(final_url) like '%/product/%' then 'product' when lower(final_url) like '%/category/%' then 'category' when regexp_matches(final_url, '^https?://[^/]+/?$') then 'homepage' else 'page' end as kind, h1, split_part(split_part(final_url, '://', 2), '/', 1) as site, sitemap_type_hint as silo from crawler_pages)"
_LINKS = "lk as (select distinct final_url as source_url, l.url as target_url from (select final_url, unnest(nav_structure.content_links) as l from crawler_pages) where l is not null union select requested_url, final_url from url_aliases)"
_DOMAIN = "split_part(split_part(final_url, '://', 2), '/', 1)"
_FIRST = "(select distinct on (normalized_url) * from sitemap_urls where normalized_url is not null order by normalized_url, sitemap_ord, pos, sitemap_source, url)"
_FINGER = "substr(md5(coalesce(array_to_string(list_sort(list_transform(list_filter(nav_structure.primary_nav, lambda x: x is not null and not x.is_external), lambda x: x.url)), '|'), '')), 1, 16)"
_CONSENSUS = f"f as (select distinct id, {_DOMAIN} as site, {_FINGER} as fingerprint from crawler_pages where nav_structure.primary_nav is not null and len(nav_structure.primary_nav) > 0), c as (select site, fingerprint, count(*) as pages, min(id) as page_id from f group by site, fingerprint), g as (select c.* from c join (select site, sum(pages) as all_pages from c group by site) t using (site) where pages >= 0.5 * all_pages)"

def _merge_sql(gated: bool) -> str:
    falsy = {"status_code": "case when status_code <> 0 then status_code end", "word_count": "coalesce(word_count, 0)", "junk_score": "case when junk_score <> 0 then junk_score end", **{c: f"nullif({c}, '')" for c in ("title", "h1", "content_hash", "run_id", "last_error", "html_content", "clean_html", "markdown", "markdown_enhanced", "meta_description", "extraction_method", "sitemap_type_hint")}}
    columns = ("requested_url_original", "status_code", "crawl_status", "title", "h1", "word_count", "content_hash", "run_id", "last_error", "html_content", "clean_html", "markdown", "markdown_enhanced", "meta_description", "extraction_method", "fetch_mode", "sitemap_type_hint", "redirect_chain", "nav_structure", "structural_stats", "junk_score")
    last = lambda c: f"first({c} order by seq desc)"
    known = lambda c: f"first({c} order by seq desc) filter (where {c} is not null)"
    change = lambda c: f"list({c} order by seq desc) filter (where changes)[1]"
    text = change if gated else known
    out = {
        "requested_url_original": "max(requested_url_original) filter (where n = 1)", "status_code": last("status_code"), "crawl_status": last("crawl_status"), "word_count": last("word_count"), "run_id": last("run_id"), "last_error": last("last_error"), "fetch_mode": last("fetch_mode"), "hops": f"cast(coalesce(len({last('redirect_chain')}), -1) as integer)",
        **{c: known(c) for c in ("title", "h1", "content_hash", "meta_description", "extraction_method", "sitemap_type_hint")}, "junk_score": f"round(cast({known('junk_score')} as double), 4)",
        "html": f"md5({change('html_content')})", "clean": f"md5({change('clean_html')})", "markdown": f"md5({text('markdown')})", "enhanced": f"md5({text('markdown_enhanced')})",
        "footer_links": f"cast(coalesce(len(({text('nav_structure')}).footer_nav), -1) as integer)", "faq_modules": f"({text('structural_stats')}).faq_modules",
    }
    return f"""with p as (select distinct on (id) * from crawler_pages order by id), s as (select * from p where not coalesce(last_crawled_at >= timestamptz '2025-01-01 00:00:00+00', false)),
s1 as (select * from s where id in (select min(id) from s group by final_url)),
e as (select *, row_number() over (partition by final_url order by last_crawled_at, id) as seq from p where coalesce(last_crawled_at >= timestamptz '2025-01-01 00:00:00+00', false)),
b as (select final_url, -1 as seq, {", ".join(columns)} from s1 union all select final_url, seq, {", ".join(f"{falsy[c]} as {c}" if c in falsy else c for c in columns)} from e),
w as (select *, row_number() over (partition by final_url order by seq) as n, last_value(content_hash ignore nulls) over (partition by final_url order by seq rows between unbounded preceding and 1 preceding) as prev from b),
c as (select *, n = 1 or (content_hash is not null and content_hash <> coalesce(prev, '')) as changes from w)
select final_url, {", ".join(f"{v} as {k}" for k, v in out.items())} from c group by final_url"""


QUERIES = {
    "dedup_keep_first": (dedup_keep_first, f"select * from {_FIRST}"),
    "anti_join_skip": (anti_join_skip, f"select normalized_url, sitemap_source, type_hint from {_FIRST} f where not exists (select 1 from crawler_pages p where p.final_url = f.normalized_url)"),
    "crawl_queue": (crawl_queue, f"select normalized_url, sitemap_ord, pos from {_FIRST} f where not exists (select 1 from crawler_pages p where p.final_url = f.normalized_url and p.crawl_status = 'OK') order by sitemap_ord, pos, normalized_url limit 100"),
    "already_crawled": (already_crawled, f"select normalized_url from {_FIRST} f where exists (select 1 from crawler_pages p where p.final_url = f.normalized_url)"),
    "hint_override": (hint_override, "with h as (select distinct on (normalized_url) normalized_url, type_hint as hint from sitemap_urls where normalized_url is not null order by normalized_url, sitemap_ord desc, pos desc, sitemap_source desc, url desc) select id, case when not coalesce(n.norm = final_url, false) and hint is not null and hint is distinct from sitemap_type_hint then hint else sitemap_type_hint end as hint from (select distinct id, final_url, requested_url_original, sitemap_type_hint from crawler_pages) p left join h on h.normalized_url = final_url left join " + _norm("requested_url_original", "crawler_pages") + " n on n.url = requested_url_original"),
    "hint_histogram": (hint_histogram, "select hint, n, round(n * 100 / (select count(*) from sitemap_urls), 2) as pct, array_to_string(list_sort(samples)[1:3], ' ') as samples from (select coalesce(type_hint, '(none)') as hint, count(*) as n, list(distinct url) as samples from sitemap_urls group by 1)"),
    "crawl_counters": (crawl_counters, f"select discovered, skipped, redirects, errors, discovered - skipped as queued from (select (select count(*) from {_FIRST}) as discovered, (select count(*) from {_FIRST} f where exists (select 1 from crawler_pages p where p.final_url = f.normalized_url)) as skipped, (select count(*) from (select distinct * from url_aliases)) as redirects, (select count(distinct id) from crawler_pages where last_error is not null) as errors)"),
    "domain_override_lookup": (domain_override_lookup, "select id, d.domain as domain, array_to_string(main_content_selectors, ',') as main, array_to_string(remove_selectors, ',') as removed from (select distinct id, regexp_extract(norm, '^https?://([^:/?#]*)', 1) as domain from crawler_pages join " + _norm("final_url", "crawler_pages") + " n on n.url = final_url) d left join domain_overrides o on o.domain = d.domain and o.enabled"),
    "merge_pages": (merge_pages, _merge_sql(False)),
    "merge_pages_gated": (merge_pages_gated, _merge_sql(True)),
    "merge_pages_ids": (merge_pages_ids, "with p as (select distinct on (id) * from crawler_pages order by id), s as (select min(id) as id, final_url from p where not coalesce(last_crawled_at >= timestamptz '2025-01-01 00:00:00+00', false) group by final_url), u as (select count(distinct final_url) as n from p), k as (select max(id) as top, count(*) as n from s) select u.n as pages, u.n as ids, k.top + u.n - k.n as largest from u, k"),
    "merge_aliases": (merge_aliases, "with a as (select *, row_number() over (partition by requested_url order by last_seen_at nulls first, first_seen_at nulls first, final_url nulls first, run_id nulls first) as n, count(*) over (partition by requested_url) as c from (select distinct * from url_aliases)) select requested_url, final_url, status_code, run_id, case when c = 1 then first_seen_at else (select min(first_seen_at) from a b where b.requested_url = a.requested_url and n = 1) end as first_seen_at, case when c = 1 then last_seen_at else timestamptz '2026-01-01 00:00:00+00' end as last_seen_at from a where n = c"),
    "delete_domain": (delete_domain, "select count(*) filter (where not coalesce(final_url ilike '%dental%', false)) as kept, count(*) filter (where coalesce(final_url ilike '%dental%', false)) as deleted from (select distinct id, final_url from crawler_pages)"),
    "research_list": (research_list, "select p.id as id, name, description, industry, created_at, count(distinct b.run_id) as runs, cast(sum(total_pages_crawled) as bigint) as pages from research_projects p left join research_project_runs b on b.project_id = p.id left join crawl_runs r on r.run_id = b.run_id group by all"),
    "research_show": (research_show, "select project_id, b.run_id as run_id, batch_name, b.notes as link_notes, started_at, finished_at, total_pages_crawled, total_errors from research_project_runs b join crawl_runs r on r.run_id = b.run_id"),
    "research_totals": (research_totals, "select project_id, count(*) as runs, cast(sum(total_pages_crawled) as bigint) as pages, cast(sum(total_errors) as bigint) as errors from research_project_runs b join crawl_runs r on r.run_id = b.run_id group by project_id"),
    "research_pages": (research_pages, f"select project_id, id, {_DOMAIN} as domain, title, word_count from crawler_pages p join research_project_runs b on b.run_id = p.run_id where crawl_status = 'OK'"),
    "research_pages_top": (research_pages_top, "select distinct id, final_url, last_crawled_at from (select p.id, p.final_url, p.last_crawled_at from (select distinct id, final_url, crawl_status, run_id, last_crawled_at from crawler_pages) p join (select distinct project_id, run_id from research_project_runs) b on b.run_id = p.run_id where final_url ilike '%pets%' order by last_crawled_at desc nulls last, id limit 50) order by last_crawled_at desc nulls last, id limit 20"),
    "research_domains": (research_domains, f"select {_DOMAIN} as domain, count(*) as pages, count(*) filter (where crawl_status = 'OK') as ok, count(*) filter (where crawl_status = 'ERROR') as errors, avg(word_count) as avg_words from crawler_pages p join research_project_runs b on b.run_id = p.run_id group by 1"),
    "domain_summary": (domain_summary, f"select {_DOMAIN} as domain, count(*) as pages, count(*) filter (where crawl_status = 'OK') as ok, count(*) filter (where crawl_status = 'ERROR') as errors, avg(word_count) as avg_words from crawler_pages group by 1"),
    "status_summary": (status_summary, "select crawl_status, count(*) as pages, avg(word_count) as avg_words from crawler_pages group by 1"),
    "run_status_summary": (run_status_summary, "select run_id, crawl_status, count(*) as pages, avg(word_count) as avg_words from crawler_pages group by 1, 2"),
    "daily_activity": (daily_activity, "select cast(last_crawled_at as date) as day, count(*) as pages, avg(word_count) as avg_words from crawler_pages group by 1 order by 1 desc nulls last limit 30"),
    "run_duration": (run_duration, "select run_id, s as seconds, round(total_pages_crawled / nullif(s, 0), 6) as pages_per_second, round(total_pages_crawled / nullif(total_urls_discovered, 0), 6) as success_rate from (select *, cast(trunc(epoch(finished_at - started_at)) as bigint) as s from crawl_runs where finished_at is not null)"),
    "latest_run": (latest_run, "select run_id, started_at from crawl_runs order by started_at desc nulls last, run_id limit 10"),
    "long_redirect_chains": (long_redirect_chains, "select distinct id, cast(len(redirect_chain) as integer) as hops from crawler_pages where len(redirect_chain) > 2"),
    "pages_clean": (pages_clean, "select distinct id, final_url, title, h1, meta_description, markdown, word_count, content_hash, sitemap_type_hint, last_crawled_at, run_id from crawler_pages where crawl_status = 'OK'"),
    "paged_export": (paged_export, "select distinct id, final_url from crawler_pages order by id limit 100 offset 200"),
    "url_search": (url_search, "select distinct id, final_url from crawler_pages where final_url like '%services%' and crawl_status = 'OK' and markdown_enhanced is null"),
    "crawl_qa": (crawl_qa, "select count(*) as total, count(distinct final_url) as unique_urls, count(*) filter (where len(redirect_chain) > 1) as redirects, count(*) filter (where crawl_status = 'NOT_FOUND') as not_found, count(*) filter (where crawl_status = 'SOFT_404') as soft_404, count(*) filter (where crawl_status = 'ERROR') as errors, avg(length(markdown)) as avg_markdown from (select distinct on (id) * from crawler_pages order by id)"),
    "with_structure": (with_structure, "select count(structural_stats) as processed, count(*) filter (where greatest(structural_stats.faq_modules, structural_stats.toc_sections, structural_stats.breadcrumbs, structural_stats.template_ctas, structural_stats.accordions, structural_stats.testimonials, structural_stats.author_bios, structural_stats.related_posts) > 0) as with_structure from crawler_pages"),
    "nav_consensus": (nav_consensus, f"with {_CONSENSUS} select site, fingerprint, pages, page_id from g"),
    "nav_consensus_default": (nav_consensus_default, f"with {_CONSENSUS.replace('0.5', '0.6')} select site, fingerprint, pages, page_id from g"),
    "nav_deviations": (nav_deviations, f"with {_CONSENSUS}, o as (select distinct id, {_DOMAIN} as site, {_FINGER} as own from crawler_pages where nav_structure.primary_nav is not null) select id, o.site as site, own = fingerprint as agrees from o join g using (site)"),
    "language_counts": (language_counts, f"with {_LANGPAGES} select language, count(*) as pages, count(distinct case when kind = 'page' then id end) as plain_pages from lp group by language"),
    "majority_language": (majority_language, f"with {_LANGPAGES}, n as (select site, language, count(*) as n from lp group by 1, 2) select site, first(language order by n desc, language) as primary_language, array_to_string(list_sort(list(language)), ',') as languages, cast(sum(n) as bigint) as pages from n group by site"),
    "classified_pages": (classified_pages, f"with {_LANGPAGES} select id, language, nullif(kind, 'page') as page_class from lp"),
    "cannibalisation": (cannibalisation, f"with {_LANGPAGES} select h1, language, count(distinct id) as pages, min(id) as first_id, max(id) as last_id from lp where h1 is not null group by 1, 2 having count(distinct id) > 1"),
    "competing_pairs": (competing_pairs, f"with {_LANGPAGES}, i as (select distinct h1, language, id from lp where h1 is not null) select h1, language, id, other_id from (select *, lead(id) over (partition by h1, language order by id) as other_id from i) where other_id is not null"),
    "link_mesh": (link_mesh, f"with {_LINKS} select source_url, target_url from lk where source_url in (select final_url from crawler_pages) and target_url in (select final_url from crawler_pages) order by source_url, target_url limit 500"),
    "competing_details": (competing_details, f"with {_LANGPAGES}, i as (select distinct h1, language, id from lp where h1 is not null), c as (select * from (select *, lead(id) over (partition by h1, language order by id) as other_id from i) where other_id is not null), f as (select distinct on (id) id, final_url, title, word_count from crawler_pages order by id) select c.h1 as h1, c.language as language, c.id as id, other_id, a.final_url as final_url, a.title as title, a.word_count as word_count, b.final_url as other_final_url, b.title as other_title, b.word_count as other_word_count from c join f a on a.id = c.id join f b on b.id = other_id"),
    "same_set_links": (same_set_links, f"with {_LINKS} select source_url, target_url from lk where source_url in (select final_url from crawler_pages) and target_url in (select final_url from crawler_pages)"),
    "silo_metrics": (
        silo_metrics,
        f"with {_LANGPAGES}, {_LINKS}, o as (select distinct id, final_url, silo from lp), k as (select * from lk where source_url <> target_url), i as (select target_url, count(*) as inbound from k group by 1), q as (select id, final_url, silo, coalesce(inbound, 0) as inbound from o left join i on target_url = final_url), "
        "h as (select silo, count(*) as pages, count(*) filter (where inbound = 0) as orphans, round(avg(inbound), 6) as avg_inbound, first(final_url order by inbound desc, id) as hub from q where silo is not null group by silo), "
        "t as (select h.silo as silo, count(distinct k.source_url) as n from h join k on k.target_url = h.hub join o on o.final_url = k.source_url and o.silo = h.silo group by h.silo) "
        "select h.silo as silo, pages, orphans, avg_inbound, hub, round(coalesce(n, 0) / pages, 6) as hub_support_ratio from h left join t using (silo)",
    ),
    "silo_counts": (silo_counts, f"with {_LANGPAGES} select s.silo_id as silo_id, coalesce(n, 0) as pages from (select distinct type_hint as silo_id from sitemap_urls where type_hint is not null) s left join (select silo, count(distinct id) as n from lp where language = 'es' or language is null group by silo) c on c.silo = s.silo_id"),
    "inherited_language": (inherited_language, f"with {_LANGPAGES}, n as (select lower(site) as site, language, count(*) as n from lp group by 1, 2), m as (select site, first(language order by n desc, language) as major from n group by site) select doc_id, coalesce(major, lang) as language from documents left join m on m.site = source"),
}
