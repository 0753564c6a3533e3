"""Queries of the page stage over whole tables."""

from __future__ import annotations

from html.entities import codepoint2name

from pyspark.sql import functions as F

from ..operators import backfill, ingest, merge
from ..operators.pages import parse_pages, render_markdown
from ..runtime import materialize, read_once, read_table
from .scalars import _norm


def _html(spark, sf_dir):
    """Pages with their source, each once. Ids are told apart before the sources are read."""
    return read_once(spark, sf_dir, "crawler_pages", "id", "id", "final_url", "html_content").filter("html_content is not null")


def _parsed(spark, sf_dir, *parts):
    return parse_pages(_html(spark, sf_dir), parts=parts)


def page_metadata(spark, sf_dir):
    return _parsed(spark, sf_dir, "metadata").select("id", "metadata.*", "h1_count")


def page_language_tags(spark, sf_dir):
    return _parsed(spark, sf_dir, "metadata").select("id", "metadata.language", "h1_count")


def page_headings(spark, sf_dir):
    """Number of headings with text per page and level."""
    return _parsed(spark, sf_dir, "metadata").select("id", F.explode("headings").alias("h")).groupBy("id", "h.level").agg(F.count("*").alias("n"))


def page_links(spark, sf_dir):
    return _parsed(spark, sf_dir, "links").select("id", F.explode("links.href").alias("href")).distinct()


def page_link_places(spark, sf_dir):
    return _parsed(spark, sf_dir, "links").select("id", F.posexplode("links").alias("pos", "l")).select("id", "pos", "l.*")


def structural_elements(spark, sf_dir):
    return _parsed(spark, sf_dir, "structure").select("id", F.posexplode("elements").alias("pos", "e")).select("id", "pos", "e.type", "e.start_index", "e.end_index", "e.selector", "e.question_count", "e.link_count", "e.has_button")


def page_nav_items(spark, sf_dir):
    """Items of all four menus."""
    menus = ("primary_nav", "footer_nav", "utility_header", "language_switcher")
    n = _parsed(spark, sf_dir, "nav").select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("list_name"), F.col(f"nav_structure.{m}").alias("l")) for m in menus])).alias("m"))
    return n.select("id", "m.list_name", F.posexplode("m.l").alias("pos", "i")).select("id", "list_name", "pos", "i.url", "i.label", "i.depth", "i.is_external")


def page_nav_counts(spark, sf_dir):
    n = F.col("nav_structure")
    return _parsed(spark, sf_dir, "nav").select("id", *[F.size(n[c]).alias(c) for c in ("primary_nav", "footer_nav", "utility_header", "language_switcher", "breadcrumb", "content_links")], n["extraction_meta"]["clusters_found"].alias("clusters"))


def page_content_links(spark, sf_dir):
    n = _parsed(spark, sf_dir, "nav").select("id", F.col("nav_structure.content_links").alias("l"))
    return n.select("id", F.explode("l").alias("i")).select("id", "i.*")


def page_content(spark, sf_dir):
    pages = read_once(spark, sf_dir, "crawler_pages", "id", "id", "final_url", "html_content")
    o = read_table(spark, sf_dir, "domain_overrides")
    return parse_pages(pages, overrides=o, parts=("content",)).select("id", "extraction_method", "word_count", F.round("junk_score", 6).alias("junk_score"), F.md5("clean_html").alias("content"))


def page_markdown(spark, sf_dir):
    m = _parsed(spark, sf_dir, "markdown")
    return m.select("id", "markdown", "markdown_enhanced", "structural_stats.*")


def page_head(spark, sf_dir):
    return _parsed(spark, sf_dir, "head").select("id", F.explode("meta").alias("name", "content")).distinct()


def rendered_markdown(spark, sf_dir):
    p = read_once(spark, sf_dir, "crawler_pages", "id", "id", "final_url", "clean_html", "h1").filter("clean_html is not null")
    return render_markdown(p, "clean_html", "final_url", "h1")


def crawl_ingest(spark, sf_dir):
    """The stored sources as a fresh crawl: located, parsed and merged onto nothing. Rows delivered twice are events
    repeated, which change nothing, so no page is shuffled before it is parsed."""
    p = read_table(spark, sf_dir, "crawler_pages")
    fetched = p.select(F.coalesce("requested_url_original", "final_url").alias("requested_url"), F.col("final_url").alias("loaded_url"), "status_code", F.col("html_content").alias("body"), "redirect_chain", F.col("sitemap_type_hint").alias("type_hint"), F.col("id").alias("seq"), F.col("last_error").alias("error"), F.col("last_crawled_at").alias("fetched_at"), "run_id")
    events = materialize(ingest.page_events(fetched, overrides=read_table(spark, sf_dir, "domain_overrides")), "crawl-ingest")
    merged = merge.merge_pages(p.limit(0), events, F.expr("TIMESTAMP '2026-01-01 00:00:00'"))
    return merged.groupBy("crawl_status").agg(F.count("*").alias("pages"), F.count("redirect_chain").alias("with_chain"))


def backfill_markdown(spark, sf_dir):
    p = read_once(spark, sf_dir, "crawler_pages", "id", "id", "final_url", "h1", "clean_html", "markdown", "markdown_enhanced", "structural_stats")
    out, _ = backfill.backfill_markdown(p)
    return out.agg(F.count("*").alias("pages"), F.count("markdown_enhanced").alias("enhanced"))


def backfill_nav(spark, sf_dir):
    p = read_once(spark, sf_dir, "crawler_pages", "id", "id", "final_url", "html_content", "nav_structure")
    out, _ = backfill.backfill_nav(p)
    return out.agg(F.count("*").alias("pages"), F.count("nav_structure").alias("with_nav"))


_DISTINCT = "(select distinct id, html_content from crawler_pages where html_content is not null)"

_TAG = r"""<(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""


def _decoded(x: str) -> str:
    latin = [(f"&{name};", chr(c)) for c, name in codepoint2name.items() if 192 <= c < 256] + [(f"&#{c};", chr(c)) for c in range(192, 256)]
    for entity, char in (*latin, ("&#x27;", "''"), ("&#39;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


_METADATA = f"""with r as (select id, nullif({_decoded("regexp_extract(html_content, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') as title,
 nullif({_decoded(f"regexp_replace(regexp_extract(html_content, '(?is)<h1(?:[ ][^>]*)?>(.*?)</h1>', 1), '{_TAG}', '', 'g')")}, '') as h1,
 nullif({_decoded("regexp_extract(html_content, '(?i)<meta name=.description. content=.([^>]*?).>', 1)")}, '') as meta_description, nullif(regexp_extract(html_content, '(?i)<html[^>]*[ ]lang="([^"]*)"', 1), '') as language, cast(len(regexp_extract_all(html_content, '(?i)<h1[ >]')) as integer) as h1_count from {_DISTINCT})
select id, coalesce(title, h1) as title, h1[1:500] as h1, meta_description, cast(null as varchar) as canonical_url, cast(null as varchar) as og_image, language, h1_count from r"""

QUERIES = {
    "page_metadata": (page_metadata, _METADATA),
    "page_language_tags": (page_language_tags, rf"""select id, nullif(regexp_extract(html_content, '(?i)<html[^>]*\slang="([^"]*)"', 1), '') as language, cast(len(regexp_extract_all(html_content, '(?i)<h1[ >]')) as integer) as h1_count from {_DISTINCT}"""),
    "page_headings": (page_headings, r"""select id, level, count(*) as n from (select id, cast(l as integer) as level, unnest(regexp_extract_all(html_content, '(?is)<h' || l || '(?:\s[^>]*)?>(.*?)</h' || l || '>', 1)) as inner_html from (select distinct id, html_content from crawler_pages where html_content is not null), (select unnest(range(1, 7)) as l)) where regexp_matches(regexp_replace(inner_html, '<[^>]*>', '', 'g'), '[^\s]') group by id, level"""),
    "page_links": (page_links, rf"""select distinct id, replace(coalesce(nullif(regexp_extract(a, '(?i)\shref="([^"]*)"', 1), ''), regexp_extract(a, '(?i)\shref=''([^'']*)''', 1)), '&amp;', '&') as href from (select id, unnest(regexp_extract_all(html_content, '(?i)<a\s[^>]*')) as a from {_DISTINCT}) where regexp_matches(a, '(?i)\shref=')"""),
    "page_link_places": (page_link_places, None),
    "structural_elements": (structural_elements, None),
    "page_nav_items": (page_nav_items, None),
    "page_nav_counts": (page_nav_counts, None),
    "page_content_links": (page_content_links, None),
    "page_content": (page_content, None),
    "page_markdown": (page_markdown, None),
    "page_head": (page_head, r"""select distinct id, lower(regexp_extract(m, '(?i)name="([^"]*)"', 1)) as name, replace(replace(replace(regexp_extract(m, '(?i)content="([^"]*)"', 1), '&#x27;', ''''), '&quot;', '"'), '&amp;', '&') as content from (select id, unnest(regexp_extract_all(html_content, '(?i)<meta name="[^"]*" content="[^"]*">')) as m from (select distinct id, html_content from crawler_pages where html_content is not null))"""),
    "rendered_markdown": (rendered_markdown, None),
    "crawl_ingest": (
        crawl_ingest,
        "with p as (select distinct on (id) * from crawler_pages order by id), e as (select id, coalesce(f.norm, final_url) as u, case when last_error is not null then 'ERROR' when status_code in (404, 410) then 'NOT_FOUND' when status_code >= 400 then 'ERROR' else 'OK' end as s, "
        "last_error is null and (coalesce(len(redirect_chain), 0) > 0 or case when requested_url_original is null then false else coalesce(q.norm, requested_url_original) <> coalesce(f.norm, final_url) end) as c from p left join " + _norm("final_url", "crawler_pages") + " f on f.url = final_url left join " + _norm("requested_url_original", "crawler_pages") + " q on q.url = requested_url_original), "
        "l as (select u, arg_max(s, id) as crawl_status, arg_max(c, id) as c from e group by u) select crawl_status, count(*) as pages, count(*) filter (where c) as with_chain from l group by crawl_status",
    ),
    "backfill_markdown": (backfill_markdown, "select count(*) as pages, count(*) filter (where markdown_enhanced is not null or (clean_html is not null and clean_html <> '')) as enhanced from (select distinct on (id) * from crawler_pages order by id)"),
    "backfill_nav": (backfill_nav, "select count(*) as pages, count(*) filter (where nav_structure is not null or (html_content is not null and html_content <> '')) as with_nav from (select distinct on (id) * from crawler_pages order by id)"),
}
