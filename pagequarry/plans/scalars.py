"""Queries of the URL and text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import links as L
from ..runtime import read_table

WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRACKING = ", ".join(f"'{p}'" for p in U.TRACKING_PARAMETERS)

#: Macros put in front of oracle texts: URL identity of the URLs that occur in the tables.
NORMALIZED = rf"""(select u as url, case when u is null or trim(u) = '' then null else scheme || '://' || case when scheme = 'https' then regexp_replace(place, ':443$', '') else regexp_replace(place, ':80$', '') end
 || case when path <> '/' then regexp_replace(path, '/$', '') else path end || case when q <> '' then '?' || q else '' end end as norm
from (select u, lower(regexp_extract(t, '^([^:]+):', 1)) as scheme, lower(regexp_extract(t, '^[^:]+://([^/?#]*)', 1)) as place,
  case when regexp_extract(t, '^[^:]+://[^/?#]*(/[^?#]*)', 1) = '' then '/' else regexp_extract(t, '^[^:]+://[^/?#]*(/[^?#]*)', 1) end as path,
  array_to_string(list_transform(list_sort(list_filter(string_split(regexp_extract(t, '\?([^#]*)', 1), '&'), lambda p: p <> '' and not list_contains([{TRACKING}], split_part(p, '=', 1)))), lambda p: case when contains(p, '=') then p else p || '=' end), '&') as q
  from (select u, case when regexp_matches(trim(u), '^(?i:https?)://') then trim(u) else 'https://' || trim(u) end as t from (select distinct {{column}} as u from {{table}}))))"""


def _norm(column: str, table: str) -> str:
    return NORMALIZED.replace("{column}", column).replace("{table}", table)


def normalize_url(spark, sf_dir):
    return read_table(spark, sf_dir, "sitemap_urls").select("url").distinct().select("url", U.normalize_url(F.col("url")).alias("norm"))


def extract_domain(spark, sf_dir):
    return read_table(spark, sf_dir, "crawler_pages").select("final_url").distinct().select("final_url", U.domain(F.col("final_url")).alias("domain"), U.raw_domain(F.col("final_url")).alias("raw_domain"))


def url_facts(spark, sf_dir):
    u = F.col("final_url")
    return read_table(spark, sf_dir, "crawler_pages").select("final_url").distinct().select("final_url", U.url_path(u).alias("path"), U.url_depth(u).alias("depth"), U.page_kind(u).alias("kind"), U.url_language(u).alias("language"), U.url_hash(u).alias("hash"), U.is_sitemap_url(u).alias("is_sitemap"))


def type_hint(spark, sf_dir):
    return read_table(spark, sf_dir, "sitemap_urls").select("sitemap_source").distinct().select("sitemap_source", U.sitemap_type_hint(F.col("sitemap_source")).alias("hint"))


def url_equivalence(spark, sf_dir):
    """Aliases that name their page only in another spelling."""
    a = read_table(spark, sf_dir, "url_aliases").select("requested_url", "final_url").distinct()
    return a.select("requested_url", "final_url", U.same_url(F.col("requested_url"), F.col("final_url")).alias("same"))


def resolve_links(spark, sf_dir):
    """All links in the stored Markdown, made absolute and normalised."""
    pages = read_table(spark, sf_dir, "crawler_pages").select("id", "final_url", "markdown").dropDuplicates(["id"])
    found = pages.select("final_url", F.explode(F.regexp_extract_all("markdown", F.lit(r"\]\(([^()\s]+)\)"), 1)).alias("href")).distinct()
    return found.select("final_url", "href", U.resolve_url(F.col("href"), F.col("final_url")).alias("target"))


def link_facts(spark, sf_dir):
    """Are the links of stored menus, all four of them, external or utilities?"""
    menus = F.concat(*[F.coalesce(F.col(f"nav_structure.{m}.url"), F.array()) for m in ("primary_nav", "footer_nav", "utility_header", "language_switcher")])
    p = read_table(spark, sf_dir, "crawler_pages").select("final_url", F.explode(F.array_distinct(menus)).alias("url")).filter("url is not null").distinct()
    return p.select("final_url", "url", U.is_external_link(F.col("url"), F.col("final_url")).alias("external"), U.is_utility_link(F.col("url")).alias("utility"))


def page_language(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages").filter("html_content is not null").select("id", U.page_language(F.col("final_url"), F.col("html_content")).alias("language"))
    return p.distinct()


def crawl_status(spark, sf_dir):
    return read_table(spark, sf_dir, "crawler_pages").select("id", "status_code", X.crawl_status(F.col("status_code")).alias("status")).distinct()


def soft_404(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages")
    return p.filter(X.soft_404(F.col("title"), F.col("markdown"), X.word_count(F.col("clean_html")))).select("id").distinct()


def derived_flags(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages")
    return p.select(
        "id",
        U.was_redirected(F.col("requested_url_original"), F.col("final_url")).alias("redirected"),
        X.has_text(F.col("h1")).alias("has_h1"),
        X.fetch_state(F.col("status_code"), F.col("html_content")).alias("fetch_state"),
        X.is_indexable(F.col("status_code"), F.col("html_content")).alias("indexable"),
    ).distinct()


def content_hash(spark, sf_dir):
    """Pages whose stored hash is not that of their clean HTML."""
    p = read_table(spark, sf_dir, "crawler_pages").select("id", "content_hash", X.content_hash(F.col("clean_html")).alias("hash")).distinct()
    return p.select("id", "hash", X.hashes_match(F.col("content_hash"), F.col("hash")).alias("matches"))


def nav_fingerprint(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages").filter("nav_structure.primary_nav is not null")
    return p.select("id", X.nav_fingerprint(F.col("nav_structure.primary_nav")).alias("fingerprint")).distinct()


def word_counts(spark, sf_dir):
    return read_table(spark, sf_dir, "crawler_pages").select("id", X.word_count(F.col("clean_html")).cast("long").alias("words")).distinct()


def title_h1_patterns(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages").filter("html_content is not null")
    pick = lambda r: F.nullif(X.js_trim(F.regexp_extract("html_content", r, 1)), F.lit(""))
    return p.select("id", pick(r"(?is)<title[^>]*>([^<]*)</title>").alias("title"), pick(r"(?is)<h1[^>]*>([^<]*)</h1>").alias("plain_h1"), pick(r"""(?i)<html[^>]*\slang="([^"]*)""").alias("lang"), pick(r"""(?i)<meta name="description" content="([^"]*)""").alias("description"), (F.size(F.regexp_extract_all("html_content", F.lit(r"(?i)<h1[ >]"), 0)) > 1).alias("many_h1")).distinct()


def _markdown(spark, sf_dir):
    return read_table(spark, sf_dir, "crawler_pages").select("id", "markdown").filter("markdown is not null").distinct()


def dedup_lines(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", X.deduplicate_lines(F.col("markdown")).alias("text"))


def remove_boilerplate(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", X.remove_boilerplate(F.col("markdown")).alias("text"))


def normalize_headings(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", X.normalize_headings(F.col("markdown")).alias("text"))


def shift_headings(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", X.shift_headings(F.col("markdown")).alias("text"))


def h1_in_markdown(spark, sf_dir):
    h = X.first_h1(F.col("markdown"))
    return _markdown(spark, sf_dir).select("id", h["has_h1"].alias("has_h1"), h["position"].alias("position"), h["text"].alias("text"))


def ensure_h1(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages").select("id", "markdown", "h1").filter("markdown is not null and h1 <> ''").distinct()
    return p.select("id", X.ensure_h1(F.col("markdown"), F.col("h1")).alias("text"), X.h1_issue(F.col("markdown")).alias("issue"))


def postprocess_markdown(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", X.postprocess_markdown(F.col("markdown")).alias("text"))


def markdown_to_text(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", X.markdown_to_text(F.col("markdown")).alias("text"))


def strip_markers(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages").select("id", "markdown_enhanced").filter("markdown_enhanced is not null").distinct()
    return p.select("id", X.strip_markers(F.col("markdown_enhanced")).alias("text"))


def links_with_context(spark, sf_dir):
    p = read_table(spark, sf_dir, "crawler_pages").select("id", "markdown_enhanced").distinct()
    return L.links_with_context(p, "id", "markdown_enhanced")


def heading_outline(spark, sf_dir):
    """Headings of the stored Markdown by level, then place."""
    return L.headings(_markdown(spark, sf_dir), "id", "markdown")


_HREFS = r"select distinct final_url, unnest(regexp_extract_all(markdown, '\]\(([^()\s]+)\)', 1)) as href from crawler_pages"
_MD = "(select distinct id, markdown from crawler_pages where markdown is not null)"
_TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"

_H = r"^(#{1,6})\s+([^\r\n]+)\r?$"


def _lines(relation: str) -> str:
    """id, i, line of the texts t of a relation(id, t)."""
    return f"(select id, lines[i] as line, i from (select id, lines, unnest(range(1, len(lines) + 1)) as i from (select id, string_split(t, chr(10)) as lines from {relation})))"


def _deduplicated(relation: str) -> str:
    return f"(select id, coalesce(array_to_string(list(line order by i) filter (t = '' or t is distinct from prev), chr(10)), '') as t from (select *, last_value(nullif(t, '') ignore nulls) over (partition by id order by i rows between unbounded preceding and 1 preceding) as prev from (select id, i, line, {_TRIM('line')} as t from {_lines(relation)})) group by id)"


def _normalized(relation: str) -> str:
    """The k-th heading's level is at most k, and at most that of any heading before it plus the headings since."""
    marked = f"select id, i, line, regexp_matches(line, '{_H}') as h, length(regexp_extract(line, '{_H}', 1)) as level, regexp_extract(line, '{_H}', 2) as x from {_lines(relation)}"
    placed = f"select *, least(k, k + min(case when h then level - k end) over (partition by id order by i)) as now from (select *, sum(case when h then 1 else 0 end) over (partition by id order by i) as k from ({marked}))"
    return f"(select id, array_to_string(list(case when h then repeat('#', cast(now as integer)) || ' ' || x else line end order by i), chr(10)) as t from ({placed}) group by id)"


def _without_boilerplate(relation: str) -> str:
    return rf"(select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^Home\s*>\s*.+$', '', 'g'), '(?m)^Posted on .+ by .+$', '', 'g'), '(?m)^©\s*\d{{4}}.+$', '', 'g'), '(?mi)^Copyright\s+©\s+\d{{4}}.+$', '', 'g'), '(?mi)^Last updated:?\s*.+$', '', 'g') as t from {relation})"


_IMAGES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[\]\(data:image/\w+;base64,[A-Za-z0-9+/=]{50,}\)', '', 'g'), '!\[([^\]]+)\]\(data:image/(\w+);base64,[A-Za-z0-9+/=]{50,}\)', '![\1](data:image/\2;base64,...)', 'g'), '!\[\]\([^)]*;base64,[A-Za-z0-9+/=]{50,}\)', '', 'g'), '!\[([^\]]+)\]\([^)]*;base64,[A-Za-z0-9+/=]{50,}\)', '![\1](embedded-base64-removed)', 'g')"
_PLAIN = "(select id, markdown as t from " + _MD + ")"
_COLLAPSED = r"(select id, regexp_replace(markdown, '\n{3,}', chr(10) || chr(10), 'g') as t from " + _MD + ")"
_ENSURED = rf"""with p as (select distinct id, markdown, h1 from crawler_pages where markdown is not null and h1 <> ''), l as (select id, h1, {_TRIM('markdown')} as m, string_split({_TRIM('markdown')}, chr(10)) as lines from p),
a as (select *, coalesce((select min(i) from (select unnest(range(1, len(lines) + 1)) as i) where regexp_matches({_TRIM('lines[i]')}, '^#\s+.+')), 0) as place from l)
select id, case when place = 1 and {_TRIM(f"regexp_replace({_TRIM('lines[1]')}, '^#\\s+', '')")} = {_TRIM('h1')} then m else '# ' || {_TRIM('h1')} || chr(10) || chr(10) || {_TRIM("array_to_string(case when place = 0 then lines else list_concat(lines[1:place - 1], lines[place + 1:]) end, chr(10))")} end as text, case when place > 1 then 'H1 at line ' || place || ' instead of line 1' end as issue from a"""

QUERIES = {
    "normalize_url": (normalize_url, "select url, norm from " + _norm("url", "sitemap_urls")),
    "extract_domain": (extract_domain, "select final_url, regexp_extract(norm, '^https?://([^:/?#]*)', 1) as domain, split_part(split_part(final_url, '://', 2), '/', 1) as raw_domain from (select distinct final_url from crawler_pages) join " + _norm("final_url", "crawler_pages") + " n on n.url = final_url"),
    "url_facts": (
        url_facts,
        "select final_url, regexp_extract(norm, '^https?://[^/?#]*(/[^?#]*)', 1) as path, cast(len(list_filter(string_split(regexp_extract(norm, '^https?://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '')) as integer) as depth, case when lower(final_url) like '%/blog/%' then 'blog' when lower(final_url) like '%/product/%' then 'product' when lower(final_url) like '%/category/%' then 'category' when regexp_extract(norm, '^https?://[^/?#]*(/[^?#]*)', 1) = '/' then 'homepage' else 'page' end as kind, "
        "case when final_url like '%/es/%' then 'es' when final_url like '%/fr/%' then 'fr' when final_url like '%/de/%' then 'de' when final_url like '%/it/%' then 'it' when final_url like '%/pt/%' then 'pt' when final_url like '%/ja/%' then 'ja' when final_url like '%/zh/%' then 'zh' else 'en' end as language, md5(regexp_replace(lower(trim(final_url)), '/$', '')) as hash, norm is not null and (lower(final_url) like '%.xml' or lower(final_url) like '%sitemap%') as is_sitemap "
        "from (select distinct final_url from crawler_pages) join " + _norm("final_url", "crawler_pages") + " n on n.url = final_url",
    ),
    "type_hint": (type_hint, "select sitemap_source, case when f like 'post-sitemap%' then 'post' when f like 'page-sitemap%' then 'page' when regexp_matches(f, '^(post_)?(category|tag|author)-sitemap') then 'pagination' when f like 'sitemap-posts%' then 'post' when f like 'sitemap-pages%' then 'page' when regexp_matches(f, '^sitemap-(categories|tags)') then 'pagination' when regexp_matches(f, 'blog|article|news') then 'post' when f like '%product%' then 'product' when f like '%event%' then 'event' when f like '%portfolio%' then 'portfolio' end as hint from (select distinct sitemap_source, lower(list_last(string_split(sitemap_source, '/'))) as f from sitemap_urls)"),
    "url_equivalence": (url_equivalence, "select requested_url, final_url, coalesce(a.norm = b.norm, false) as same from (select distinct requested_url, final_url from url_aliases) left join " + _norm("requested_url", "url_aliases") + " a on a.url = requested_url left join " + _norm("final_url", "url_aliases") + " b on b.url = final_url"),
    "resolve_links": (resolve_links, f"with r as (select *, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when href like '/%' then regexp_extract(final_url, '^([A-Za-z]+://[^/?#]+)', 1) || href when href like '?%' then regexp_replace(final_url, '[?#].*$', '') || href when href like '#%' then final_url end as abs from ({_HREFS})) select final_url, href, norm as target from r left join " + _norm("abs", "r") + " n on n.url = abs"),
    "link_facts": (link_facts, r"select final_url, url, coalesce(not regexp_matches(url, '^(#|javascript:|tel:|mailto:)') and url <> '' and regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') and lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) <> lower(regexp_extract(final_url, '^[A-Za-z]+://([^/:?#]*)', 1)) and regexp_extract(final_url, '^[A-Za-z]+://([^/:?#]*)', 1) <> '', false) as external, regexp_matches(lower(url), '^(tel:|mailto:|sms:|whatsapp:)') or regexp_matches(lower(url), '^https?://([^/?#]*\.)?(facebook\.com|instagram\.com|twitter\.com|x\.com|youtube\.com|linkedin\.com|tiktok\.com|pinterest\.com|maps\.google\.com|yelp\.com)(:[0-9]+)?([/?#]|$)') or regexp_matches(lower(url), '^https?://goo\.gl/maps(/|$)') as utility from (select distinct final_url, i.url as url from (" + " union all ".join(f"select final_url, unnest(nav_structure.{m}) as i from crawler_pages" for m in ("primary_nav", "footer_nav", "utility_header", "language_switcher")) + ") where i.url is not null)"),
    "page_language": (page_language, r"""select distinct id, coalesce(nullif(lower(regexp_extract(final_url, '/(es|fr|de|it|pt|ja|zh)(?:/|$)', 1)), ''), nullif(lower(regexp_extract(html_content, '(?i)<html[^>]*\slang\s*=\s*["'']?([a-z]{2,3})', 1)), ''), nullif(lower(regexp_extract(html_content, '(?i)<meta[^>]*http-equiv\s*=\s*["'']?content-language["'']?[^>]*content\s*=\s*["'']?([a-z]{2,3})', 1)), ''), 'en') as language from crawler_pages where html_content is not null"""),
    "crawl_status": (crawl_status, "select distinct id, status_code, case when status_code in (404, 410) then 'NOT_FOUND' when status_code >= 400 then 'ERROR' else 'OK' end as status from crawler_pages"),
    "soft_404": (
        soft_404,
        "select distinct id from crawler_pages where (coalesce(regexp_matches(title, '(?i)not found|404|page.*not.*exist|page.*cannot.*be.*found|no.*page.*found'), false) or coalesce(regexp_matches(markdown, '(?i)sorry.*page.*not.*found|the.*page.*you.*requested.*could.*not.*be.*found|we.*can.*t.*find.*that.*page|404.*error'), false)) "
        f"and coalesce(len(list_filter(regexp_split_to_array(regexp_replace(clean_html, '(?s)<[^>]*>', ' ', 'g'), '{WS}+'), lambda w: w <> '')), 0) < 100",
    ),
    "derived_flags": (derived_flags, "select distinct id, not coalesce(a.norm = b.norm, false) as redirected, coalesce(h1, '') <> '' as has_h1, case when html_content is null then 'missing' when status_code >= 400 then 'error' else 'ok' end as fetch_state, coalesce(status_code = 200, false) and not coalesce(regexp_matches(html_content, '(?i)<meta[^>]*name=.?robots[^>]*noindex'), false) as indexable from crawler_pages left join " + _norm("requested_url_original", "crawler_pages") + " a on a.url = requested_url_original left join " + _norm("final_url", "crawler_pages") + " b on b.url = final_url"),
    "content_hash": (content_hash, f"select distinct id, hash, coalesce(content_hash = hash and hash <> '', false) as matches from (select id, content_hash, case when clean_html is null or clean_html = '' then '' else md5({_TRIM(f"regexp_replace(clean_html, '{WS}+', ' ', 'g')")}) end as hash from crawler_pages)"),
    "nav_fingerprint": (nav_fingerprint, "select distinct id, substr(md5(coalesce(array_to_string(list_sort(list_transform(list_filter(nav_structure.primary_nav, lambda x: x is not null and not x.is_external), lambda x: x.url)), '|'), '')), 1, 16) as fingerprint from crawler_pages where nav_structure.primary_nav is not null"),
    "word_counts": (word_counts, f"select distinct id, coalesce(len(list_filter(regexp_split_to_array(regexp_replace(clean_html, '(?s)<[^>]*>', ' ', 'g'), '{WS}+'), lambda w: w <> '')), 0) as words from crawler_pages"),
    "title_h1_patterns": (title_h1_patterns, "select distinct id, " + ", ".join(f"nullif({_TRIM(f'regexp_extract(html_content, {p}, 1)')}, '') as {n}" for p, n in ((r"'(?is)<title[^>]*>([^<]*)</title>'", "title"), (r"'(?is)<h1[^>]*>([^<]*)</h1>'", "plain_h1"), (r"""'(?i)<html[^>]*\slang="([^"]*)'""", "lang"), ("""'(?i)<meta name="description" content="([^"]*)'""", "description"))) + ", len(regexp_extract_all(html_content, '(?i)<h1[ >]')) > 1 as many_h1 from crawler_pages where html_content is not null"),
    "dedup_lines": (
        dedup_lines,
        f"select id, array_to_string(list(line order by i) filter (t = '' or t is distinct from prev), chr(10)) as text from (select id, i, line, t, last_value(nullif(t, '') ignore nulls) over (partition by id order by i rows between unbounded preceding and 1 preceding) as prev from (select id, i, lines[i] as line, {_TRIM('lines[i]')} as t from (select id, lines, unnest(range(1, len(lines) + 1)) as i from (select id, string_split(markdown, chr(10)) as lines from {_MD})))) group by id",
    ),
    "remove_boilerplate": (remove_boilerplate, rf"select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markdown, '(?m)^Home\s*>\s*.+$', '', 'g'), '(?m)^Posted on .+ by .+$', '', 'g'), '(?m)^©\s*\d{{4}}.+$', '', 'g'), '(?mi)^Copyright\s+©\s+\d{{4}}.+$', '', 'g'), '(?mi)^Last updated:?\s*.+$', '', 'g') as text from {_MD}"),
    "normalize_headings": (normalize_headings, f"select id, t as text from {_normalized(_PLAIN)}"),
    "shift_headings": (shift_headings, rf"select id, regexp_replace(markdown, '(?m)^(#{{1,5}}[^\S\n]+.)', '#\1', 'g') as text from {_MD}"),
    "h1_in_markdown": (h1_in_markdown, rf"select id, h1_at is not null as has_h1, cast(coalesce(h1_at, 0) - 1 as integer) as position, case when h1_at is not null then {_TRIM(f"regexp_replace({_TRIM('lines[h1_at]')}, '^#\\s+', '')")} end as text from (select id, lines, (select min(i) from (select unnest(range(1, len(lines) + 1)) as i) where regexp_matches({_TRIM('lines[i]')}, '^#\s+.+')) as h1_at from (select id, string_split(markdown, chr(10)) as lines from {_MD}))"),
    "ensure_h1": (ensure_h1, _ENSURED),
    "postprocess_markdown": (postprocess_markdown, f"select id, {_TRIM(_IMAGES)} as text from {_normalized(_without_boilerplate(_deduplicated(_COLLAPSED)))}"),
    "markdown_to_text": (markdown_to_text, f"select id, {_TRIM('t')} as text from (select id, " + "regexp_replace(" * len(X.PLAIN_TEXT) + "markdown" + "".join(", '" + p.replace("(?dm)", "(?m)").replace(r"\s", r"[ \t\n\f\r\x0B]") + "', '" + r.replace("$1", r"\1").replace("\n", "\n") + "', 'g')" for p, r in X.PLAIN_TEXT) + f" as t from {_MD})"),
    "strip_markers": (strip_markers, f"select id, {_TRIM(f"regexp_replace({_TRIM("regexp_replace(markdown_enhanced, '<!-- STRUCT:[A-Z_]+:[A-Z_]+ -->', '', 'g')")}, '\n{{3,}}', '\n\n', 'g')")} as text from (select distinct id, markdown_enhanced from crawler_pages where markdown_enhanced is not null)"),
    "links_with_context": (links_with_context, L.LINKS_SQL),
    "heading_outline": (heading_outline, rf"select id, level, pos, text from (select id, length(regexp_extract(lines[i], '^(#{{1,6}})\s+([^\r\n]+)\r?$', 1)) as level, cast(i - 1 as integer) as pos, regexp_extract(lines[i], '^(#{{1,6}})\s+([^\r\n]+)\r?$', 2) as text from (select id, lines, unnest(range(1, len(lines) + 1)) as i from (select id, string_split(markdown, chr(10)) as lines from {_MD}))) where level > 0"),
}
