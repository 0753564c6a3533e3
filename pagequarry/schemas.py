"""Types of the crawl tables. Files are always read with these, never by inference."""

from __future__ import annotations

from pyspark.sql import types as T

NAV_ITEM = "struct<url:string,label:string,depth:int,sort_order:int,parent_labels:array<string>,is_external:boolean,link_type:string>"
BREADCRUMB_ITEM = "struct<label:string,url:string>"
CONTENT_LINK = "struct<url:string,label:string,source_type:string,nearest_heading:string,body_position_pct:int,is_external:boolean>"
STATS_FIELDS = ("faq_modules", "toc_sections", "breadcrumbs", "template_ctas", "accordions", "testimonials", "author_bios", "related_posts")
STRUCTURAL_STATS = "struct<" + ",".join(f"{f}:int" for f in STATS_FIELDS) + ">"
NAV_META = "struct<clusters_found:int,primary_nav_selector:string,footer_nav_selector:string,has_mega_menu:boolean,extraction_time_ms:bigint>"
NAV_STRUCTURE = (
    f"struct<primary_nav:array<{NAV_ITEM}>,footer_nav:array<{NAV_ITEM}>,utility_header:array<{NAV_ITEM}>,language_switcher:array<{NAV_ITEM}>,"
    f"breadcrumb:array<{BREADCRUMB_ITEM}>,content_links:array<{CONTENT_LINK}>,structural_stats:{STRUCTURAL_STATS},extraction_meta:{NAV_META}>"
)
STRUCT_ELEMENT = "struct<type:string,start_index:int,end_index:int,selector:string,question_count:int,has_schema:boolean,questions:array<string>,item_count:int,link_count:int,is_anchor_based:boolean,has_button:boolean,has_form:boolean,action_text:string>"
METADATA = "struct<title:string,h1:string,meta_description:string,canonical_url:string,og_image:string,language:string>"
HEADING = "struct<level:int,text:string,position:int>"
LINK = "struct<href:string,anchor:string,location:string,rel:string,target:string,is_external:boolean,context:string,link_type:string>"

CRAWLER_PAGES = (
    "id bigint, final_url string, requested_url_original string, status_code int, crawl_status string, redirect_chain array<string>, html_content string, clean_html string, "
    f"markdown string, markdown_enhanced string, structural_stats {STRUCTURAL_STATS}, nav_structure {NAV_STRUCTURE}, title string, h1 string, meta_description string, word_count int, "
    "content_hash string, sitemap_type_hint string, fetch_mode string, extraction_method string, junk_score float, last_crawled_at timestamp, last_error string, run_id string"
)
URL_ALIASES = "requested_url string, final_url string, status_code int, redirect_chain array<string>, first_seen_at timestamp, last_seen_at timestamp, run_id string"
CRAWL_RUNS = (
    "run_id string, seed_sitemaps array<string>, max_pages int, fetch_mode_default string, started_at timestamp, finished_at timestamp, total_urls_discovered int, "
    "total_pages_crawled int, total_redirects int, total_errors int, notes string"
)
DOMAIN_OVERRIDES = "domain string, enabled boolean, main_content_selectors array<string>, remove_selectors array<string>, force_fetch_mode string, notes string, updated_at timestamp"
RESEARCH_PROJECTS = "id bigint, name string, description string, industry string, created_at timestamp"
RESEARCH_PROJECT_RUNS = "project_id bigint, run_id string, batch_name string, notes string"
SITEMAP_URLS = "url string, normalized_url string, sitemap_source string, type_hint string, sitemap_ord int, pos int"
#: What a fetcher hands over: one row per finished request; error is set where it failed.
FETCHED_PAGES = "requested_url string, loaded_url string, status_code int, body string, redirect_chain array<string>, type_hint string, seq bigint, error string, fetched_at timestamp, run_id string"

CRAWL_STATUSES = ("OK", "REDIRECT_ALIAS", "NOT_FOUND", "SOFT_404", "ERROR")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
