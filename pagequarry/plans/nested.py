"""Queries over the nested columns of crawler_pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shred import shred_table, shred_tables
from ..runtime import read_once
from ..schemas import STATS_FIELDS

NAV_LISTS = ("primary_nav", "footer_nav", "utility_header", "language_switcher")


def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_once(spark, sf_dir, "crawler_pages", "id", "id", *columns)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu items below the top and hops after the first, of all three lists in one pass."""
    lists = {"primary_nav": "nav_structure.primary_nav", "footer_nav": "nav_structure.footer_nav", "redirect_chain": "redirect_chain"}
    rows = shred_tables(_pages(spark, sf_dir, "nav_structure", "redirect_chain"), "id", lists, outline="depth")
    hop = F.col("list_name") == "redirect_chain"
    kept = rows.filter(F.when(hop, F.col("pos") > 0).otherwise(F.col("depth") > 0))
    return kept.select("id", "list_name", "pos", F.when(hop, F.col("pos") - 1).otherwise(F.col("parent_pos")).alias("parent_pos"))


def p4_nav_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of the four menus with their parent's place; one row per item, null entries left out."""
    items = shred_tables(_pages(spark, sf_dir, "nav_structure"), "id", {name: f"nav_structure.{name}" for name in NAV_LISTS}, outline="depth").filter("not is_null")
    return items.select("id", "list_name", "pos", "url", "label", "depth", "sort_order", "is_external", "link_type", "parent_pos")


def p4_parent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on the way to a menu item: child rows of p4_nav_items, linked by (id, list_name, item_pos)."""
    rows = shred_tables(_pages(spark, sf_dir, "nav_structure"), "id", {name: f"nav_structure.{name}[].parent_labels" for name in NAV_LISTS})
    return rows.select("id", "list_name", F.get("outer_pos", F.lit(0)).alias("item_pos"), "pos", F.col("value").alias("parent_label"))


def p4_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is nested but not repeated: one row per page with the counts and notes of its extraction."""
    n = F.col("nav_structure")
    stats = [n["structural_stats"][f].alias(f) for f in STATS_FIELDS]
    meta = [n["extraction_meta"][f].alias(f) for f in ("clusters_found", "primary_nav_selector", "footer_nav_selector", "has_mega_menu", "extraction_time_ms")]
    return _pages(spark, sf_dir, "nav_structure").filter("nav_structure is not null").select("id", *stats, *meta)


def p4_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred_table(_pages(spark, sf_dir, "nav_structure"), "id", "nav_structure.breadcrumb").filter("not is_null").select("id", "pos", "label", "url", (F.col("pos") - 1).alias("parent_pos"))


def p4_content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred_table(_pages(spark, sf_dir, "nav_structure"), "id", "nav_structure.content_links").filter("not is_null").select("id", "pos", "url", "label", "source_type", "nearest_heading", "body_position_pct", "is_external")


def p4_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred_table(_pages(spark, sf_dir, "redirect_chain"), "id", "redirect_chain").select("id", "pos", F.col("value").alias("hop"), (F.col("pos") - 1).alias("parent_pos"))


def _unnested(name: str) -> str:
    return f"select id, '{name}' as list_name, nav_structure.{name}[i] as item, cast(i - 1 as integer) as pos from (select id, nav_structure, unnest(range(1, len(nav_structure.{name}) + 1)) as i from p)"


_PARENT = """cast(coalesce((select case when arg_max(b.item.depth, b.pos) = a.item.depth - 1 then max(b.pos) end
    from u b where b.id = a.id and b.list_name = a.list_name and b.pos < a.pos and b.item.depth < a.item.depth), -1) as integer) as parent_pos"""


def _outline(names, columns: str, where: str) -> str:
    return f"with p as (select distinct id, nav_structure, redirect_chain from crawler_pages), u as materialized ({' union all '.join(map(_unnested, names))}) select id, list_name, pos, {columns}{_PARENT} from u a where {where}"


QUERIES = {
    "p4_found": (p4_found, _outline(("primary_nav", "footer_nav"), "", "item.depth > 0") + " union all select id, 'redirect_chain', cast(i - 1 as integer), cast(i - 2 as integer) from (select id, unnest(range(2, len(redirect_chain) + 1)) as i from p)"),
    "p4_nav_items": (p4_nav_items, _outline(NAV_LISTS, "item.url as url, item.label as label, item.depth as depth, item.sort_order as sort_order, item.is_external as is_external, item.link_type as link_type, ", "item is not null")),
    "p4_parent_labels": (p4_parent_labels, "with p as (select distinct id, nav_structure from crawler_pages), i as (" + " union all ".join(f"select id, '{m}' as list_name, item_pos, nav_structure.{m}[item_pos].parent_labels as l from (select id, nav_structure, unnest(range(1, len(nav_structure.{m}) + 1)) as item_pos from p)" for m in NAV_LISTS) + ") select id, list_name, cast(item_pos - 1 as integer) as item_pos, cast(k - 1 as integer) as pos, l[k] as parent_label from (select *, unnest(range(1, len(l) + 1)) as k from i)"),
    "p4_page_facts": (p4_page_facts, "select distinct id, " + ", ".join(f"nav_structure.structural_stats.{f} as {f}" for f in STATS_FIELDS) + ", " + ", ".join(f"nav_structure.extraction_meta.{f} as {f}" for f in ("clusters_found", "primary_nav_selector", "footer_nav_selector", "has_mega_menu", "extraction_time_ms")) + " from crawler_pages where nav_structure is not null"),
    "p4_breadcrumbs": (p4_breadcrumbs, "with p as (select distinct id, nav_structure from crawler_pages), i as (select id, cast(k - 1 as integer) as pos, nav_structure.breadcrumb[k] as b from (select *, unnest(range(1, len(nav_structure.breadcrumb) + 1)) as k from p)) select id, pos, b.label as label, b.url as url, pos - 1 as parent_pos from i where b is not null"),
    "p4_content_links": (p4_content_links, "with p as (select distinct id, nav_structure from crawler_pages), i as (select id, cast(k - 1 as integer) as pos, nav_structure.content_links[k] as b from (select *, unnest(range(1, len(nav_structure.content_links) + 1)) as k from p)) select id, pos, b.url as url, b.label as label, b.source_type as source_type, b.nearest_heading as nearest_heading, b.body_position_pct as body_position_pct, b.is_external as is_external from i where b is not null"),
    "p4_hops": (p4_hops, "with p as (select distinct id, redirect_chain from crawler_pages) select id, cast(k - 1 as integer) as pos, redirect_chain[k] as hop, cast(k - 2 as integer) as parent_pos from (select *, unnest(range(1, len(redirect_chain) + 1)) as k from p)"),
}
