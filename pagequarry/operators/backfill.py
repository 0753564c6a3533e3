"""Derived columns computed again for stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from ..schemas import STATS_FIELDS
from ..sources.tables import select_pages
from . import merge
from .pages import parse_pages


def _chosen(pages: DataFrame, source: str, target: str, url_part: str | None, force: bool, limit: int | None) -> DataFrame:
    rows = select_pages(pages, url_part=url_part, pending=None if force else target).filter(F.col(source).isNotNull() & (F.col(source) != ""))
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def made_markdown(pages: DataFrame, url_part: str | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """id, final_url, markdown, markdown_enhanced, structural_stats made from clean_html where they are missing, or
    everywhere with force."""
    rows = _chosen(pages, "clean_html", "markdown_enhanced", url_part, force, limit)
    return materialize(parse_pages(rows, "clean_html", "final_url", None, ("markdown",), ("id", "final_url"), source="clean", h1_col="h1"), "backfill-markdown").dropDuplicates(["id"]).select("id", "final_url", "markdown", "markdown_enhanced", "structural_stats")


def made_nav(pages: DataFrame, url_part: str | None = None, force: bool = False, limit: int | None = None) -> DataFrame:
    """id, final_url, nav_structure made from html_content."""
    rows = _chosen(pages, "html_content", "nav_structure", url_part, force, limit)
    return materialize(parse_pages(rows, "html_content", "final_url", None, ("nav",), ("id", "final_url")), "backfill-nav").dropDuplicates(["id"]).select("id", "final_url", "nav_structure")


def figures(made: DataFrame) -> DataFrame:
    """One row of figures on what was made."""
    if "nav_structure" in made.columns:
        return made.agg(F.count("*").alias("processed"), F.count_if(F.size("nav_structure.primary_nav") > 0).alias("with_menu"))
    return made.agg(F.count("*").alias("processed"), F.count_if(F.greatest(*[F.col(f"structural_stats.{f}") for f in STATS_FIELDS]) > 0).alias("with_structure"))


def backfill_markdown(pages: DataFrame, url_part: str | None = None, force: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with what made_markdown makes, one row of figures)."""
    made = made_markdown(pages, url_part, force, limit)
    return merge.patch(pages, made.drop("final_url"), "id"), figures(made)


def backfill_nav(pages: DataFrame, url_part: str | None = None, force: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for nav_structure."""
    made = made_nav(pages, url_part, force, limit)
    return merge.patch(pages, made.drop("final_url"), "id"), figures(made)
