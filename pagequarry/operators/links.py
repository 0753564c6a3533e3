"""Links and headings of Markdown as rows. A carriage return at a line's end belongs to no heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SOURCE_OF_MARKER, mapped

_START, _END = r"<!-- STRUCT:([A-Z_]+):START -->", r"<!-- STRUCT:([A-Z_]+):END -->"
_HEADING = r"^(#{1,6})\s+([^\r\n]+)\r?$"
_LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def links_with_context(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, link_no, url, label, source_type, nearest_heading, line_start: every [label](url) of a text in order.

    source_type follows the structure marker that is open on the link's line (the end of any structure closes it),
    nearest_heading the last heading at or above it, line_start is the offset of its line. Each text's lines are
    numbered in place; running values are windows within one text, so that nothing but lines is shuffled.
    """
    lines = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("id").orderBy("line_no")
    # a marker line sets the running structure; an end sets it to none
    event = F.when(F.col("line").rlike(_END), F.lit("")).when(F.col("line").rlike(_START), F.regexp_extract("line", _START, 1))
    heading = F.when(F.col("line").rlike(_HEADING), F.regexp_extract("line", _HEADING, 2))
    lines = lines.withColumns({
        "open": F.last(event, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)),
        "nearest_heading": F.last(heading, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)),
        "line_start": F.coalesce(F.sum(F.length("line") + 1).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"),
    })
    found = lines.select("id", "line_no", "line_start", "nearest_heading", "open", F.arrays_zip(F.regexp_extract_all("line", F.lit(_LINK), 1).alias("label"), F.regexp_extract_all("line", F.lit(_LINK), 2).alias("url")).alias("links")).filter(F.size("links") > 0)
    found = found.select("id", "line_no", "line_start", "nearest_heading", "open", F.posexplode("links").alias("k", "link"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("line_no", "k")) - 1
    source = F.when(F.coalesce(F.col("open"), F.lit("")) == "", "contextual_body").otherwise(mapped(F.col("open"), SOURCE_OF_MARKER, "contextual_body"))
    return found.select("id", number.alias("link_no"), F.col("link.url").alias("url"), F.col("link.label").alias("label"), source.alias("source_type"), "nearest_heading", "line_start")


def headings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, level, pos (line), text of every heading."""
    lines = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(_HEADING)).select("id", F.length(F.regexp_extract("line", _HEADING, 1)).alias("level"), "pos", F.regexp_extract("line", _HEADING, 2).alias("text"))


LINKS_SQL = r"""with l as (select id, i, lines[i] as line from (select id, lines, unnest(range(1, len(lines) + 1)) as i from (select id, string_split(markdown_enhanced, chr(10)) as lines from (select distinct id, markdown_enhanced from crawler_pages) where markdown_enhanced is not null))),
r as (select id, i, line, last_value(case when regexp_matches(line, '<!-- STRUCT:([A-Z_]+):END -->') then '' when regexp_matches(line, '<!-- STRUCT:([A-Z_]+):START -->') then regexp_extract(line, '<!-- STRUCT:([A-Z_]+):START -->', 1) end ignore nulls) over w as open,
 last_value(case when regexp_matches(line, '^(#{1,6})\s+([^\r\n]+)\r?$') then regexp_extract(line, '^(#{1,6})\s+([^\r\n]+)\r?$', 2) end ignore nulls) over w as nearest_heading, coalesce(sum(length(line) + 1) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) as line_start from l window w as (partition by id order by i rows between unbounded preceding and current row)),
m as (select id, i, open, nearest_heading, line_start, labels, urls, unnest(range(1, len(labels) + 1)) as k from (select *, regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 1) as labels, regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 2) as urls from r))
select id, cast(row_number() over (partition by id order by i, k) - 1 as integer) as link_no, urls[k] as url, labels[k] as label, case open when 'FAQ' then 'faq_module' when 'TOC' then 'toc_or_jump' when 'BREADCRUMB' then 'breadcrumb' when 'CTA' then 'template_cta' when 'ACCORDION' then 'faq_module' when 'RELATED' then 'related_posts' else 'contextual_body' end as source_type, nearest_heading, cast(line_start as integer) as line_start from m"""
