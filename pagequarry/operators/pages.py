"""The page stage: every page is parsed once, and all that is derived from its markup leaves as one nested row.

It is a single Arrow-batched node in the plan. Table-valued results are arrays that are exploded natively
afterwards; what needs no tree (hashes, plain text, word counts by pattern) is left to column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas

RESULT = (
    f"metadata {schemas.METADATA}, headings array<{schemas.HEADING}>, h1_count int, links array<{schemas.LINK}>, elements array<{schemas.STRUCT_ELEMENT}>, "
    f"clean_html string, extraction_method string, word_count int, junk_score float, structural_stats {schemas.STRUCTURAL_STATS}, markdown string, markdown_enhanced string, "
    f"nav_structure {schemas.NAV_STRUCTURE}, meta map<string,string>, json_ld array<string>"
)
#: Parts that may be asked for, and the fields each gives.
PARTS = {
    "metadata": ("metadata", "headings", "h1_count"),
    "links": ("links",),
    "structure": ("elements",),
    "content": ("clean_html", "extraction_method", "word_count", "junk_score"),
    "markdown": ("markdown", "markdown_enhanced", "structural_stats"),
    "nav": ("nav_structure",),
    "head": ("meta", "json_ld"),
}
_ELEMENT_FIELDS = [f.split(":")[0] for f in schemas.STRUCT_ELEMENT[7:-1].replace("array<string>", "array").split(",")]


def process(html: str | None, url: str | None, main_selectors=None, remove_selectors=None, parts=tuple(PARTS), compat: bool = False, source: str = "html") -> dict:
    """What one page gives. source "clean" takes html for content that was cleaned already (as backfills have it)."""
    from ..html import content as C
    from ..html import markdown as M
    from ..html import nav, structure
    from ..html.tree import Index, parse

    out: dict = {f: None for p in parts for f in PARTS[p]}
    if not html:
        if "nav" in parts:
            out["nav_structure"] = nav.nav_structure(Index(parse("")), url or "", [], compat)
        if "content" in parts:
            out |= {"clean_html": "", "extraction_method": "fallback", "word_count": 0, "junk_score": 1.0}
        return out
    root = parse(html)
    index = Index(root)
    facts = C.metadata(index, url)
    if "metadata" in parts:
        out |= {"metadata": facts, "headings": C.headings_by_level(index), "h1_count": len(index.by_name.get("h1", ()))}
    if "head" in parts:
        out |= {"meta": C.meta_fields(index), "json_ld": [s.own_text() for s in index.by_name.get("script", ()) if s.get("type") == "application/ld+json"]}
    if "links" in parts:
        out["links"] = C.page_links(index, url or "")
    blocks = structure.detect(index) if "structure" in parts or "nav" in parts or source == "clean" else []
    if "structure" in parts:
        out["elements"] = [{f: b.get(f) for f in _ELEMENT_FIELDS} for b in blocks]
    if "nav" in parts:
        out["nav_structure"] = nav.nav_structure(index, url or "", blocks, compat)
    if "content" in parts or "markdown" in parts:
        if source == "clean":
            found, method = root, None
        else:
            found, method = C.extract(root, main_selectors, remove_selectors, compat_clean=compat)
        if "content" in parts:
            out |= {"clean_html": found.inner_html(), "extraction_method": method, "word_count": C.words_in(found), "junk_score": C.junk_score(found)}
        if "markdown" in parts:
            inner = blocks if source == "clean" else structure.detect(Index(found))
            text = M.enhanced_markdown(found, inner, url, facts["h1"])
            out |= {"markdown": M.plain_markdown(text), "markdown_enhanced": text, "structural_stats": structure.statistics(inner)}
    return out


def parse_pages(df: DataFrame, html_col: str = "html_content", url_col: str = "final_url", overrides: DataFrame | None = None, parts: tuple[str, ...] = tuple(PARTS), keep: tuple[str, ...] = ("id",), compat: bool = False, source: str = "html", h1_col: str | None = None) -> DataFrame:
    """keep columns and the fields of the parts, for every row of df.

    overrides: domain, enabled, main_content_selectors, remove_selectors; one row per domain counts. The table of
    overrides is joined by its size. h1_col: where the page heading is stored already (source "clean").
    """
    fields = [f for p in parts for f in PARTS[p]]
    wanted = [f.strip() for f in _split_fields(RESULT)]
    result = ", ".join(f for f in wanted if f.split(" ", 1)[0] in fields)
    rows = df.select(*keep, F.col(html_col).alias("__html"), F.col(url_col).alias("__url"), *([F.col(h1_col).alias("__h1")] if h1_col else []))
    if overrides is not None and "content" in parts + ("content",) * ("markdown" in parts):
        chosen = overrides.filter("enabled").groupBy("domain").agg(F.max_by(F.struct("main_content_selectors", "remove_selectors"), "updated_at").alias("o") if "updated_at" in overrides.columns else F.first(F.struct("main_content_selectors", "remove_selectors")).alias("o"))
        rows = rows.withColumn("__domain", F.lower(F.regexp_extract("__url", r"^[A-Za-z]+://(?:[^/?#]*@)?([^/:?#]*)", 1))).join(chosen.select(F.col("domain").alias("__domain"), F.col("o.main_content_selectors").alias("__main"), F.col("o.remove_selectors").alias("__removed")), "__domain", "left").drop("__domain")
    else:
        rows = rows.withColumn("__main", F.lit(None).cast("array<string>")).withColumn("__removed", F.lit(None).cast("array<string>"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 200):
                batch = whole.iloc[start : start + 200]
                done = []
                for k, (html, url, main, removed) in enumerate(zip(batch["__html"], batch["__url"], batch["__main"], batch["__removed"])):
                    row = process(html, url, None if main is None else list(main), None if removed is None else list(removed), parts, compat, source)
                    if h1_col and row.get("markdown_enhanced") is not None:
                        row |= _with_heading(row, batch["__h1"].iloc[k])
                    done.append(row)
                out = pd.DataFrame({f: pd.Series([r[f] for r in done], dtype=object) for f in fields})
                yield pd.concat([batch[list(keep)].reset_index(drop=True), out], axis=1)

    return rows.mapInPandas(run, f"{head}, {result}")


def render_markdown(df: DataFrame, html_col: str, url_col: str, h1_col: str | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep columns, markdown and issue: plain Markdown of cleaned HTML without lists of links, tidied line by line, with
    the page heading in front. Rendering is the one Python stage; all that follows is columns."""
    from ..functions.text import ensure_h1, h1_issue, postprocess_markdown

    rows = df.select(*keep, F.col(html_col).alias("__html"), F.col(url_col).alias("__url"), (F.col(h1_col) if h1_col else F.lit(None).cast("string")).alias("__h1"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..html import markdown as M
        from ..html.tree import parse

        for batch in batches:
            text = [M.markdown(parse(h), u) if h else "" for h, u in zip(batch["__html"], batch["__url"])]
            yield batch[[*keep, "__h1"]].assign(__text=pd.Series(text, dtype=object, index=batch.index))

    made = rows.mapInPandas(run, f"{head}, __h1 string, __text string").withColumn("__text", postprocess_markdown(F.col("__text")))
    has = F.coalesce(F.col("__h1"), F.lit("")) != ""
    return made.select(*keep, F.when(has, ensure_h1(F.col("__text"), F.col("__h1"))).otherwise(F.col("__text")).alias("markdown"), F.when(has, h1_issue(F.col("__text"))).alias("issue"))


def _with_heading(row: dict, h1: str | None) -> dict:
    """The stored page heading in front of Markdown made from cleaned content."""
    from ..html import markdown as M

    if not h1 or row["markdown_enhanced"].startswith(f"# {h1.strip()}\n"):
        return {}
    text = f"# {h1.strip()}\n\n{row['markdown_enhanced']}"
    return {"markdown_enhanced": text, "markdown": M.plain_markdown(text)}


def _split_fields(ddl: str) -> list[str]:
    """Top-level fields of a schema string."""
    out, depth, part = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]
