"""Column functions over page text and Markdown; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the crawler's language knows it (fixed values).
JS_WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
MARKER = r"<!-- STRUCT:[A-Z_]+:[A-Z_]+ -->"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{JS_WS}+|{JS_WS}+$", "")


def falsy_null(value: Column) -> Column:
    """Null for 0 and '' too."""
    return F.when((value.cast("string") != "") & (value.cast("string") != "0") & (value.cast("string") != "0.0"), value)


def content_hash(text: Column) -> Column:
    """MD5 of the text with white space collapsed; '' for none."""
    collapsed = js_trim(F.regexp_replace(text, f"{JS_WS}+", " "))
    return F.when(text.isNull() | (text == ""), "").otherwise(F.md5(collapsed))


def hashes_match(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def nav_fingerprint(items: Column) -> Column:
    """First 16 hex digits of the MD5 of the sorted internal URLs of a menu."""
    urls = F.array_sort(F.transform(F.filter(items, lambda x: x.isNotNull() & ~x["is_external"]), lambda x: x["url"]))
    return F.substring(F.md5(F.array_join(urls, "|")), 1, 16)


def word_count(html: Column) -> Column:
    """Words of an HTML text with its tags taken out by pattern."""
    text = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    return F.coalesce(F.size(F.filter(F.split(text, f"{JS_WS}+"), lambda w: w != "")), F.lit(0))


def normalize_whitespace(html: Column) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(html, f"{JS_WS}+", " "), f">{JS_WS}+<", "><"))


def strip_base64_images(markdown: Column) -> Column:
    """Embedded images give way to a short placeholder, those without a description to nothing."""
    out = F.regexp_replace(markdown, r"!\[\]\(data:image/\w+;base64,[A-Za-z0-9+/=]{50,}\)", "")
    out = F.regexp_replace(out, r"!\[([^\]]+)\]\(data:image/(\w+);base64,[A-Za-z0-9+/=]{50,}\)", r"![$1](data:image/$2;base64,...)")
    out = F.regexp_replace(out, r"!\[\]\([^)]*;base64,[A-Za-z0-9+/=]{50,}\)", "")
    return F.regexp_replace(out, r"!\[([^\]]+)\]\([^)]*;base64,[A-Za-z0-9+/=]{50,}\)", r"![$1](embedded-base64-removed)")


def deduplicate_lines(markdown: Column) -> Column:
    """Drops a line that equals, trimmed, the line before it; blank lines between them are kept and do not count."""
    lines = F.transform(F.split(markdown, "\n", -1), lambda x: F.struct(x.alias("line"), js_trim(x).alias("t")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit("").alias("last"))

    def step(acc, x):
        repeated = (x["t"] != "") & (x["t"] == acc["last"])
        return F.struct(F.when(repeated, acc["kept"]).otherwise(F.array_append(acc["kept"], x["line"])).alias("kept"), F.when(x["t"] == "", acc["last"]).otherwise(x["t"]).alias("last"))

    return F.array_join(F.aggregate(lines, start, step)["kept"], "\n")


#: Lines that say nothing about the page: patterns (fixed values), to be matched line by line.
BOILERPLATE_LINES = (r"(?dm)^Home\s*>\s*.+$", r"(?dm)^Posted on .+ by .+$", r"(?dm)^©\s*\d{4}.+$", r"(?dmi)^Copyright\s+©\s+\d{4}.+$", r"(?dmi)^Last updated:?\s*.+$")


def remove_boilerplate(markdown: Column) -> Column:
    for pattern in BOILERPLATE_LINES:
        markdown = F.regexp_replace(markdown, pattern, "")
    return markdown


_HEADING = r"^(#{1,6})\s+(.+)$"


def normalize_headings(markdown: Column) -> Column:
    """No heading is more than one level below the heading before it."""
    lines = F.transform(F.split(markdown, "\n", -1), lambda x: F.struct(x.alias("line"), F.length(F.regexp_extract(x, _HEADING, 1)).alias("level"), F.regexp_extract(x, _HEADING, 2).alias("text")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("last"))

    def step(acc, x):
        level = F.least(x["level"], acc["last"] + 1)
        line = F.when(x["level"] > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), x["text"])).otherwise(x["line"])
        return F.struct(F.array_append(acc["kept"], line).alias("kept"), F.when(x["level"] > 0, level).otherwise(acc["last"]).alias("last"))

    return F.array_join(F.aggregate(lines, start, step)["kept"], "\n")


def shift_headings(markdown: Column, skip_first_h1: bool = False) -> Column:
    """Headings of levels 1 to 5 one level down; the first level-1 heading may stay."""
    lines = F.split(markdown, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(r"^#\s+.+")), True)

    def shifted(x, i):
        stays = F.lit(skip_first_h1) & (i + 1 == first)
        return F.when(x.rlike(r"^#{1,5}\s+.+") & ~stays, F.concat(F.lit("#"), x)).otherwise(x)

    return F.array_join(F.transform(lines, shifted), "\n")


def first_h1(markdown: Column) -> Column:
    """struct<has_h1, position, text> of the first level-1 heading; position counts lines from 0, -1 for none."""
    lines = F.split(markdown, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: js_trim(x).rlike(r"^#\s+.+")), True).cast("int")
    text = js_trim(F.regexp_replace(js_trim(F.element_at(lines, at)), r"^#\s+", ""))
    return F.struct((at > 0).alias("has_h1"), (at - 1).alias("position"), F.when(at > 0, text).alias("text"))


def ensure_h1(markdown: Column, h1: Column) -> Column:
    """The text with its page heading in front: unchanged where it starts with it, else the first level-1 heading goes."""
    lines = F.split(js_trim(markdown), "\n", -1)
    trimmed = F.transform(lines, js_trim)
    at = F.array_position(F.transform(trimmed, lambda x: x.rlike(r"^#\s+.+")), True).cast("int")
    same = (at == 1) & (js_trim(F.regexp_replace(F.element_at(trimmed, 1), r"^#\s+", "")) == js_trim(h1))
    rest = js_trim(F.array_join(F.filter(lines, lambda x, i: i + 1 != at), "\n"))
    return F.when(same, js_trim(markdown)).otherwise(F.concat(F.lit("# "), js_trim(h1), F.lit("\n\n"), rest))


def h1_issue(markdown: Column) -> Column:
    """A note where the first level-1 heading does not open the text, null otherwise."""
    at = first_h1(js_trim(markdown))["position"]
    return F.when(at > 0, F.concat(F.lit("H1 at line "), (at + 1).cast("string"), F.lit(" instead of line 1")))


def collapse_blank_lines(markdown: Column) -> Column:
    return F.regexp_replace(markdown, "\n{3,}", "\n\n")


def postprocess_markdown(markdown: Column) -> Column:
    out = deduplicate_lines(collapse_blank_lines(markdown))
    return js_trim(strip_base64_images(normalize_headings(remove_boilerplate(out))))


#: Markdown to plain text: (pattern, replacement), in this order (links before images on purpose).
PLAIN_TEXT = (
    (r"(?s)```.*?```", ""),
    (r"`[^`]+`", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"(?dm)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"(?dm)^[-*+]\s+", ""),
    (r"(?dm)^\d+\.\s+", ""),
    (r"\n{3,}", "\n\n"),
)


def markdown_to_text(markdown: Column) -> Column:
    for pattern, replacement in PLAIN_TEXT:
        markdown = F.regexp_replace(markdown, pattern, replacement)
    return js_trim(markdown)


def strip_markers(markdown: Column) -> Column:
    """Text without structure markers."""
    return js_trim(collapse_blank_lines(js_trim(F.regexp_replace(markdown, MARKER, ""))))


def postprocess_enhanced(markdown: Column) -> Column:
    out = collapse_blank_lines(markdown)
    out = F.regexp_replace(out, r"<!-- STRUCT:([A-Z_]+):START -->\n\n", "<!-- STRUCT:$1:START -->\n")
    out = F.regexp_replace(out, r"\n\n<!-- STRUCT:([A-Z_]+):END -->", "\n<!-- STRUCT:$1:END -->")
    return js_trim(strip_base64_images(out))


#: What the kinds of structure are called in markers and as sources of links (fixed values).
MARKER_OF = {"faq_module": "FAQ", "toc_or_jump": "TOC", "breadcrumb": "BREADCRUMB", "template_cta": "CTA", "accordion": "ACCORDION", "testimonial": "TESTIMONIAL", "author_bio": "AUTHOR", "related_posts": "RELATED"}
SOURCE_OF_MARKER = {"FAQ": "faq_module", "TOC": "toc_or_jump", "BREADCRUMB": "breadcrumb", "CTA": "template_cta", "ACCORDION": "faq_module", "RELATED": "related_posts"}
SOURCE_OF = {"faq_module": "faq_module", "toc_or_jump": "toc_or_jump", "breadcrumb": "breadcrumb", "template_cta": "template_cta", "accordion": "faq_module", "testimonial": "testimonial", "author_bio": "author_bio", "related_posts": "related_posts"}


def mapped(key: Column, table: dict[str, str], default: str | None) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(entries[key], F.lit(default))


#: Titles and texts of pages that say "not found" under a good status (fixed values).
SOFT_404_TITLE = (r"(?i)not found", r"(?i)404", r"(?i)page.*not.*exist", r"(?i)page.*cannot.*be.*found", r"(?i)no.*page.*found")
SOFT_404_BODY = (r"(?i)sorry.*page.*not.*found", r"(?i)the.*page.*you.*requested.*could.*not.*be.*found", r"(?i)we.*can.*t.*find.*that.*page", r"(?i)404.*error")


def crawl_status(status_code: Column) -> Column:
    return F.when(status_code.isin(404, 410), "NOT_FOUND").when(status_code >= 400, "ERROR").otherwise("OK")


def soft_404(title: Column, body: Column, words: Column, threshold: int = 100) -> Column:
    """A thin page whose title or text says that there is nothing."""
    said = F.lit(False)
    for column, patterns in ((title, SOFT_404_TITLE), (body, SOFT_404_BODY)):
        for p in patterns:
            said = said | F.coalesce(column.rlike(p), F.lit(False))
    return said & (F.coalesce(words, F.lit(0)) < threshold)


def has_text(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def fetch_state(status_code: Column, html: Column) -> Column:
    return F.when(html.isNull(), "missing").when(status_code >= 400, "error").otherwise("ok")


def is_indexable(status_code: Column, html: Column) -> Column:
    """Status 200 and no robots element that says noindex."""
    return F.coalesce(status_code == 200, F.lit(False)) & ~F.coalesce(html.rlike(r"(?i)<meta[^>]*name=.?robots[^>]*noindex"), F.lit(False))


def truncated(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)


def position_percent(index: Column, total: Column) -> Column:
    return F.floor(index * 100 / F.greatest(total, F.lit(1)) + 0.5).cast("int")
