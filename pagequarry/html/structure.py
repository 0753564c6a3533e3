"""Structural blocks of a page: questions and answers, contents lists, breadcrumbs, calls to action and so on.

Blocks are located by the offsets of their elements in the source, ends exclusive. An element counts once per kind,
under the first selector of the kind's list that finds it. Blocks come kind by kind, in the order of `KINDS`.
"""

from __future__ import annotations

import json

from .tree import Element, Index, select

# What marks each kind of block: selectors in order of preference (fixed values).
FAQ = (
    '[itemtype*="FAQPage"]', '[typeof="FAQPage"]', ".faq", ".faqs", ".faq-section", ".faq-container", ".faq-list", ".faq-accordion", "#faq", "#faqs",
    '[class*="faq"]', '[id*="faq"]', '.accordion[class*="question"]', '.accordion[class*="faq"]', ".elementor-widget-n-accordion", ".elementor-widget-accordion",
    '[data-widget_type="accordion.default"]', '[data-widget_type="n-accordion.default"]', ".elementor-widget-wdt-accordion-and-toggle", ".wdt-accordion-toggle-holder",
    '[data-widget_type="wdt-accordion-and-toggle.default"]',
)
FAQ_ITEMS = (
    '[itemtype*="Question"]', '[typeof="Question"]', ".faq-item", ".faq-question", ".question", ".accordion-item", '[class*="faq-item"]', ".e-n-accordion-item",
    ".e-n-accordion-item-title", ".elementor-accordion-item", ".elementor-tab-title", ".wdt-accordion-toggle-wrapper", ".wdt-accordion-toggle-title-holder",
)
QUESTION_IN_ITEM = ('.faq-question, [itemprop="name"], .question, summary, button', ".e-n-accordion-item-title-text", ".elementor-accordion-title", ".wdt-accordion-toggle-title")
BARE_QUESTIONS = ".e-n-accordion-item-title-text, .elementor-accordion-title, .wdt-accordion-toggle-title"
TOC = (".toc", ".table-of-contents", ".tableofcontents", "#toc", "#table-of-contents", "nav.toc", '[class*="toc"]', '[id*="toc"]', ".jump-links", ".page-nav", ".content-nav", ".in-page-nav", '[class*="jump-to"]')
BREADCRUMB = ('[itemtype*="BreadcrumbList"]', '[typeof="BreadcrumbList"]', ".breadcrumb", ".breadcrumbs", ".breadcrumb-nav", "#breadcrumb", "#breadcrumbs", '[class*="breadcrumb"]', 'nav[aria-label*="breadcrumb" i]')
CTA = (".cta", ".call-to-action", ".cta-section", ".cta-block", ".cta-banner", ".cta-box", '[class*="cta"]', ".hero .btn", ".hero button", ".banner .btn", '[class*="schedule"]', '[class*="consult"]', '[class*="contact-form"]')
ACCORDION = (".accordion", ".accordions", '[class*="accordion"]', "[data-accordion]", ".collapse-group", ".expandable")
TESTIMONIAL = (".testimonial", ".testimonials", ".review", ".reviews", ".customer-review", ".patient-review", '[class*="testimonial"]', '[class*="review"]', '[itemtype*="Review"]')
AUTHOR = (".author-bio", ".author-box", ".about-author", ".author-info", '[class*="author-bio"]', '[class*="author-box"]', '[itemtype*="Person"][class*="author"]')
RELATED = (".related-posts", ".related-articles", ".related-content", ".you-may-also-like", '[class*="related-post"]', '[class*="related-article"]')

#: Kind, field of the statistics, selectors.
KINDS = (
    ("faq_module", "faq_modules", FAQ),
    ("toc_or_jump", "toc_sections", TOC),
    ("breadcrumb", "breadcrumbs", BREADCRUMB),
    ("template_cta", "template_ctas", CTA),
    ("accordion", "accordions", ACCORDION),
    ("testimonial", "testimonials", TESTIMONIAL),
    ("author_bio", "author_bios", AUTHOR),
    ("related_posts", "related_posts", RELATED),
)


def _block(kind: str, e: Element, selector: str | None, **facts) -> dict:
    return {"type": kind, "start_index": e.start, "end_index": e.end, "selector": selector, "element": e, **facts}


def _schema_faq(index: Index) -> dict | None:
    """The first JSON-LD script that describes a page of questions."""
    for script in index.by_name.get("script", ()):
        if script.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(script.own_text())
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if not isinstance(item, dict):
                continue
            kinds = item.get("@type")
            if "FAQPage" not in (kinds if isinstance(kinds, list) else [kinds]):
                continue
            entries = item.get("mainEntity") or []
            names = [x["name"] for x in (entries if isinstance(entries, list) else [entries]) if isinstance(x, dict) and x.get("@type") == "Question" and x.get("name")]
            return _block("faq_module", script, None, question_count=len(names), has_schema=True, questions=[str(n) for n in names])
    return None


def _questions(e: Element) -> list[str]:
    found: dict[str, None] = {}
    for way in FAQ_ITEMS:
        for item in select(e, way):
            text = ""
            for place in QUESTION_IN_ITEM:
                hits = select(item, place)
                text = hits[0].text().strip() if hits else ""
                if text:
                    break
            if not text and "e-n-accordion-item-title" in item.classes:
                text = item.text().strip()
            if text:
                found.setdefault(text)
    if not found:
        for title in select(e, BARE_QUESTIONS):
            if text := title.text().strip():
                found.setdefault(text)
    for term in select(e, "dt"):
        if text := term.text().strip():
            found.setdefault(text)
    return list(found)


def detect(index: Index) -> list[dict]:
    """All blocks of an indexed page."""
    out: list[dict] = []
    faq_starts: set[int] = set()
    for kind, _, selectors in KINDS:
        seen: set[int] = set()
        if kind == "faq_module" and (block := _schema_faq(index)):
            out.append(block)
            seen.add(block["start_index"])
        for selector in selectors:
            for e in index.select(selector):
                if e.start in seen or kind == "accordion" and e.start in faq_starts:
                    continue
                seen.add(e.start)
                facts: dict = {}
                if kind == "faq_module":
                    names = _questions(e)
                    facts = {"question_count": len(names), "has_schema": "FAQPage" in (e.get("itemtype") or "") or e.get("typeof") == "FAQPage", "questions": names}
                elif kind == "toc_or_jump":
                    links = select(e, "a")
                    jumps = sum((x.get("href") or "").startswith("#") for x in links)
                    if not jumps or jumps < len(links) * 0.5:
                        continue
                    facts = {"item_count": len(select(e, "li")) or len(links), "link_count": len(links), "is_anchor_based": True}
                elif kind == "template_cta":
                    buttons = select(e, 'button, .btn, [class*="button"]')
                    facts = {"has_button": bool(buttons), "has_form": bool(select(e, 'form, input[type="submit"]')), "action_text": (buttons[0].text().strip() or None) if buttons else None}
                out.append(_block(kind, e, selector, **facts))
        if kind == "faq_module":
            faq_starts = seen
    return out


def statistics(blocks: list[dict]) -> dict[str, int]:
    counts = {field: 0 for _, field, _ in KINDS}
    fields = {kind: field for kind, field, _ in KINDS}
    for b in blocks:
        counts[fields[b["type"]]] += 1
    return counts


def kind_at(position: int, blocks: list[dict]) -> str | None:
    """Kind of the first block, in their order, that holds a position."""
    return next((b["type"] for b in blocks if b["start_index"] <= position < b["end_index"]), None)
