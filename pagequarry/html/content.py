"""Metadata, cleaning and main content of a page, by a cascade of strategies."""

from __future__ import annotations

import re

from ..functions.urls import resolve_one
from .tree import Element, Index, body_of, parse, select

# Elements that are never content, and where content lies in known systems (fixed values).
REMOVED = (
    "script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", ".navigation", ".menu", ".sidebar", ".cookie-banner", ".popup", ".modal", ".advertisement", ".ad",
    '[role="navigation"]', '[role="banner"]', '[role="contentinfo"]', '[role="complementary"]',
)
SEMANTIC = ("article", "main", '[role="main"]', '[itemprop="articleBody"]')
SYSTEMS = (".entry-content", ".post-content", ".article-content", ".content-area", "#content", ".main-content", '[itemprop="articleBody"]')
MIN_WORDS = 100



def words_in(e: Element) -> int:
    return len(e.text().split())


def metadata(index: Index, url: str | None) -> dict:
    """Title, first heading, description, canonical URL, preview image and language, each by order of preference."""

    def meta(name: str, value: str) -> str | None:
        e = next((m for m in index.by_name.get("meta", ()) if m.get(name) == value), None)
        content = e.get("content") if e is not None else None
        return content.strip() if content else None

    def text_of(name: str) -> str | None:
        e = next(iter(index.by_name.get(name, ())), None)
        text = e.text() if e is not None else ""
        return text.strip() if text else None

    def absolute(link: str | None) -> str | None:
        return (resolve_one(link, url) or link) if link and url else link

    h1 = text_of("h1")
    canonical = next((e.get("href") for e in index.by_name.get("link", ()) if e.get("rel") == "canonical"), None)
    html = next(iter(index.by_name.get("html", ())), None)
    language = ((html.get("lang") if html is not None else None) or "").strip() or next((m.get("content") for m in index.by_name.get("meta", ()) if (m.get("http-equiv") or "").lower() == "content-language"), None)
    title = text_of("title")
    return {
        "title": title if title is not None else meta("property", "og:title") or h1,
        "h1": h1[:500] if h1 is not None else None,
        "meta_description": meta("name", "description") or meta("property", "og:description"),
        "canonical_url": absolute(canonical) or None,
        "og_image": absolute(meta("property", "og:image")),
        "language": language.strip() if language else None,
    }


def meta_fields(index: Index) -> dict[str, str]:
    """Content of the meta elements by name, property or http-equiv, lower-cased; the first of equal names counts."""
    found: dict[str, str] = {}
    for m in index.by_name.get("meta", ()):
        name, value = m.get("name") or m.get("property") or m.get("http-equiv"), m.get("content")
        if name and value is not None:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def headings_by_level(index: Index) -> list[dict]:
    """All headings with text, level by level, with their place among the page's headings."""
    found = [(n, e) for n in range(1, 7) for e in index.by_name.get(f"h{n}", ()) if e.text().strip()]
    place = {e.start: k for k, (_, e) in enumerate(sorted(found, key=lambda x: x[1].start))}
    return [{"level": n, "text": e.text().strip(), "position": place[e.start]} for n, e in found]


#: Elements that a link shares its text with.
_CONTAINERS = frozenset("body html main article section nav header footer aside ul ol dl table tr form".split())
_PHRASES = frozenset("a abbr b cite code del em font i ins mark q s small span strike strong sub sup u".split())


def _link_type(a: Element) -> str:
    if any(e.name == "img" for e in a.elements()) and not a.text().strip():
        return "image"
    return "button" if a.get("role") == "button" or any("btn" in c or "button" in c for c in a.classes) else "text"


def page_links(index: Index, url: str, limit_label: int | None = None) -> list[dict]:
    """Every link of the page with the part of the page it stands in, its kind (text, image, button) and the text of the
    block around it; anchor texts are whole unless limited."""
    from ..functions.urls import is_external
    from .nav import origin_of

    origin, out = origin_of(url), []
    for a in index.by_attribute.get("href", ()):
        if a.name != "a":
            continue
        place = next((p.name for p in a.ancestors() if p.name in ("nav", "header", "footer", "aside", "main")), "body")
        href = a.get("href")
        block = next((p for p in a.ancestors() if p.name not in _PHRASES), None)
        context = " ".join(block.text().split()) if block is not None and block.name not in _CONTAINERS else None
        out.append({"href": href, "anchor": a.text().strip()[:limit_label], "location": place, "rel": a.get("rel"), "target": a.get("target"), "is_external": is_external(href, origin), "context": context, "link_type": _link_type(a)})
    return out


def clean(root: Element, removed: tuple[str, ...] | list[str] = REMOVED) -> Element:
    """A copy of the body without what is never content, empty links included."""
    body = body_of(root).copy()
    strip(body, removed)
    for a in [e for e in body.elements() if e.name == "a" and not e.children]:
        a.remove()
    return body


def strip(body: Element, selectors) -> None:
    index = Index(body)
    for s in selectors:
        try:
            found = index.select(s)
        except ValueError:
            continue  # a configured selector of a kind this parser doesn't know removes nothing
        for e in found:
            e.remove()


def first_by(body: Element, selectors) -> Element | None:
    """First match of the first selector whose first match holds anything."""
    index = Index(body)
    for s in selectors:
        try:
            e = index.first(s)
        except ValueError:
            continue
        if e is not None and any(isinstance(c, Element) or c.strip() for c in e.children):
            return e
    return None


_GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"hidden|banner|combx|comment|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
_TAG_SCORE = {"div": 5, "article": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3, "li": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}


def link_density(e: Element) -> float:
    total = len(e.text())
    return sum(len(a.text()) for a in select(e, "a")) / total if total else 0.0


def readable(body: Element) -> Element | None:
    """The element whose paragraphs score best: every paragraph gives its parent points for length and commas and its
    grandparent half of them, names and links weigh in; siblings that score well are taken along."""
    scores: dict[int, float] = {}
    nodes: dict[int, Element] = {}

    def base(e: Element) -> float:
        names = f"{e.get('class') or ''} {e.get('id') or ''}"
        return _TAG_SCORE.get(e.name, 0) + 25 * bool(_GOOD.search(names)) - 25 * bool(_BAD.search(names))

    for p in body.elements():
        if p.name not in ("p", "pre", "td", "blockquote"):
            continue
        text = p.text().strip()
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        for e, share in zip(p.ancestors(), (1.0, 0.5, 1 / 6)):
            if e.name == "#root":
                break
            if id(e) not in scores:
                scores[id(e)], nodes[id(e)] = base(e), e
            scores[id(e)] += points * share
    if not scores:
        return None
    final = {k: s * (1 - link_density(nodes[k])) for k, s in scores.items()}
    best = max(final, key=lambda k: (final[k], -nodes[k].order))
    top = nodes[best]
    if top.parent is None:
        return top
    bar = max(10, final[best] * 0.2)
    out = Element("div", "", None, top.start, top.order)
    for e in top.parent.child_elements():
        keep = e is top or final.get(id(e), 0) >= bar
        if not keep and e.name == "p":
            text = e.text().strip()
            density = link_density(e)
            keep = len(text) > 80 and density < 0.25 or 0 < len(text) <= 80 and density == 0 and re.search(r"\.( |$)", text) is not None
        if keep:
            out.children.append(e)
    return out


def extract(root: Element, domain_selectors=None, remove_selectors=None, compat_clean: bool = False) -> tuple[Element, str]:
    """(content, method): domain selectors, then scoring, then semantic elements, then known systems, each if it has
    MIN_WORDS words; else the cleaned body. compat_clean leaves the page as it is instead of cleaning it first."""
    body = body_of(root).copy() if compat_clean else clean(root)
    if remove_selectors:
        strip(body, remove_selectors)
    if domain_selectors and (e := first_by(body, domain_selectors)) is not None and words_in(e) >= MIN_WORDS:
        return _inside(e), "cms_pattern"
    if (e := readable(body)) is not None and words_in(e) >= MIN_WORDS:
        return _inside(e), "readability"
    for selectors, method in ((SEMANTIC, "semantic"), (SYSTEMS, "cms_pattern")):
        if (e := first_by(body, selectors)) is not None and words_in(e) >= MIN_WORDS:
            return _inside(e), method
    return _inside(body), "fallback"


def _inside(e: Element) -> Element:
    """The element's content under a plain root, so that it serialises as inner HTML."""
    root = Element("#root", "", None, 0, 0)
    for c in e.children:
        if isinstance(c, Element):
            c = c.copy()
            c.parent = root
        root.children.append(c)
    return root


def junk_score(content: Element) -> float:
    """Share of the text that lies in links; 1 for no text."""
    total = len(content.text())
    if not total:
        return 1.0
    linked = sum(len(a.text()) for a in content.elements() if a.name == "a")
    return min(linked / total, 1.0)


def content_of(html: str, url: str, domain_selectors=None, remove_selectors=None) -> dict:
    """For one page by itself: clean_html, extraction_method, word_count, success."""
    if not html:
        return {"clean_html": "", "extraction_method": "fallback", "word_count": 0, "success": False}
    content, method = extract(parse(html), domain_selectors, remove_selectors)
    return {"clean_html": content.inner_html(), "extraction_method": method, "word_count": words_in(content), "success": True}
