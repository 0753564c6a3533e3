"""Menus, utility and language links, breadcrumbs and content links of a page."""

from __future__ import annotations

import re

from ..functions.text import SOURCE_OF
from ..functions.urls import is_external, is_utility, normalize_link, split_url
from . import structure
from .tree import Element, Index, closest, select

# Where each part of the navigation is looked for: selectors in order of preference (fixed values).
PRIMARY = (
    "#p-nav ul#nav", "#p-nav > ul", "#nav", "#main-nav ul", "ul#nav", "nav#primary-navigation ul", "nav.main-navigation ul", "#main-menu > ul", "#main-menu ul.menu", "#p-nav ul.menu",
    "header nav > ul", "header nav ul", 'nav[role="navigation"] > ul', 'nav[role="navigation"] ul', '[role="navigation"] ul.menu', "ul#nav.menu", "ul.nav-menu", "ul.main-menu",
    ".navbar ul.navbar-nav", ".elementor-nav-menu", '[data-elementor-type="header"] nav ul', "header ul.menu", "#header ul.menu",
)
FOOTER = (
    "footer nav ul", "footer ul.menu", "footer ul", "#footer nav ul", "#footer ul.menu", "#footer ul", "#site-footer ul", "#footer-menu ul", ".footer nav ul", ".footer ul.menu",
    ".footer-nav ul", ".site-footer ul", '[data-elementor-type="footer"] nav ul', "footer .widget ul",
)
FOOTER_PLACES = ("footer", "#footer", ".footer", "#site-footer", ".site-footer")
UTILITY = ("#mobile-icons", ".header-contact", ".top-bar", ".utility-nav", ".header-social", "#d-social", ".contact-icons", ".social-icons", ".header-icons")
LANGUAGE = ("#lang-option", ".lang-switcher", ".wpml-ls", ".wpml-ls-legacy-dropdown", ".polylang-switcher", ".language-switcher", ".qtranxs-lang-menu", '[class*="lang-"]')
BREADCRUMBS = (".breadcrumb", ".breadcrumbs", '[aria-label="breadcrumb"]', ".yoast-breadcrumb", ".rank-math-breadcrumb", '[typeof="BreadcrumbList"]', ".woocommerce-breadcrumb", "#breadcrumbs", ".breadcrumb-trail")
MAIN = ("main", "#main-content", "#content", ".content", "article", ".entry-content", ".post-content", ".page-content", '[role="main"]')
NOT_CONTENT = "header, nav, footer, .navigation, .nav-menu, .menu, .sidebar, .widget, #header, #footer, #sidebar"
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SEPARATORS = re.compile(r"[>/»›|]")


def origin_of(url: str) -> str:
    parts = split_url(url) if re.match(r"https?:", url or "", re.I) else None
    return f"{parts[0]}://{parts[2]}{':' + parts[3] if parts[3] else ''}" if parts else url or ""


def _item(url, label, depth, order, external, kind="text", parents=None) -> dict:
    return {"url": url, "label": label, "depth": depth, "sort_order": order, "parent_labels": parents, "is_external": external, "link_type": kind}


def _label(a: Element) -> str:
    return a.own_text().strip() or a.text().strip()


def _submenus(li: Element) -> list[Element]:
    return [c for c in li.child_elements() if c.name == "ul"]


def menu_items(menu: Element, origin: str, compat: bool) -> list[dict]:
    """Items of a list in order, submenus after their parent, four levels at most."""
    direct = [c for c in menu.child_elements() if c.name == "li"]
    items: list[dict] = []
    if direct and any(p.name == "li" for p in menu.ancestors()):
        return items  # a submenu, not a menu

    def walk(entries: list[Element], parents: list[str], depth: int) -> None:
        for k, li in enumerate(entries):
            inside = li.child_elements()
            link = next((c for c in inside if c.name == "a"), None)
            if link is None and depth == 0:
                link = next((g for c in inside if c.name == "span" for g in c.child_elements() if g.name == "a"), None)
            if link is None:
                continue
            href, label = link.get("href") or "", _label(link)
            below = _submenus(li)
            if depth == 0 and not below:
                below = [c for c in inside if "sub-menu" in c.classes]
            idle = not href or href == "#" or href.startswith("javascript:")
            if not label or idle and (depth or not below):
                continue
            url = normalize_link(href, origin) if href and href != "#" else "#"
            items.append(_item(url, label, depth, k if depth else len(items), is_external(href, origin), "image" if select(link, "img") else "text", list(parents) if depth else None))
            if below and depth < 3:
                walk([c for c in below[0].child_elements() if c.name == "li"], [*parents, label], depth + 1)

    walk(direct or [e for e in menu.elements() if e.name == "li"], [], 0)
    return items


def primary_nav(index: Index, origin: str, compat: bool = False) -> tuple[list[dict], str | None]:
    for selector in PRIMARY:
        menu = index.first(selector)
        if menu is None:
            continue
        items = menu_items(menu, origin, compat)
        clean = [i for i in items if not is_utility(i["url"], compat)]
        if sum(not i["is_external"] for i in items) >= 3 and len(clean) >= 3:
            return clean, selector
    menu = index.first("ul.menu, nav ul")
    if menu is not None:
        clean = [i for i in menu_items(menu, origin, compat) if not i["is_external"] and not is_utility(i["url"], compat)]
        if len(clean) >= 3:
            return clean, "ul.menu (fallback)"
    return [], None


def footer_nav(index: Index, origin: str, compat: bool = False) -> tuple[list[dict], str | None]:
    for selector in FOOTER:
        menu = index.first(selector)
        if menu is not None and len(items := menu_items(menu, origin, compat)) >= 2:
            return items, selector
    for place in FOOTER_PLACES:
        footer = index.first(place)
        if footer is None:
            continue
        items: dict[str, dict] = {}
        for a in select(footer, "a[href]"):
            href, label = a.get("href") or "", a.text().strip()
            if href and label and not is_utility(href, compat):
                url = normalize_link(href, origin)
                if url not in items:
                    items[url] = _item(url, label, 0, len(items), is_external(href, origin))
        if len(items) >= 2:
            return list(items.values())[:20], f"{place} (fallback)"
    return [], None


def utility_links(index: Index, origin: str, compat: bool = False) -> tuple[list[dict], str | None]:
    items: dict[str, dict] = {}
    used = None
    for selector in UTILITY:
        for place in index.select(selector):
            for a in select(place, "a[href]"):
                href = a.get("href") or ""
                if not href or href in items or not (is_utility(href, compat) or is_external(href, origin)):
                    continue
                image = next((e.get("alt") for e in select(a, "img")), None)
                items[href] = _item(href, a.text().strip() or image or "[icon]", 0, len(items), is_external(href, origin), "icon" if select(a, "img, svg, i, .fa, .fas, .fab") else "text")
                used = used or selector
    for a in index.select('header a[href^="tel:"], header a[href^="mailto:"]'):
        href = a.get("href")
        if href not in items:
            items[href] = _item(href, a.text().strip() or re.sub(r"^(tel:|mailto:)", "", href), 0, len(items), False)
    return list(items.values()), used


def language_switcher(index: Index, origin: str) -> tuple[list[dict], str | None]:
    for selector in LANGUAGE:
        items, k = [], -1
        for place in index.select(selector):
            for a in select(place, "a[href]"):
                k += 1
                href = a.get("href") or ""
                label = a.text().strip() or (a.get("hreflang") or "").upper()
                if not label and (m := re.search(r"lang[_-]([a-z]{2})", a.get("class") or "", re.I)):
                    label = m[1].upper()
                if href and label and len(label) <= 10:
                    items.append(_item(normalize_link(href, origin), label, 0, k, False))
        if 2 <= len(items) <= 10:
            return items, selector
    return [], None


def breadcrumb_trail(index: Index) -> list[dict]:
    for selector in BREADCRUMBS:
        place = index.first(selector)
        if place is None:
            continue
        items: dict[str, str | None] = {}
        for e in select(place, "a, span"):
            text = e.text().strip()
            if not text or len(text) > 100 or not _SEPARATORS.sub("", text):
                continue
            if e.parent is not None and e.parent.name in ("a", "span") and e.parent.text().strip() == text:
                continue
            items.setdefault(text, e.get("href") or None if e.name == "a" else None)
        if len(items) >= 2:
            return [{"label": k, "url": v} for k, v in items.items()]
        parts = [p.strip() for p in _SEPARATORS.split(place.text()) if p.strip()]
        if len(parts) >= 2:
            return [{"label": p, "url": None} for p in parts]
    return []


def _heading_before(e: Element) -> str | None:
    """The nearest heading among an element's earlier siblings."""
    if e.parent is None:
        return None
    found = None
    for c in e.parent.children:
        if c is e:
            break
        if isinstance(c, Element) and c.name in _HEADINGS:
            found = c
    return found.text().strip() if found is not None else None


def content_links(index: Index, origin: str, blocks: list[dict]) -> list[dict]:
    """Links of the main part, each URL once, with the kind of block they stand in and the heading above them.

    A heading stays the current one until another is found near a link.
    """
    root = index.scope
    main = next((e for s in MAIN if (e := index.first(s)) is not None), None) or index.first("body") or root
    links = select(main, "a[href]")
    out: dict[str, dict] = {}
    heading = None
    for k, a in enumerate(links):
        href = a.get("href") or ""
        if not href or href == "#" or href.startswith("javascript:") or closest(a, NOT_CONTENT, root) is not None:
            continue
        label = a.text().strip() or next((e.get("alt") or "" for e in select(a, "img")), "")
        url = normalize_link(href, origin)
        if not label or url in out:
            continue
        kind = SOURCE_OF.get(structure.kind_at(a.start, blocks) or "", "contextual_body")
        if href.startswith("#") or "#" in href and href.startswith(origin):
            kind = "toc_or_jump"
        found = _heading_before(a)
        if found is None and a.parent is not None and a.parent is not root:
            found = _heading_before(a.parent)
        heading = found if found is not None else heading
        out[url] = {"url": url, "label": label, "source_type": kind, "nearest_heading": heading or None, "body_position_pct": int(k * 100 / max(len(links), 1) + 0.5), "is_external": is_external(href, origin)}
    return list(out.values())


def nav_structure(index: Index, url: str, blocks: list[dict], compat: bool = False) -> dict:
    """All parts together. extraction_time_ms is null: a time is no property of a page."""
    origin = origin_of(url)
    primary, primary_selector = primary_nav(index, origin, compat)
    footer, footer_selector = footer_nav(index, origin, compat)
    utility, _ = utility_links(index, origin, compat)
    languages, _ = language_switcher(index, origin)
    return {
        "primary_nav": primary,
        "footer_nav": footer,
        "utility_header": utility,
        "language_switcher": languages,
        "breadcrumb": breadcrumb_trail(index),
        "content_links": content_links(index, origin, blocks),
        "structural_stats": structure.statistics(blocks),
        "extraction_meta": {
            "clusters_found": sum(bool(x) for x in (primary, footer, utility, languages)),
            "primary_nav_selector": primary_selector,
            "footer_nav_selector": footer_selector,
            "has_mega_menu": any(i["depth"] >= 2 for i in primary),
            "extraction_time_ms": None,
        },
    }
