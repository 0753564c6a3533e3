"""Markdown of element trees, with or without markers around structural blocks."""

from __future__ import annotations

import re

from ..functions.text import MARKER_OF
from ..functions.urls import resolve_one
from .tree import Element, select

_BLOCKS = frozenset("address article aside blockquote body canvas center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav noscript ol output p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIPPED = frozenset({"script", "style", "head", "title", "meta", "link", "noscript", "template"})
_SPACE = re.compile(r"[ \t\r\n\f]+")
_ESCAPED = [(re.compile(p), r) for p, r in (
    (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "), (r"`", r"\\`"), (r"^~~~", r"\\~~~"),
    (r"\[", r"\\["), (r"\]", r"\\]"), (r"^>", r"\\>"), (r"_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "),
)]
_QUESTION_MARK, _ANSWER_MARK = "<!-- STRUCT:FAQ:Q -->", "<!-- STRUCT:FAQ:A -->"


def marker(kind: str, end: bool = False) -> str:
    return f"<!-- STRUCT:{MARKER_OF[kind]}:{'END' if end else 'START'} -->"


class Renderer:
    """base: URL that links are made absolute against. marks: kind of block by the id of its element. With marks,
    question and answer parts are tagged. smart_lists drops lists that are mostly links."""

    def __init__(self, base: str | None = None, marks: dict[int, list[str]] | None = None, smart_lists: bool = False):
        self.base, self.marks, self.smart_lists = base, marks, smart_lists

    def render(self, root: Element) -> str:
        text = self.children(root, False)
        return re.sub(r"^[\t\r\n]+|[\t\r\n\s]+$", "", text)

    def absolute(self, link: str) -> str:
        if not self.base:
            return link
        return resolve_one(link, self.base) or link

    def children(self, e: Element, code: bool) -> str:
        out = ""
        for child in e.children:
            if isinstance(child, str):
                if code:
                    out += child
                    continue
                text = _SPACE.sub(" ", child)
                # white space beside blocks is none
                if not out or out.endswith(("\n", " ")):
                    text = text.lstrip(" ")
                if text:
                    for pattern, replacement in _ESCAPED:
                        text = pattern.sub(replacement, text)
                    out += text
                continue
            piece = self.element(child, code)
            if not piece:
                continue
            if child.name in _BLOCKS or self.marked(child) or child.name == "br":
                out = _joined(out.rstrip(" "), piece)
            else:
                out += piece if not (out.endswith((" ", "\n")) and piece.startswith(" ")) else piece[1:]
        return out

    def marked(self, e: Element) -> list[str]:
        return self.marks.get(id(e), []) if self.marks else []

    def element(self, e: Element, code: bool) -> str:
        name = e.name
        if name in _SKIPPED:
            return ""
        text = self.plain(e, code)
        for kind in self.marked(e):
            text = f"\n\n{marker(kind)}\n{text.strip()}\n{marker(kind, True)}\n\n"
        return text

    def plain(self, e: Element, code: bool) -> str:
        name = e.name
        if self.marks is not None and not code:
            classes, part = " ".join(e.classes), e.get("itemprop") if e.raw else None
            if "answer" in classes or part in ("acceptedAnswer", "text"):
                return f"\n\n{_ANSWER_MARK}{self.children(e, code).strip()}\n\n"
            if "question" in classes or part == "name":
                return f"\n\n{_QUESTION_MARK}{self.children(e, code).strip()}\n\n"
        if name == "a":
            return self.link(e, code)
        if name == "img":
            return self.image(e)
        if name == "br":
            return "  \n"
        if name == "hr":
            return "\n\n---\n\n"
        if name == "pre":
            return self.code_block(e)
        if name in ("ul", "ol") and self.smart_lists:
            entries = select(e, "li")
            if entries and len(select(e, "a")) / len(entries) > 0.8:
                return ""
        inside = self.children(e, code or name in ("code", "kbd", "samp"))
        if name in ("code", "kbd", "samp", "tt"):
            return _code_span(inside)
        if not inside.strip():
            return "" if name in _BLOCKS else inside
        if name in ("em", "i"):
            return _wrapped(inside, "*")
        if name in ("strong", "b"):
            return _wrapped(inside, "**")
        if re.fullmatch("h[1-6]", name):
            return f"\n\n{'#' * int(name[1])} {inside.strip()}\n\n"
        if name == "blockquote":
            body = re.sub(r"^\n+|\n+$", "", inside)
            return "\n\n" + "\n".join("> " + line if line else ">" for line in body.split("\n")) + "\n\n"
        if name in ("ul", "ol"):
            nested = e.parent is not None and e.parent.name == "li"
            return ("\n" if nested else "\n\n") + inside.strip("\n") + ("" if nested else "\n\n")
        if name == "li":
            return self.entry(e, inside)
        if name in _BLOCKS:
            return f"\n\n{inside.strip()}\n\n"
        return inside

    def entry(self, e: Element, inside: str) -> str:
        body = re.sub(r"\n", "\n    ", inside.strip("\n").rstrip())
        lead = "-   "
        if e.parent is not None and e.parent.name == "ol":
            start = e.parent.get("start") if e.parent.raw else None
            place = [c for c in e.parent.child_elements() if c.name == "li"].index(e)
            lead = f"{(int(start) if start and start.lstrip('-').isdigit() else 1) + place}.  "
        return f"{lead}{body.lstrip()}\n"

    def link(self, e: Element, code: bool) -> str:
        href = e.get("href")
        inside = self.children(e, code)
        if not e.text().strip() and not select(e, "img"):
            return ""
        return f"[{inside.strip()}]({self.absolute(href)})" if href else inside

    def image(self, e: Element) -> str:
        source, alt = e.get("src"), _SPACE.sub(" ", e.get("alt") or "")
        if not source:
            return ""
        if source.startswith("data:image/"):
            kind = re.match(r"data:image/(\w+)", source)
            return f"![{alt}](data:image/{kind[1] if kind else 'unknown'};base64,...)" if alt else ""
        return f"![{alt}]({self.absolute(source)})"

    def code_block(self, e: Element) -> str:
        inner = next((c for c in e.child_elements() if c.name == "code"), None)
        language = re.search(r"language-(\S+)", (inner.get("class") or "") if inner is not None else "")
        text = e.text().rstrip("\n")
        fence = "```"
        while fence in text:
            fence += "`"
        return f"\n\n{fence}{language[1] if language else ''}\n{text}\n{fence}\n\n"


def _wrapped(text: str, mark: str) -> str:
    core = text.strip()
    before, after = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{before and ' '}{mark}{core}{mark}{after and ' '}"


def _code_span(text: str) -> str:
    text = _SPACE.sub(" ", text)
    if not text.strip():
        return ""
    mark = "`"
    while mark in text:
        mark += "`"
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{mark}{pad}{text}{pad}{mark}"


def _joined(before: str, piece: str) -> str:
    """Two pieces with as many line feeds between them as the one that wants more, two at most."""
    head, tail = before.rstrip("\n"), piece.lstrip("\n")
    feeds = min(2, max(len(before) - len(head), len(piece) - len(tail)))
    return head + ("\n" * feeds if head else "") + tail


_EMBEDDED = re.compile(r"!\[([^\]]*)\]\(data:image/(\w+);base64,[A-Za-z0-9+/=]{50,}\)")
_SMUGGLED = re.compile(r"!\[([^\]]*)\]\([^)]*;base64,[A-Za-z0-9+/=]{50,}\)")


def tidy(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(r"(<!-- STRUCT:[A-Z_]+:START -->\n)\n", r"\1", text)
    text = re.sub(r"\n(\n<!-- STRUCT:[A-Z_]+:END -->)", r"\1", text)
    text = _EMBEDDED.sub(lambda m: f"![{m[1]}](data:image/{m[2]};base64,...)" if m[1] else "", text)
    return _SMUGGLED.sub(lambda m: f"![{m[1]}](embedded-base64-removed)" if m[1] else "", text).strip()


def enhanced_markdown(content: Element, blocks: list[dict], base: str | None, h1: str | None) -> str:
    """Markdown with markers around blocks (found in the same tree), the page heading in front."""
    marks: dict[int, list[str]] = {}
    for b in blocks:
        marks.setdefault(id(b["element"]), []).append(b["type"])
    text = tidy(Renderer(base, marks).render(content))
    return f"# {h1.strip()}\n\n{text}" if h1 else text


def plain_markdown(text: str) -> str:
    """Enhanced Markdown without its markers."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"<!-- STRUCT:[A-Z_]+:[A-Z_]+ -->", "", text).strip()).strip()


def markdown(content: Element, base: str | None = None) -> str:
    """Plain Markdown; lists that are mostly links are left out."""
    return Renderer(base, None, True).render(content)
