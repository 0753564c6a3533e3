"""Element trees with offsets into their source, and CSS selectors over them."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

from .tokens import MAX_DEPTH, TOKEN, VOID, attributes_of, ended_by

RAW_TEXT = frozenset({"script", "style"})


class Element:
    __slots__ = ("name", "raw", "_attributes", "children", "parent", "start", "end", "order")

    def __init__(self, name: str, raw: str, parent: Element | None, start: int, order: int):
        self.name, self.raw, self.parent, self.start, self.end, self.order = name, raw, parent, start, start, order
        self._attributes: dict[str, str] | None = None
        self.children: list[Element | str] = []

    @property
    def attributes(self) -> dict[str, str]:
        if self._attributes is None:
            self._attributes = {k: entities.unescape(v) if "&" in v else v for k, v in attributes_of(self.raw).items()} if self.raw else {}
        return self._attributes

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attributes.get(name, default)

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def elements(self) -> Iterator[Element]:
        """Descendants in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def child_elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def text(self) -> str:
        parts: list[str] = []
        stack: list[Element | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def ancestors(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def outer_html(self) -> str:
        if self.name == "#root":
            return self.inner_html()
        attributes = "".join(f' {k}="{entities.escape(v)}"' for k, v in self.attributes.items())
        if self.name in VOID:
            return f"<{self.name}{attributes}>"
        return f"<{self.name}{attributes}>{self.inner_html()}</{self.name}>"

    def inner_html(self) -> str:
        if self.name in RAW_TEXT:
            return self.own_text()
        return "".join(c.outer_html() if isinstance(c, Element) else entities.escape(c, quote=False) for c in self.children)

    def copy(self) -> Element:
        new = Element(self.name, self.raw, None, self.start, self.order)
        new._attributes, new.end = self._attributes, self.end
        for c in self.children:
            if isinstance(c, Element):
                c = c.copy()
                c.parent = new
            new.children.append(c)
        return new


def parse(source: str) -> Element:
    """The tree under a root element. Comments and declarations are left out; end tags without a start are ignored."""
    root = Element("#root", "", None, 0, 0)
    names, nodes = ["#root"], [root]
    at = order = 0
    for m in TOKEN.finditer(source):
        start = m.start()
        if start > at:
            raw = source[at:start]
            nodes[-1].children.append(entities.unescape(raw) if "&" in raw else raw)
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                order += 1
                tag_end = source.index(">", start + len(m[1])) + 1
                close = source.rfind("</", start, at)
                inner = source[tag_end : close if close >= tag_end else at]
                # the start tag's own text, quotes with > in them included
                head = re.match(r"""<\w+((?:"[^"]*"|'[^']*'|[^"'>])*)>""", source[start:at])
                if head:
                    inner = source[start + head.end() : close if close >= start + head.end() else at]
                element = Element(m[1].lower(), head[1] if head else "", nodes[-1], start, order)
                element.end = at
                if inner:
                    element.children.append(inner)
                nodes[-1].children.append(element)
            continue
        name = name.lower()
        if m[2]:
            for k in range(len(names) - 1, 0, -1):
                if names[k] == name:
                    for node in nodes[k:]:
                        node.end = start
                    nodes[k].end = at
                    del names[k:], nodes[k:]
                    break
            continue
        keep = max(ended_by(name, names), 1)
        if keep < len(names):
            for node in nodes[keep:]:
                node.end = start
            del names[keep:], nodes[keep:]
        order += 1
        element = Element(name, m[4], nodes[-1], start, order)
        nodes[-1].children.append(element)
        if name in VOID or m[4].endswith("/") or len(names) >= MAX_DEPTH:
            element.end = at
        else:
            names.append(name)
            nodes.append(element)
    if at < len(source):
        raw = source[at:]
        nodes[-1].children.append(entities.unescape(raw) if "&" in raw else raw)
    for node in nodes:
        node.end = len(source)
    return root


def body_of(root: Element) -> Element:
    return next((e for e in root.elements() if e.name == "body"), root)


# ---- selectors

_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]]+))\s*([iI])?\s*)?\]|:(empty)""")


class Compound:
    """Conditions on one element."""

    __slots__ = ("tag", "id", "classes", "attributes", "empty")

    def __init__(self, text: str):
        self.tag = self.id = None
        self.classes: list[str] = []
        self.attributes: list[tuple[str, str, str, bool]] = []
        self.empty = False
        at = 0
        while at < len(text):
            m = _SIMPLE.match(text, at)
            if not m:
                raise ValueError(f"selector not understood: {text}")
            if m[1]:
                self.tag = None if m[1] == "*" else m[1].lower()
            elif m[2]:
                self.id = m[2]
            elif m[3]:
                self.classes.append(m[3])
            elif m[4]:
                value = m[6] if m[6] is not None else m[7] if m[7] is not None else m[8] or ""
                self.attributes.append((m[4].lower(), m[5] or "", value.lower() if m[9] else value, bool(m[9])))
            else:
                self.empty = True
            at = m.end()

    def matches(self, e: Element) -> bool:
        if self.tag and e.name != self.tag:
            return False
        if not (self.id or self.classes or self.attributes or self.empty):
            return True
        a = e.attributes
        if self.id and a.get("id") != self.id:
            return False
        if self.classes:
            own = a.get("class", "").split()
            if not all(c in own for c in self.classes):
                return False
        for name, how, value, fold in self.attributes:
            have = a.get(name)
            if have is None:
                return False
            if fold:
                have = have.lower()
            if how == "=" and have != value or how == "*=" and value not in have or how == "^=" and not have.startswith(value) or how == "$=" and not have.endswith(value) or how == "~=" and value not in have.split() or how == "|=" and have != value and not have.startswith(value + "-"):
                return False
        return not (self.empty and any(isinstance(c, Element) or c for c in e.children))


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[tuple[tuple[str, Compound], ...], ...]:
    """Per alternative the steps from left to right: (relation to the step before, compound)."""
    out = []
    for alternative in _split_list(selector):
        steps, relation = [], " "
        for part in re.findall(r"""(?:\[[^\]]*\]|[^\s>\[])+|>""", alternative):
            if part == ">":
                relation = ">"
            else:
                steps.append((relation, Compound(part)))
                relation = " "
        if not steps:
            raise ValueError(f"empty selector: {selector}")
        out.append(tuple(steps))
    return tuple(out)


def _split_list(selector: str) -> list[str]:
    return [s.strip() for s in re.split(r",(?![^\[]*\])", selector) if s.strip()]


def _fits(e: Element, steps, k: int, scope: Element) -> bool:
    relation, compound = steps[k]
    if not compound.matches(e):
        return False
    if k == 0:
        return relation != ">" or e.parent is scope
    if relation == ">":
        return e.parent is not None and e.parent is not scope and _fits(e.parent, steps, k - 1, scope)
    node = e.parent
    while node is not None and node is not scope:
        if _fits(node, steps, k - 1, scope):
            return True
        node = node.parent
    return False


class Index:
    """Elements below a scope by name, id, class and attribute, for many selectors over one tree."""

    def __init__(self, scope: Element):
        self.scope = scope
        self.all = list(scope.elements())
        self.by_name, self.by_id, self.by_class, self.by_attribute = (defaultdict(list) for _ in range(4))
        for e in self.all:
            self.by_name[e.name].append(e)
            if e.raw:
                for name, value in e.attributes.items():
                    self.by_attribute[name].append(e)
                    if name == "id":
                        self.by_id[value].append(e)
                    elif name == "class":
                        for c in set(value.split()):
                            self.by_class[c].append(e)

    def select(self, selector: str) -> list[Element]:
        """All matches in document order."""
        found: dict[int, Element] = {}
        for steps in compiled(selector):
            last = steps[-1][1]
            if last.id:
                pool = self.by_id.get(last.id, ())
            elif last.classes:
                pool = self.by_class.get(last.classes[0], ())
            elif last.attributes:
                pool = self.by_attribute.get(last.attributes[0][0], ())
            elif last.tag:
                pool = self.by_name.get(last.tag, ())
            else:
                pool = self.all
            for e in pool:
                if _fits(e, steps, len(steps) - 1, self.scope):
                    found[e.order] = e
        return [found[k] for k in sorted(found)]

    def first(self, selector: str) -> Element | None:
        found = self.select(selector)
        return found[0] if found else None


def select(scope: Element, selector: str) -> list[Element]:
    """Matches below one element. The tree is small: a walk, without an index."""
    ways = compiled(selector)
    return [e for e in scope.elements() if any(_fits(e, steps, len(steps) - 1, scope) for steps in ways)]


def closest(e: Element | None, selector: str, root: Element) -> Element | None:
    ways = compiled(selector)
    while e is not None and e is not root:
        if any(_fits(e, steps, len(steps) - 1, root) for steps in ways):
            return e
        e = e.parent
    return None
