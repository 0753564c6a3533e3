"""Tokens of HTML and the rules for end tags that are left out."""

from __future__ import annotations

import re

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^"'>])*"""

#: Comment, script or style with its text, declaration, or a tag as (slash, name, attributes).
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Elements nested deeper than this lie beside each other.
MAX_DEPTH = 256

#: Open elements that a start tag ends, and the elements that shield those further out.
IMPLIED_END = {
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "tr": (frozenset({"tr", "td", "th", "p", "li"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p", "li"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "p", "li"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}), frozenset({"table"})),
}
_PARAGRAPH_SHIELD = frozenset({"table", "td", "th", "button", "caption", "object"})


def ended_by(name: str, open_names: list[str]) -> int:
    """Length to which the stack of open elements shrinks when the start tag `name` comes."""
    n = len(open_names)
    if name in IMPLIED_END:
        ends, shield = IMPLIED_END[name]
        keep = n
        for k in range(n - 1, -1, -1):
            if open_names[k] in shield:
                break
            if open_names[k] in ends:
                keep = k
        return keep
    if name in CLOSES_PARAGRAPH:
        for k in range(n - 1, -1, -1):
            if open_names[k] == "p":
                return k
            if open_names[k] in _PARAGRAPH_SHIELD:
                break
    return n


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of equal names counts. Values are raw."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    return found
