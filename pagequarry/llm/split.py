"""Splitting long texts at natural boundaries by structure-tree packing.

A text is parsed into a tree: sections by heading level, blocks (runs of non-blank lines; a fenced part is never
cut apart while it fits), list items with what is nested in them, lines (rows of tables among them), sentences, words,
characters. Sibling subtrees are merged bottom-up up to the
limit; only a node that exceeds it is descended into. Pieces are spans of the text, so that the pieces without
their overlaps give the text back exactly.

Defined results: null texts and texts within the limit give one piece (none for null or empty ones) in
`split_pieces` with whole=True and no row otherwise; repeated rows give repeated pieces; texts without any white
space are cut between characters. Extra columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: How many characters an overlap may be short of the given one to start at a boundary.
SLACK = 60

_HEADING = re.compile(r"\s{0,3}(#{1,6})\s")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'»”’)\]]*\s+|(?<=[。！？])")
_WORD = re.compile(r"\s+")


class Node:
    __slots__ = ("start", "end", "kind", "children", "block_no")

    def __init__(self, start: int, end: int, kind: str, block_no: int = -1):
        self.start, self.end, self.kind, self.block_no = start, end, kind, block_no
        self.children: list[Node] = []


def blocks(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end with the blank lines after it, length, heading level or 0) of each block.

    A block is a longest run of non-blank lines; from a line that starts, after spaces, with three backticks
    to the next such line everything belongs to one block. A fence that nothing closes is an ordinary line.
    Length is that of the lines without their white space at the end, joined by line feeds.
    """
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    fences = [i for i, (_, line) in enumerate(lines) if line.lstrip().startswith("```")]
    closing = {a: b for a, b in zip(fences[::2], fences[1::2])}
    found: list[list[int]] = []
    i, open_block = 0, False
    while i < len(lines):
        start, line = lines[i]
        if i in closing:
            last = closing[i]
            length = sum(len(lines[k][1].rstrip()) + 1 for k in range(i, last + 1)) - 1
        elif line.strip():
            last, length = i, len(line.rstrip())
        else:
            open_block, i = False, i + 1
            continue
        if open_block:
            found[-1][2] += 1 + length
        else:
            m = _HEADING.match(line) if i not in closing else None
            found.append([start, 0, length, len(m[1]) if m else 0])
        open_block, i = True, last + 1
    for k, block in enumerate(found):
        block[1] = found[k + 1][0] if k + 1 < len(found) else len(text)
    if found:
        found[0][0] = 0
    return [tuple(b) for b in found]


def _cut(node: Node, text: str, pattern: re.Pattern | None, kind: str) -> None:
    """Children of node that end where pattern's matches end."""
    at = node.start
    for m in pattern.finditer(text, node.start, node.end):
        if m.end() > at:
            node.children.append(Node(at, m.end(), kind))
            at = m.end()
    if at < node.end:
        node.children.append(Node(at, node.end, kind))


_LINE_END = re.compile(r"\n")
_MARKER = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,3}[.)])\s", re.M)
#: Nested items below this level are cut by lines.
MAX_NESTING = 40


def _cut_items(node: Node, text: str) -> None:
    """Children of a list: its items, or those nested in an item, each with all that is indented below it."""
    marks = [(m.start(), len(m[1].expandtabs(4))) for m in _MARKER.finditer(text, node.start, node.end) if m.start() > node.start or node.kind == "block"]
    if not marks:
        return
    least = min(indent for _, indent in marks)
    starts = [at for at, indent in marks if indent == least and at > node.start]
    if starts:
        bounds = [node.start, *starts, node.end]
        node.children = [Node(a, b, "item") for a, b in zip(bounds, bounds[1:])]


_FINER = {"block": ("line", _LINE_END), "item": ("line", _LINE_END), "line": ("sentence", _SENTENCE), "sentence": ("word", _WORD)}


def tree(text: str) -> tuple[Node, list[int]]:
    """The root and the blocks' lengths."""
    root = Node(0, len(text), "section")
    lengths = []
    open_sections: list[tuple[int, Node]] = [(0, root)]
    for k, (start, end, length, level) in enumerate(blocks(text)):
        lengths.append(length)
        if level:
            while open_sections[-1][0] >= level:
                open_sections.pop()[1].end = start
            section = Node(start, len(text), "section")
            open_sections[-1][1].children.append(section)
            open_sections.append((level, section))
        open_sections[-1][1].children.append(Node(start, end, "block", k))
    for _, section in open_sections:
        section.end = len(text)
    return root, lengths


def pack(node: Node, text: str, budget: int, descended: list[int], nesting: int = 0) -> list[tuple[int, int]]:
    """Spans of at most budget characters that cover node; descended gets the numbers of the blocks cut open."""
    if node.end - node.start <= budget:
        return [(node.start, node.end)]
    if node.kind == "block":
        descended.append(node.block_no)
    if node.kind in ("block", "item") and nesting < MAX_NESTING:
        _cut_items(node, text)
    if not node.children and node.kind in _FINER:
        kind, pattern = _FINER[node.kind]
        _cut(node, text, pattern, kind)
        if len(node.children) == 1:
            node.children[0].kind = kind
    if not node.children:
        return [(a, min(a + budget, node.end)) for a in range(node.start, node.end, budget)]
    parts: list[tuple[int, int]] = []
    for child in node.children:
        for span in pack(child, text, budget, descended, nesting + (child.kind == "item")):
            if parts and span[1] - parts[-1][0] <= budget:
                parts[-1] = (parts[-1][0], span[1])
            else:
                parts.append(span)
    return parts


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Pieces (start, start of what is new, end) and the blocks (number, length) longer than limit by themselves."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    if len(text) <= limit:
        return ([(0, 0, len(text))] if text else []), []
    descended: list[int] = []
    root, lengths = tree(text)
    spans = pack(root, text, limit - overlap, descended)
    pieces, before = [], 0
    for k, (a, b) in enumerate(spans):
        start = a
        if k:
            start = max(before, a - overlap)
            m = _WORD.search(text, start, min(start + SLACK, a))
            if m and start > before and not text[start - 1].isspace() and m.end() < a:
                start = m.end()
        pieces.append((start, a, b))
        before = start
    return pieces, [(n, lengths[n]) for n in descended if lengths[n] > limit]


def split_pieces(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False) -> DataFrame:
    """id, piece_no, char_start, new_from, char_end, piece: ordered pieces of at most limit characters.

    char_start..new_from repeats the end of the piece before. Texts within the limit appear only with whole.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not whole:
        texts = texts.filter(F.length("text") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                if text:
                    rows += [(i, k, a, n, b, text[a:b]) for k, (a, n, b) in enumerate(split(text, limit, overlap)[0])]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "char_start", "new_from", "char_end", "piece"])

    kind = df.schema[id_col].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, piece_no int, char_start int, new_from int, char_end int, piece string")


def oversized_blocks(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, block_no, n_chars: the blocks that packing had to cut open because they exceed limit by themselves."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, size) for i, text in zip(batch["id"], batch["text"]) for n, size in split(text, limit, overlap)[1]]
            yield pd.DataFrame(rows, columns=["id", "block_no", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, block_no int, n_chars int")
