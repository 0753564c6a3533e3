import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import split as S


def check(text, limit, overlap):
    pieces, big = S.split(text, limit, overlap)
    if not text:
        assert pieces == []
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][2] == len(text)
    assert "".join(text[n:e] for _, n, e in pieces) == text
    for (a, b) in zip(pieces, pieces[1:]):
        assert a[2] == b[1] and a[0] <= b[0] <= b[1] and a[2] - b[0] <= overlap
    assert all(0 < e - s <= limit for s, _, e in pieces)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#`-1)", max_size=600), st.integers(20, 120))
def test_pieces_give_the_text_back(text, limit):
    check(text, limit, limit // 4)


def test_natural_boundaries():
    text = "# A\n\n" + "One sentence here. " * 20 + "\n\n## B\n\n" + "Other words now. " * 20 + "\n\n## C\n\nshort"
    pieces = check(text, 500, 40)
    assert [text[n:e].lstrip()[:4] for _, n, e in pieces][:2] == ["# A\n", "## B"]
    assert all(b[1] - b[0] >= 40 - S.SLACK for b in pieces[1:])


def test_list_items_stay_with_what_is_nested_in_them():
    items = [f"- item {k}\n" + "".join(f"    - nested {k} {j}\n" for j in range(4)) for k in range(30)]
    pieces = check("".join(items), 300, 0)
    assert len(pieces) > 5 and all("".join(items)[n:e].startswith("- item") for _, n, e in pieces)
    rows = "| a | b |\n|---|---|\n" + "| 123 | 456 |\n" * 60
    assert all(rows[n:e].endswith("|\n") for _, n, e in check(rows, 300, 0))


def test_deep_nesting():
    text = "".join(" " * k + f"- {'x' * 30}\n" for k in range(3000))
    check(text, 4000, 200)


def test_blocks():
    text = "a \nb\n\n```\nx\n\ny\n```\nafter\n\n   \nlast\n```"
    got = [(text[s:e].strip(), n) for s, e, n, _ in S.blocks(text)]
    assert got == [("a \nb", 3), ("```\nx\n\ny\n```\nafter", 18), ("last\n```", 8)]
    assert S.blocks("") == [] and S.blocks("\n \n") == []


def brute_blocks(text):
    """By the letter of the definition, line by line."""
    lines = text.split("\n")
    marks = [i for i, x in enumerate(lines) if x.lstrip().startswith("```")]
    fenced = [False] * len(lines)
    for a, b in zip(marks[::2], marks[1::2]):
        for i in range(a, b + 1):
            fenced[i] = True
    out, run = [], []
    for i, x in enumerate(lines):
        if x.strip() or fenced[i]:
            run.append(x.rstrip())
        elif run:
            out.append(len("\n".join(run)))
            run = []
    return out + ([len("\n".join(run))] if run else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", " ", "a", "bb ", "```", "  ```py", "# h", "\t"]), max_size=14).map("\n".join))
def test_block_lengths_by_definition(text):
    assert [b[2] for b in S.blocks(text)] == brute_blocks(text)


def test_queries_on_rows(spark):
    big = "x" * 4001
    rows = [(1, f"intro\n\n{big}\n\nend", "p"), (2, None, "q"), (3, "", "r"), (4, "y" * 4000, "s"), (5, "word " * 60_000, "t"), (1, f"intro\n\n{big}\n\nend", "p")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")
    assert {tuple(r) for r in S.oversized_blocks(df, "id", "text").collect()} == {(1, 1, 4001), (5, 0, 299_999)}
    pieces = S.split_pieces(df, "id", "text", whole=True)
    assert {r["id"] for r in pieces.collect()} == {1, 4, 5} and pieces.filter("length(piece) > 4000").isEmpty()
    assert S.split_pieces(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        S.split("abc", 10, 10)
