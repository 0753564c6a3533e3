from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.operators.links import headings, links_with_context


def one(spark, function, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(function(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


LONG = "A" * 60


def test_lines_and_headings(spark):
    assert one(spark, X.deduplicate_lines, "a\n a \n\na\nb\na") == "a\n\nb\na"
    assert one(spark, X.deduplicate_lines, "") == ""
    assert one(spark, X.normalize_headings, "# A\n### B\n###### C\n# D\ntext") == "# A\n## B\n### C\n# D\ntext"
    assert one(spark, X.shift_headings, "# A\n###### F\n##B\n## C") == "## A\n###### F\n##B\n### C"
    assert one(spark, lambda c: X.shift_headings(c, True), "# A\n# B") == "# A\n## B"
    assert tuple(one(spark, X.first_h1, "x\n# Head \n# Two")) == (True, 1, "Head")
    assert tuple(one(spark, X.first_h1, "x")) == (False, -1, None)


def test_h1_in_front(spark):
    assert one(spark, X.ensure_h1, "# A\n\ntext", "A") == "# A\n\ntext"
    assert one(spark, X.ensure_h1, "intro\n\n# Other\n\ntext", "A") == "# A\n\nintro\n\n\ntext"
    assert one(spark, X.h1_issue, "intro\n# A") == "H1 at line 2 instead of line 1"
    assert one(spark, X.h1_issue, "# A") is None


def test_boilerplate_images_and_plain_text(spark):
    assert one(spark, X.remove_boilerplate, "Home > x > y\nPosted on May 1 by me\n© 2024 Us\nCOPYRIGHT © 2023 X\nlast updated: today\nkept") == "\n\n\n\n\nkept"
    assert one(spark, X.strip_base64_images, f"![a](data:image/png;base64,{LONG})![](data:image/png;base64,{LONG})![b](https://x/y;base64,{LONG})") == "![a](data:image/png;base64,...)![b](embedded-base64-removed)"
    assert one(spark, X.markdown_to_text, "# T\n\n- **b** *i* `c` [l](u) ![a](u)\n```\ncode\n```") == "T\n\nb i  l !a"
    assert one(spark, X.strip_markers, "<!-- STRUCT:FAQ:START -->\nq\n\n\n\n<!-- STRUCT:FAQ:END -->") == "q"
    assert one(spark, X.postprocess_enhanced, "<!-- STRUCT:FAQ:START -->\n\nq\n\n<!-- STRUCT:FAQ:END -->") == "<!-- STRUCT:FAQ:START -->\nq\n<!-- STRUCT:FAQ:END -->"


def test_hashes_and_counts(spark):
    a, b = one(spark, X.content_hash, " a  b "), one(spark, X.content_hash, "a b")
    assert a == b and one(spark, X.content_hash, "") == "" and one(spark, X.content_hash, None) == ""
    assert one(spark, X.hashes_match, "", "") is False and one(spark, X.hashes_match, "x", "x") is True
    assert one(spark, X.word_count, "<p>a b</p><i>c</i>") == 3 and one(spark, X.word_count, None) == 0
    assert one(spark, X.falsy_null, "0") is None and one(spark, X.falsy_null, "") is None and one(spark, X.falsy_null, "x") == "x"


def test_links_in_context(spark):
    text = "# Top\n[a](/a) and ![i](/i.png)\n<!-- STRUCT:FAQ:START -->\n## Q\n[b](/b)\n<!-- STRUCT:FAQ:END -->\n[c](/c)"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "id long, t string, label string")
    rows = [tuple(r) for r in links_with_context(df, "id", "t").orderBy("link_no").collect()]
    assert rows == [(1, 0, "/a", "a", "contextual_body", "Top", 6), (1, 1, "/i.png", "i", "contextual_body", "Top", 6), (1, 2, "/b", "b", "faq_module", "Q", 62), (1, 3, "/c", "c", "contextual_body", "Q", 94)]
    assert headings(df, "id", "t").count() == 2
    assert links_with_context(df.limit(0), "id", "t").count() == 0


def test_soft_404(spark):
    df = spark.createDataFrame([("Page not found", "x", 5), ("Fine", "Sorry, this page was not found", 10), ("404", "x", 500), (None, None, None)], "t string, b string, w int")
    assert [r[0] for r in df.select(X.soft_404(F.col("t"), F.col("b"), F.col("w"))).collect()] == [True, True, False, False]
