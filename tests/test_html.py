import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.html import content, nav, structure
from pagequarry.html.markdown import enhanced_markdown, markdown, plain_markdown
from pagequarry.html.tree import Index, compiled, parse, select
from pagequarry.operators.pages import parse_pages, process

BASE = "https://a.example/x/y"
WORDS = " ".join(f"word{k}" for k in range(120))


def index(html):
    return Index(parse(html))


def test_soup():
    root = parse("<body><p>one<p>two <b>bold<div>three</div><!-- <p>no</p> --><script>var a='</p><p>';</script><ul><li>a<li>b</ul>tail")
    names = [e.name for e in root.elements()]
    assert names == ["body", "p", "p", "b", "div", "script", "ul", "li", "li"]
    assert [e.text() for e in root.elements() if e.name in ("p", "li")] == ["one", "two bold", "a", "b"]
    assert parse("").text() == "" and parse("<").text() == "<"
    quoted = parse('<a title="x > y" href=/z>t</a>')
    assert quoted.child_elements()[0].get("title") == "x > y" and quoted.child_elements()[0].get("href") == "/z"


def test_very_deep_pages():
    out = process("<div>" * 30_000 + "deep" + "</div>" * 30_000 + "<p> after", BASE)
    assert out["word_count"] == 2 and out["markdown"] == "deep\n\nafter"


def test_offsets_point_into_the_source():
    html = '<div><p class="k">a</p> <p class="k">a</p></div>'
    for e in index(html).select(".k"):
        assert html[e.start : e.end] == '<p class="k">a</p>'


@pytest.mark.parametrize(
    ("selector", "ids"),
    [("li", "23"), ("ul > li", "23"), ("div li", "23"), ("#1 .k", "4"), (".k.m", "4"), ('[data-x="v"]', "3"), ('[data-x*="V" i]', "3"), ('[class^="k"]', "4"), ("li, .m", "234"), ("span:empty", "5"), ("body > li", ""), ('div[id="1"] > ul > li', "23")],
)
def test_selectors(selector, ids):
    html = '<body><div id="1"><ul><li id="2">a</li><li id="3" data-x="v">b</li></ul><p id="4" class="k m">c</p><span id="5"></span></div></body>'
    assert "".join(e.get("id") for e in index(html).select(selector)) == ids
    with pytest.raises(ValueError):
        compiled("a:hover")


def test_metadata_by_preference():
    full = '<html lang=" en "><title> T </title><meta name="description" content=" d "><meta property="og:image" content="/i.png"><link rel="canonical" href="/c"><h1>H <b>1</b></h1>'
    assert content.metadata(index(full), BASE) == {"title": "T", "h1": "H 1", "meta_description": "d", "canonical_url": "https://a.example/c", "og_image": "https://a.example/i.png", "language": "en"}
    second = '<meta property="og:title" content="O"><meta property="og:description" content="D"><meta http-equiv="content-language" content="fr">'
    got = content.metadata(index(second), BASE)
    assert (got["title"], got["meta_description"], got["language"], got["h1"]) == ("O", "D", "fr", None)
    assert content.metadata(index("<h1>" + "x" * 600 + "</h1>"), BASE)["h1"] == "x" * 500
    assert set(content.metadata(index(""), None).values()) == {None}


@pytest.mark.parametrize(
    ("html", "method"),
    [
        (f"<body><article><p>{WORDS}</p></article></body>", "readability"),
        (f"<body><article>{WORDS}</article></body>", "semantic"),
        (f"<body><div class='post-content'>{WORDS}</div></body>", "cms_pattern"),
        (f"<body><div>{WORDS}</div></body>", "fallback"),
        ("<body><article>short</article></body>", "fallback"),
    ],
)
def test_strategies(html, method):
    assert content.content_of(html, BASE)["extraction_method"] == method


def test_domain_selectors_and_cleaning():
    html = f"<body><nav>menu</nav><div class='box'>{WORDS}<p class='ad2'>buy</p></div><footer>f</footer><a></a><!-- c --></body>"
    got = content.content_of(html, BASE, [".none", ".box"], [".ad2", "p:hover"])
    assert got["extraction_method"] == "cms_pattern" and got["word_count"] == 120 and "buy" not in got["clean_html"]
    cleaned = content.clean(parse(html)).inner_html()
    assert "menu" not in cleaned and "<footer>" not in cleaned and "<a>" not in cleaned and "-->" not in cleaned
    assert content.junk_score(parse("<p>ab<a>cd</a></p>")) == 0.5 and content.junk_score(parse("")) == 1.0


@pytest.mark.parametrize(
    ("html", "field"),
    [
        ('<div class="faq"><div class="question"><button>Why?</button></div><dl><dt>How?</dt></dl></div>', "faq_modules"),
        ('<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q"}]}</script>', "faq_modules"),
        ('<script type="application/ld+json">[{"@type":["FAQPage"],"mainEntity":{"@type":"Question","name":"Q"}}]</script>', "faq_modules"),
        ('<ul class="toc"><li><a href="#a">a</a></li><li><a href="/b">b</a></li></ul>', "toc_sections"),
        ('<nav aria-label="Breadcrumb trail">x</nav>', "breadcrumbs"),
        ('<div class="call-to-action"><button>Go</button></div>', "template_ctas"),
        ('<div class="accordion">x</div>', "accordions"),
        ('<div class="testimonial">x</div>', "testimonials"),
        ('<div class="author-bio">x</div>', "author_bios"),
        ('<div class="related-posts">x</div>', "related_posts"),
    ],
)
def test_blocks(html, field):
    counts = structure.statistics(structure.detect(index(f"<body>{html}</body>")))
    assert counts[field] == 1 and sum(counts.values()) == 1


@pytest.mark.parametrize("html", ['<ul class="toc"><li><a href="#a">a</a></li><li><a href="/b">b</a></li><li><a href="/c">c</a></li></ul>', '<script type="application/ld+json">{broken</script>', '<div class="fabq">x</div>'])
def test_near_misses(html):
    assert structure.detect(index(html)) == []


def test_questions_and_accordions_that_are_faqs():
    blocks = structure.detect(index('<div class="faq accordion"><div class="question"><summary>A?</summary></div><div class="question"><summary>A?</summary></div></div>'))
    assert [b["type"] for b in blocks] == ["faq_module"] and blocks[0]["questions"] == ["A?"]


MENU = '<header><nav><ul><li><a href="/a">A</a></li><li><a href="#">B</a><ul class="sub-menu"><li><a href="/b1/">B1</a><ul><li><a href="/b2">B2</a></li></ul></li></ul></li><li><a href="https://x.com/us">X</a></li><li><a href="/c">C</a></li></ul></nav><a href="tel:1">call</a></header>'


def test_menus():
    got = nav.nav_structure(index(f"<body>{MENU}<footer><a href='/f1'>F1</a><a href='/f2'>F2</a></footer></body>"), BASE, [])
    assert [(i["label"], i["url"], i["depth"], i["parent_labels"]) for i in got["primary_nav"]] == [("A", "https://a.example/a", 0, None), ("B", "#", 0, None), ("B1", "https://a.example/b1", 1, ["B"]), ("B2", "https://a.example/b2", 2, ["B", "B1"]), ("C", "https://a.example/c", 0, None)]
    assert [i["label"] for i in got["footer_nav"]] == ["F1", "F2"] and got["utility_header"][0]["url"] == "tel:1"
    assert got["extraction_meta"]["has_mega_menu"] and got["extraction_meta"]["primary_nav_selector"] == "header nav > ul"


def test_breadcrumbs_languages_and_content_links():
    html = '<body><div class="breadcrumbs"><a href="/">Home</a> <span>»</span> <span>Here</span></div><div class="lang-switcher"><a href="/es" hreflang="es"></a><a href="/fr" class="lang-fr"></a></div><main><h2>Head</h2><p><a href="/one">one</a> <a href="/one/">again</a> <a href="#x">jump</a></p><div class="faq"><a href="/two">two</a></div><aside class="sidebar"><a href="/no">no</a></aside></main></body>'
    ix = index(html)
    got = nav.nav_structure(ix, BASE, structure.detect(ix))
    assert got["breadcrumb"] == [{"label": "Home", "url": "/"}, {"label": "Here", "url": None}]
    assert [i["label"] for i in got["language_switcher"]] == ["ES", "FR"]
    assert [(i["url"], i["source_type"], i["nearest_heading"], i["body_position_pct"]) for i in got["content_links"]] == [("https://a.example/one", "contextual_body", "Head", 0), ("https://a.example/", "toc_or_jump", "Head", 40), ("https://a.example/two", "faq_module", "Head", 60)]


def test_markdown_rules():
    html = '<h2>T</h2><p>a <b>b</b> <em>c</em> <code>x`y</code> <a href="../z">l</a><img src="/i.png" alt="i"></p><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><ol start="3"><li>x</li></ol><pre><code class="language-py">p = 1\n</code></pre><blockquote><p>q</p></blockquote><hr><p>5 * 6 [x] <a href="/e"></a></p>'
    got = enhanced_markdown(parse(html), [], "https://a.example/d/e", "H")
    assert got == "# H\n\n## T\n\na **b** *c* ``x`y`` [l](https://a.example/z)![i](https://a.example/i.png)\n\n-   one\n    -   in\n-   two\n\n3.  x\n\n```py\np = 1\n```\n\n> q\n\n---\n\n5 \\* 6 \\[x\\]"
    assert markdown(parse('<ul><li><a href="/a">a</a></li></ul><p>k</p>')) == "k"


def test_markers_wrap_blocks():
    html = '<p>x</p><div class="faq"><div class="faq-question">Q?</div><div class="faq-answer">A.</div></div><p>y</p>'
    root = parse(html)
    got = enhanced_markdown(root, structure.detect(Index(root))[:1], None, None)
    assert got == "x\n\n<!-- STRUCT:FAQ:START -->\n<!-- STRUCT:FAQ:Q -->Q?\n\n<!-- STRUCT:FAQ:A -->A.\n<!-- STRUCT:FAQ:END -->\n\ny"
    assert plain_markdown(got) == "x\n\nQ?\n\nA.\n\ny"


def test_page_stage(spark):
    rows = [(1, f"<html lang='en'><title>t</title><body>{MENU}<h1>H</h1><article><p>{WORDS}</p></article></body>", BASE, "x"), (2, None, None, "y"), (3, "", BASE, "z"), (4, "<p>" + "long " * 50_000, "not a url", "w")]
    df = spark.createDataFrame(rows, "id long, html_content string, final_url string, metadata string")
    got = {r["id"]: r for r in parse_pages(df).collect()}
    assert got[1]["metadata"]["title"] == "t" and len(got[1]["nav_structure"]["primary_nav"]) == 5 and got[1]["markdown"].startswith("# H")
    assert got[2]["clean_html"] == "" and got[3]["word_count"] == 0 and got[4]["word_count"] == 50_000
    assert parse_pages(df.limit(0)).count() == 0
    assert process(None, None)["nav_structure"]["primary_nav"] == []


def test_head_fields_and_rendered_markdown(spark):
    from pagequarry.operators.pages import render_markdown

    html = '<meta name="Robots" content=" noindex "><meta property="og:type" content="a"><meta name="robots" content="x"><script type="application/ld+json">{"a":1}</script>'
    assert process(html, BASE, parts=("head",)) == {"meta": {"robots": "noindex", "og:type": "a"}, "json_ld": ['{"a":1}']}
    rows = [(1, "<p>a</p><h1>H</h1><p>b</p><p>b</p><ul><li><a href='/x'>x</a></li></ul>", BASE, "H"), (2, None, None, None), (3, "<h3>deep</h3>", BASE, "")]
    df = spark.createDataFrame(rows, "id long, html string, url string, h1 string")
    got = {r["id"]: (r["markdown"], r["issue"]) for r in render_markdown(df, "html", "url", "h1").collect()}
    assert got == {1: ("# H\n\na\n\n\nb", "H1 at line 3 instead of line 1"), 2: ("", None), 3: ("# deep", None)}


def test_statistics_count_elements():
    ix = index('<div class="cta"><div class="cta-box"></div></div>')
    assert structure.statistics(structure.detect(ix))["template_ctas"] == 2 and len(select(ix.scope, ".cta")) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='faq'>", "</div>", "<ul>", "<li>", "</ul>", "<a href='/x'>", "</a>", "text ", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<!-- c", "-->", "<script>", "</script>", "<h1>", "</h1>", "<", ">", "&amp;", "'", '"', "<br/>", "<nav><ul><li><a href='#'>m</a>", "<img src=x>"]), max_size=25))
def test_any_soup_is_processed(parts):
    html = "".join(parts)
    out = process(html, BASE)
    assert (isinstance(out["markdown"], str) or not html) and out["word_count"] >= 0
    for e in parse(html).elements():
        assert 0 <= e.start <= e.end <= len(html)


def test_anchor_texts_of_links_are_whole():
    from pagequarry.html.content import page_links
    from pagequarry.html.tree import Index, parse

    card = "teaser " * 200
    index = Index(parse(f"<body><a href='/x'>{card}</a></body>"))
    assert page_links(index, "https://a.example/")[0]["anchor"] == card.strip()
    assert page_links(index, "https://a.example/", 10)[0]["anchor"] == card[:10]
