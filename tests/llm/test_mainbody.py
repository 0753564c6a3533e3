import numpy as np
import pytest

from pagequarry.llm import mainbody as M


def page(k, site, layout):
    """A page with menu, article and surroundings in one of several layouts."""
    rng = np.random.default_rng(k)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(letters[rng.integers(26)] for _ in range(3))
    sentence = lambda: " ".join(word() for _ in range(rng.integers(9, 22))) + "."
    menu = "".join(f'<li><a href="/{j}">Item {site} {j}</a></li>' for j in range(8))
    body = [f"<p>{sentence()} {sentence()}</p>" if rng.random() < 0.8 else f"<h2>{sentence()[:40]}</h2>" for _ in range(7)]
    body.insert(int(rng.integers(1, 6)), f"<p>Sign up for the {site} newsletter and share it</p>")
    art, head, foot = "".join(body), f"<h1>{sentence()[:50]}</h1>", f"<p>About {site} and its people</p><p>© {site}</p>"
    side = f"<h3>Read also on {site}</h3><p><a href='/t'>Another story of {site} number {k % 3}</a></p>"
    main = {b.strip() for b in M.block_texts(head + art)} - {f"Sign up for the {site} newsletter and share it"}
    if layout == "plain":
        html = f"<div class='q1'><ul>{menu}</ul></div><div class='q2'>{head}{art}</div><div class='q3'>{side}</div><div class='q4'>{foot}</div>"
    else:
        html = f"<header><nav><ul>{menu}</ul></nav></header><main><article>{head}{art}</article></main><aside>{side}</aside><footer>{foot}</footer>"
    return f"<html><head><title>t {k}</title><script>var p='<p>no</p>';</script></head><body>{html}</body></html>", main


def test_blocks_by_definition():
    html = "<P>One <B>two</B> &amp;&nbsp;three<br>four</P><!-- <p>no</p> --><div title='a > b'>x<script>'</p>'</script>y<img src=a>z</div><p> </p>tail <a href=#>link</a>"
    assert M.block_texts(html) == ["One two & three four", "x", "y", "z", "tail link"]
    assert M.block_texts("") == [] and M.block_texts("<p>") == []


def test_sample_takes_pages_of_every_site(spark):
    df = spark.range(3000).selectExpr("id", "concat('s', id % 30) as host")
    hosts = [r["host"] for r in df.join(M.sample_ids(df, 60), "id").collect()]
    assert len(hosts) == 60 and {hosts.count(h) for h in hosts} == {2} and len(set(hosts)) == 30


@pytest.fixture(scope="module")
def sites(spark):
    rows, truth = [], {}
    for k in range(240):
        site = f"s{k % 8}"
        html, main = page(k, site, "plain" if k % 8 >= 6 else "marked")
        rows.append((k, f"https://{site}.example/{k}", html, "x"))
        truth[k] = main
    return spark.createDataFrame(rows, "id long, url string, html string, block string"), truth


def test_marked_and_plain_layouts(sites):
    df, truth = sites
    got = {}
    for r in M.main_blocks(df, "id", "url", "html").collect():
        got.setdefault(r["id"], set()).add(r["block"])
    for layout in (False, True):
        ids = [k for k in truth if (k % 8 >= 6) == layout]
        hit = sum(len(got.get(k, set()) & truth[k]) for k in ids)
        assert hit / sum(len(got.get(k, set())) for k in ids) > 0.97 and hit / sum(len(truth[k]) for k in ids) > 0.95


def test_shuffled_site_keys_give_the_same(sites, monkeypatch):
    df, _ = sites
    want = M.main_blocks(df, "id", "url", "html").select("id", "block_no")
    monkeypatch.setattr(M, "MAX_BROADCAST_KEYS", 0)
    other = M.main_blocks(df, "id", "url", "html").select("id", "block_no")
    assert want.exceptAll(other).isEmpty() and other.exceptAll(want).isEmpty()


def test_nulls_empty_long_and_repeated_pages(spark, sites):
    df, _ = sites
    extra = spark.createDataFrame([(1000, None, "<p>" + "long words here. " * 20_000 + "</p>", "x"), (1001, "https://s0.example/", None, "x"), (1002, "https://s0.example/", "", "x"), (1003, None, "<<<>>", "x"), (1004, "https://s0.example/", "<div>" * 3000 + "deep", "x")], df.schema)
    got = {r["id"] for r in M.main_blocks(df.unionByName(extra).unionByName(df.limit(3)), "id", "url", "html").select("id").distinct().collect()}
    assert not got & {1001, 1002}


def test_decoding_never_contradicts_an_ancestor():
    nodes = M.Nodes()
    nodes.page("<div><p>a</p><p>b</p></div><div><p>c</p><p>d</p></div>")
    table = M.Table(nodes, np.zeros(4), np.zeros(4), np.zeros(4))
    score = np.zeros(len(table.parent))
    score[table.leaf] = [2.0, -0.5, -1.0, -2.0]
    outer = table.parent[table.parent[table.leaf]]
    score[outer[0]], score[outer[2]] = 3.0, -3.0
    assert M.decode(table, score).tolist() == [True, True, False, False]
    score[outer[0]] = 0.0
    assert M.decode(table, score).tolist() == [True, False, False, False]


def test_what_is_kept_never_lies_in_a_dropped_element():
    """Random scores on nested pages with headings in odd places: keeping a leaf leaves its ancestors open or kept."""
    rng = np.random.default_rng(5)
    for k in range(50):
        nodes = M.Nodes()
        nodes.page("<header><h1>T</h1><ul><li>m</li><li>n</li></ul></header><div><div><p>a</p><p>b</p></div><aside><p>c</p></aside></div><footer><p>d</p></footer>")
        table = M.Table(nodes, np.zeros(len(nodes.text)), np.zeros(len(nodes.text)), np.zeros(len(nodes.text)))
        score = rng.normal(-1, 3, len(table.parent))
        kept = M.kept_leaves(table, score)
        assert kept[0]
        known = score.copy()
        known[table.leaf[0]] = M.KNOWN
        given = M.in_its_place(table, known, M.decode(table, known))
        known[table.leaf[given]] = M.KNOWN
        assert (kept == M.decode(table, known)).all()  # decoding alone decides


def test_a_message_in_the_articles_place():
    nodes = M.Nodes()
    nodes.page("<ul><li>menu</li></ul><div><h1>Oops</h1><p>Nothing here.</p></div><div><p>footer</p></div>")
    table = M.Table(nodes, np.array([0, 0, 0, 1]), np.zeros(4), np.zeros(4))
    score = np.zeros(len(table.parent))
    score[table.leaf] = [-3.0, 5.0, -1.0, -0.5]
    assert M.in_its_place(table, score, np.array([False, True, False, False])).tolist() == [2] and M.kept_leaves(table, score).tolist()[1:3] == [True, True]
    score[table.leaf[2]] = -9.0
    assert M.in_its_place(table, score, np.array([False, True, False, False])).tolist() == []


def test_trees_learn_a_rule():
    rng = np.random.default_rng(3)
    x = rng.random((6000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    edges = M.feature_edges(x)
    model = M.fit_boosted(edges, M.bin_features(x, edges), y, np.ones(len(y)))
    fresh = rng.random((2000, 5)).astype(np.float32)
    want = (fresh[:, 0] > 0.5) ^ (fresh[:, 3] > 0.3)
    assert ((model.log_odds(fresh) > 0) == want).mean() > 0.93


def test_a_sample_without_articles_is_an_error(spark):
    df = spark.createDataFrame([(1, "https://a.example/", "<p>x</p>")], "id long, url string, html string")
    with pytest.raises(ValueError):
        M.main_blocks(df, "id", "url", "html")
