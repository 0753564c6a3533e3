import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import site_lines as L


def brute_force(rows):
    pages = {}
    for i, url, text in rows:
        if url and text is not None:
            host = re.sub(r":\d+$", "", re.sub(r"^www\.", "", re.sub(r"^https?://", "", url.lower()).split("/")[0]))
            pages[i] = (re.sub(r"^www\.", "", host), text)
    key = lambda line: " ".join(re.sub("[0-9]", "", line.lower()).split())
    on, total = defaultdict(set), defaultdict(set)
    for i, (host, text) in pages.items():
        total[host].add(i)
        for line in text.split("\n"):
            on[host, key(line)].add(i)
    return {(i, k) for i, (host, text) in pages.items() for k, line in enumerate(text.split("\n")) if len(re.findall(r"[^\W\d_]+", line)) >= 3 and len(on[host, key(line)]) >= 5 and len(on[host, key(line)]) >= 0.2 * len(total[host])}


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(40):
        host = ["https://WWW.a.example:8080/x", "http://a.example/y", "https://b.example/"][i % 3 if i < 36 else 2]
        lines = [f"Unique line number {'x' * (i + 1)} of this page", f"Posted on  {i} May by the desk", "a b" if i % 2 else "Call 555 now please"]
        if i % 4 == 0:
            lines.append("SHARE this\twith 3 friends")
        out.append((i, host, "\n".join(lines)))
    return [*out, (100, None, "Posted on 1 May by the desk"), (101, "https://a.example/", None), (102, "https://a.example/", ""), out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "id long, url string, text string, leaf string")


def test_by_brute_force(spark, rows):
    got = {tuple(r) for r in L.repeated_lines(frame(spark, rows), "id", "url", "text").collect()}
    assert got == brute_force(rows) and got


def test_salted_joins_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "MAX_BROADCAST_ROWS", 0)
    assert {tuple(r) for r in L.repeated_lines(frame(spark, rows), "id", "url", "text").collect()} == brute_force(rows)


def test_texts_without_them(spark, rows):
    df = frame(spark, rows).dropDuplicates(["id"])
    out = {r["id"]: r for r in L.without_repeated_lines(df, "id", "url", "text").collect()}
    assert out[1]["site_text"] == "Unique line number xx of this page\na b" and out[1]["leaf"] == "c"
    assert out[101]["site_text"] is None and out[102]["site_text"] == "" and len(out) == 43


def test_templates_merge_in_any_order(spark, rows):
    one = {tuple(r) for r in L.site_templates(frame(spark, rows).repartition(1), "id", "url", "text").collect()}
    many = {tuple(r) for r in L.site_templates(frame(spark, rows).repartition(7), "id", "url", "text").collect()}
    assert one == many and ("b.example", "posted on may by the desk", 16) in one
    assert ("b.example", "unique line number <*> of this page", 16) in one


def bylines(n_sites=3):
    """Lines that differ by a name at the end, in the middle or at the start, on half of each site's pages."""
    out, i = [], 0
    for site in range(n_sites):
        for k in range(30):
            name = "".join(chr(97 + (7 * k + j * site) % 26) for j in range(5))
            own = f"{name} tells of {name[::-1]} in words of its own number {'z' * (k + 1)} here"
            slot = [f"Words and pictures by {name} {name}son", f"Reviewed by the {name} office on 3 May 202{k % 5}", f"{name} {name}er wrote this page for us"] if k % 2 else ["Something else altogether", own]
            out.append((i, f"https://s{site}.example/{k}", "\n".join([own, *slot])))
            i += 1
    return out


def test_lines_that_differ_in_a_slot(spark):
    rows = bylines()
    df = frame(spark, rows)
    exact = {tuple(r) for r in L.repeated_lines(df, "id", "url", "text").collect()}
    found = {(r["id"], r["line_no"]): r["template"] for r in L.template_lines(df, "id", "url", "text").collect()}
    wanted = {(i, n) for i, _, t in rows if i % 2 for n in (1, 2, 3)}
    assert exact == brute_force(rows) and exact <= set(found)
    assert wanted <= set(found) and not any(n == 0 for _, n in found)
    assert {found[1, 1], found[1, 2], found[1, 3]} == {"words and pictures by <*> <*>", "reviewed by the <*> office on may", "<*> <*> wrote this page for us"}
    clean = {r["id"]: r["site_text"] for r in L.without_repeated_lines(df, "id", "url", "text", similar=True).collect()}
    assert all(clean[i].count("\n") == 0 and clean[i] == t.split("\n")[0] for i, _, t in rows if i % 2)


def test_empty_and_one_site(spark, rows):
    df = frame(spark, rows)
    assert L.repeated_lines(df.limit(0), "id", "url", "text").count() == 0
    assert L.repeated_lines(df.withColumn("url", F.lit(None).cast("string")), "id", "url", "text").count() == 0
    long = spark.createDataFrame([(k, "https://c.example/", "Same line of words here\n" + f"other {'y' * k} words\n" * 20_000) for k in range(5)], "id long, url string, text string")
    assert {tuple(r) for r in L.repeated_lines(long, "id", "url", "text").collect()} == {(k, 0) for k in range(5)}


def test_hosts(spark):
    urls = [("HTTPS://www.A.example:80/x", "a.example"), ("a.example/x", "a.example"), ("https://u:p@b.example", "b.example"), ("", None), (None, None), ("https:///x", None)]
    df = spark.createDataFrame(urls, "u string, want string").select("want", L.host_of(F.col("u")).alias("got"))
    assert all(r["got"] == r["want"] for r in df.collect())
