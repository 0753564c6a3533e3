import pytest
from pyspark.sql import functions as F

from pagequarry.operators import backfill, discover, ingest, merge
from pagequarry.sources import tables

def now():
    return F.expr("TIMESTAMP '2026-01-01 00:00:00'")


def pages(spark, rows):
    """Rows as dicts; other columns null."""
    df = tables.empty_table(spark, "crawler_pages")
    names = {f.name: f.dataType for f in df.schema} | {"seq": "long"}
    cols = [c for c in names if any(c in r for r in rows)]
    from pyspark.sql import types as T

    kinds = T.StructType([T.StructField(c, names[c] if not isinstance(names[c], str) else T.LongType()) for c in cols])
    made = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], kinds)
    return made.select(*[F.col(c) if c in cols else F.lit(None).cast(names[c]).alias(c) for c in names])


def test_events_in_order(spark):
    stored = pages(spark, [{"id": 5, "final_url": "u", "content_hash": "h1", "html_content": "one", "title": "T", "word_count": 9, "crawl_status": "OK", "requested_url_original": "r0"}]).drop("seq")
    events = [
        {"final_url": "u", "seq": 0, "content_hash": "h1", "html_content": "same hash", "title": None, "word_count": 7, "crawl_status": "OK", "requested_url_original": "r1"},
        {"final_url": "u", "seq": 1, "content_hash": "h2", "html_content": "two", "title": "", "word_count": 8, "crawl_status": "OK"},
        {"final_url": "u", "seq": 2, "content_hash": None, "html_content": "lost", "title": None, "crawl_status": "ERROR", "last_error": "timeout"},
        {"final_url": "v", "seq": 3, "content_hash": "k", "html_content": "new", "word_count": 1, "status_code": 0, "requested_url_original": "rv"},
        {"final_url": "v", "seq": 4, "content_hash": "k", "html_content": "newer, same hash", "word_count": 2},
    ]
    got = {r["final_url"]: r for r in merge.merge_pages(stored, pages(spark, events).drop("id", "last_crawled_at"), now()).collect()}
    u, v = got["u"], got["v"]
    assert (u["id"], u["html_content"], u["title"], u["word_count"], u["crawl_status"], u["last_error"], u["content_hash"], u["requested_url_original"]) == (5, "two", "T", 0, "ERROR", "timeout", "h2", "r0")
    assert (v["id"], v["html_content"], v["word_count"], v["status_code"], v["requested_url_original"]) == (6, "new", 2, None, "rv")


def test_merging_twice_changes_times_only(spark):
    events = pages(spark, [{"final_url": x, "seq": k, "content_hash": x, "html_content": x, "word_count": k} for k, x in enumerate("abcab")]).drop("id", "last_crawled_at")
    once = merge.merge_pages(tables.empty_table(spark, "crawler_pages"), events, now())
    twice = merge.merge_pages(once, events, now())
    assert once.drop("last_crawled_at").exceptAll(twice.drop("last_crawled_at")).isEmpty() and once.count() == twice.count() == 3
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 3]


def test_hash_gated_markdown_and_collated_key(spark):
    stored = pages(spark, [{"id": 1, "final_url": "https://X.example/", "content_hash": "h", "markdown": "old"}]).drop("seq")
    events = pages(spark, [{"final_url": "https://x.example/", "seq": 0, "content_hash": "h", "markdown": "new"}]).drop("id", "last_crawled_at")
    gated = merge.merge_pages(stored, events, now(), "hash_gated", F.lower("final_url")).collect()
    assert len(gated) == 1 and gated[0]["markdown"] == "old"
    assert merge.merge_pages(stored, events, now(), key=F.lower("final_url")).first()["markdown"] == "new"
    assert merge.merge_pages(stored, events, now()).count() == 2


def test_runs_overrides_and_deletes(spark):
    created = tables.empty_table(spark, "crawl_runs").unionByName(spark.sql("select 'r' run_id, array('s') seed_sitemaps, 10 max_pages, 'cheerio' fetch_mode_default, timestamp'2025-01-01' started_at, cast(null as timestamp) finished_at, 1 total_urls_discovered, 0 total_pages_crawled, 0 total_redirects, 0 total_errors, 'n' notes"))
    patches = spark.sql("select * from values ('r', 1L, 5, cast(null as int)), ('r', 2L, cast(null as int), 3) as t(run_id, seq, total_pages_crawled, total_errors)")
    done = merge.fold_runs(created, patches, spark.sql("select 'r' run_id, timestamp'2025-01-02' finished_at")).first()
    assert (done["total_pages_crawled"], done["total_errors"], done["notes"], done["finished_at"].day) == (5, 3, "n", 2)
    event = spark.sql("select 'd.example' domain, cast(null as boolean) enabled, array('.m') main_content_selectors, cast(null as array<string>) remove_selectors, cast(null as string) force_fetch_mode, '' notes, cast(null as timestamp) updated_at, 1L seq")
    assert merge.merge_overrides(tables.empty_table(spark, "domain_overrides"), event, now()).first()["enabled"] is True
    urls = spark.createDataFrame([("https://a.example",), ("https://B.EXAMPLE",), (None,)], "final_url string")
    kept, deleted = merge.delete_like(urls, "b.exa")
    assert kept.count() == 2 and deleted.first()[0] == 1


INDEX = '<sitemapindex><sitemap><loc> https://a.example/post-sitemap.xml </loc></sitemap><sitemap><loc>https://a.example/gone.xml</loc></sitemap></sitemapindex>'
POSTS = "<urlset><url><loc>https://a.example/p/1?utm_source=x</loc><lastmod>2025</lastmod></url><url><loc>https://a.example/p/1</loc></url><url><loc>bad host/</loc></url><url><loc><![CDATA[https://a.example/p?a=1&amp;b=2]]></loc></url></urlset>"


def test_sitemaps_to_queue(spark):
    seeds = spark.createDataFrame([("https://a.example/index.xml", 0), ("https://a.example/page-sitemap.xml", 1)], "sitemap_source string, sitemap_ord int")
    documents = spark.createDataFrame([("https://a.example/index.xml", INDEX), ("https://a.example/post-sitemap.xml", POSTS), ("https://a.example/page-sitemap.xml", POSTS)], "sitemap_source string, xml string")
    entries = discover.keep_first(discover.sitemap_entries(discover.expand_indexes(seeds, documents)))
    rows = {r["normalized_url"]: r for r in entries.collect()}
    assert set(rows) == {"https://a.example/p/1", "https://a.example/p?a=1&b=2"}
    assert rows["https://a.example/p/1"]["type_hint"] == "post" and rows["https://a.example/p/1"]["pos"] == 0
    known = spark.createDataFrame([("https://a.example/p/1",)], "final_url string")
    assert discover.not_yet_crawled(entries, known).count() == 1 and discover.not_yet_crawled(entries, known, recrawl=True, max_pages=1).first()["pos"] == 0


HTML = "<html><title>T</title><body><h1>H</h1><div class='faq'><p>" + "word " * 120 + "</p></div></body></html>"


@pytest.fixture
def fetched(spark):
    rows = [
        ("https://a.example/x/", "https://a.example/x", 200, HTML, None, "post", 0, None, "run"),
        ("https://a.example/old", "https://a.example/new", 200, HTML, None, None, 1, None, "run"),
        ("https://a.example/broken", None, None, None, None, None, 2, "timeout", "run"),
        ("https://a.example/none", "https://a.example/none", 404, "<body>no</body>", None, None, 3, None, "run"),
    ]
    return spark.createDataFrame(rows, "requested_url string, loaded_url string, status_code int, body string, redirect_chain array<string>, type_hint string, seq long, error string, run_id string")


def test_ingest_and_backfill(spark, fetched, tmp_path):
    folder = str(tmp_path / "tables")
    figures = ingest.ingest(spark, folder, fetched, now()).first()
    assert (figures["total_pages_crawled"], figures["total_errors"], figures["total_redirects"]) == (3, 1, 1)
    stored = tables.read(spark, folder, "crawler_pages")
    got = {r["final_url"]: r for r in stored.collect()}
    assert got["https://a.example/new"]["redirect_chain"] == ["https://a.example/old", "https://a.example/new"] and got["https://a.example/x"]["redirect_chain"] is None
    assert got["https://a.example/broken"]["crawl_status"] == "ERROR" and got["https://a.example/none"]["crawl_status"] == "NOT_FOUND"
    assert got["https://a.example/x"]["word_count"] == 120 and got["https://a.example/x"]["h1"] == "H"
    assert tables.read(spark, folder, "url_aliases").count() == 1
    ingest.ingest(spark, folder, fetched, now())
    assert tables.read(spark, folder, "crawler_pages").count() == 4
    stored = tables.read(spark, folder, "crawler_pages")  # the snapshot was replaced
    bare = stored.withColumn("markdown_enhanced", F.lit(None).cast("string")).withColumn("nav_structure", F.lit(None).cast(stored.schema["nav_structure"].dataType))
    filled, counts = backfill.backfill_markdown(bare)
    assert counts.first()["processed"] == 3 and filled.filter("markdown_enhanced like '# H%'").count() == 2
    filled, counts = backfill.backfill_nav(bare, limit=1)
    assert counts.first()["processed"] == 1 and filled.filter("nav_structure is not null").count() == 1
    assert [r["id"] for r in tables.by_run(stored, "run").collect()] == [1, 2, 3, 4] and tables.lookup(stored, "final_url", "https://a.example/x").count() == 1


def test_a_write_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")
    one = pages(spark, [{"id": 1, "final_url": "https://a.example/1", "title": "old"}, {"id": 2, "final_url": "https://b.example/1", "title": "b"}]).drop("seq")
    tables.replace(one, folder, "crawler_pages")
    commit = tables._Files.commit

    def dies(self, content):
        raise RuntimeError("lost")

    def torn(self, content):
        commit(self, content)
        last = tmp_path / "tables/crawler_pages/_commits" / self.commits()[-1]
        last.write_text("{")
        last.with_name(f".{last.name}.crc").unlink(missing_ok=True)

    for broken in (dies, torn):
        monkeypatch.setattr(tables._Files, "commit", broken)
        try:
            tables.replace(one.withColumn("title", F.lit("new")), folder, "crawler_pages")
        except RuntimeError:
            pass
        monkeypatch.setattr(tables._Files, "commit", commit)
        assert {r["title"] for r in tables.read(spark, folder, "crawler_pages").collect()} == {"old", "b"}
    for k in range(3):
        tables.replace(tables.read(spark, folder, "crawler_pages").withColumn("title", F.lit(f"new {k}")), folder, "crawler_pages")
    assert {r["title"] for r in tables.read(spark, folder, "crawler_pages").collect()} == {"new 2"}
    assert len(list((tmp_path / "tables/crawler_pages").glob("data-*"))) <= tables.KEPT_COMMITS


def test_an_update_touches_only_the_buckets_of_its_keys(spark, tmp_path):
    folder = str(tmp_path / "tables")
    rows = [{"id": k, "final_url": f"https://h{k % 20}.example/{k}", "title": "t"} for k in range(200)]
    pages(spark, rows).drop("seq").write.parquet(f"{folder}/crawler_pages")  # a plain folder first
    assert tables.read(spark, folder, "crawler_pages").count() == 200
    tables.replace(tables.read(spark, folder, "crawler_pages"), folder, "crawler_pages")
    before = tables._Files(spark, folder, "crawler_pages").current()["folders"]
    events = pages(spark, [{"final_url": f"https://h3.example/{k}", "seq": k, "title": "u"} for k in (3, 23, 1000, 1001)]).drop("id", "last_crawled_at")
    seen = []

    def change(stored, top):
        seen.append((stored.count(), top))
        return merge.merge_pages(stored, events, now(), top=top)

    tables.update(spark, folder, "crawler_pages", events.select("final_url"), change)
    after = tables._Files(spark, folder, "crawler_pages").current()
    touched = {r[0] for r in events.select(tables.bucket_of(F.col("final_url"))).collect()}
    assert {b for b, f in after["folders"].items() if before.get(b) != f} == {str(b) for b in touched} and after["top"] == 201 and seen[0][0] < 100
    got = {r["final_url"]: r for r in tables.read(spark, folder, "crawler_pages").collect()}
    assert len(got) == 202 and got["https://h3.example/23"]["title"] == "u" and got["https://h4.example/4"]["title"] == "t"
    assert {got[f"https://h3.example/{k}"]["id"] for k in (1000, 1001)} == {200, 201}


def test_stored_pages_without_an_event_are_not_shuffled(spark, tmp_path):
    pages(spark, [{"id": 1, "final_url": "u"}]).drop("seq").write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    events = pages(spark, [{"final_url": "v", "seq": 0}]).drop("id", "last_crawled_at")
    plan = merge.merge_pages(stored, events, now())._jdf.queryExecution().optimizedPlan().toString()
    union = plan.split("Union")[1]
    assert "LeftAnti" in union.split("Aggregate")[0] and "broadcast" in union.split("Aggregate")[0]


def test_json_export(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, None), (2, "x")], "id long, t string")
    for rows, name in ((df, "full"), (df.limit(0), "none")):
        tables.export_json(rows, str(tmp_path / name), single_array=True)
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert json.loads(text) == ([{"id": 1, "t": None}, {"id": 2, "t": "x"}] if name == "full" else [])
    assert tables.run_query(spark, "select :n + 1 as x", n=1).first()["x"] == 2


def test_stream(spark, fetched, tmp_path):
    from pagequarry.streaming import ingest as stream

    source, folder = str(tmp_path / "in"), str(tmp_path / "tables")
    fetched.withColumn("fetched_at", now()).write.parquet(source)
    for _ in range(2):
        stream.merge_stream(stream.fetched_stream(spark, source), folder, str(tmp_path / "check")).awaitTermination()
    assert tables.read(spark, folder, "crawler_pages").count() == 4
    q = stream.status_counts(stream.without_recent(stream.fetched_stream(spark, source)), late=None).writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").columns == ["window_start", "status", "count"]


def test_commands(spark, fetched, tmp_path, capsys):
    from pagequarry import cli

    (tmp_path / "post-sitemap.xml").write_text("<urlset><url><loc>https://a.example/x</loc></url><url><loc>https://a.example/old</loc></url></urlset>")
    fetched.withColumn("fetched_at", now()).write.parquet(str(tmp_path / "fetched"))
    base = ["--tables", str(tmp_path / "t")]
    cli.main([*base, "crawl", "-s", str(tmp_path / "post-sitemap.xml"), "--dry-run"])
    assert "2 URLs, 2 to crawl" in capsys.readouterr().out
    cli.main([*base, "crawl", "-s", str(tmp_path / "post-sitemap.xml"), "--fetched", str(tmp_path / "fetched")])
    stored = tables.read(spark, str(tmp_path / "t"), "crawler_pages")
    assert {r["final_url"] for r in stored.collect()} == {"https://a.example/x", "https://a.example/new"}
    run = tables.read(spark, str(tmp_path / "t"), "crawl_runs").first()
    assert run["total_pages_crawled"] == 2 and run["finished_at"] is not None
    cli.main([*base, "research", "create", "P"])
    cli.main([*base, "research", "add-run", "P", run["run_id"]])
    for action in (["list"], ["show", "P"], ["domains", "P"], ["pages", "P"]):
        cli.main([*base, "research", *action])
    assert "a.example" in capsys.readouterr().out
    cli.main([*base, "backfill-markdown", "--force-all"])
    cli.main([*base, "clear-domain", "a.example"])
    assert tables.read(spark, str(tmp_path / "t"), "crawler_pages").count() == 0
