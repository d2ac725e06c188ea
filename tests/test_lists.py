"""Lists, filters, summaries and the registries."""

from pyspark.sql import functions as F

from pagelens import sources
from pagelens.functions import urls as U
from pagelens.operators import diffs, duplicates, enrichment, facets, graph, rollups
from pagelens.operators import site_checks as S
from pagelens.operators.checks import CHECKS
from pagelens.operators.checks.registry import reads
from pagelens.plans.audit import run_audit

PAGES = "crawl_id string, url string, status int, depth int, meta_robots string, x_robots string, canonical string, redirect_chain array<string>"


def _pages(spark):
    rows = [
        ("c", "https://a.example/", 200, 0, None, None, None, []), ("c", "https://a.example/x", 200, None, "NOINDEX", None, "https://a.example/x", []),
        ("c", "https://a.example/y", 404, 1, None, None, "https://a.example/x", []), ("c", "https://a.example/x#f", 200, 2, None, None, None, ["r"]),
    ]
    return spark.createDataFrame(rows, PAGES)


def test_hidden_focused_and_final_pages(spark):
    pages = _pages(spark)
    ends = lambda df: [r.url.removeprefix("https://a.example/") for r in df.collect()]
    assert ends(facets.without_hidden(pages, noindex=True)) == ["", "y", "x#f"]
    assert ends(facets.without_hidden(pages, canonicalised=True)) == ["", "x", "x#f"]
    found = spark.createDataFrame([("c", "https://a.example/y", "B01"), ("c", "https://a.example/", "T01")], "crawl_id string, url string, check_id string")
    assert ends(facets.focus(pages, found, "B01")) == ["y"]
    assert ends(rollups.page_order(pages)) == ["", "y", "x#f", "x"]
    assert sorted(ends(graph.final_addresses(pages))) == ["", "x", "y"]
    ok = U.strictly_indexable(F.col("url"), F.col("status"), F.lower("meta_robots"), F.col("x_robots"), F.col("canonical"))
    assert [r[0] for r in pages.select(ok).collect()] == [True, False, False, True]


def test_scope_of_a_site(spark):
    df = spark.createDataFrame([("https://shop.a.example/b/c",), ("https://a.example/b/d",), ("https://cdn.test/x",), ("https://x.cdn.test/b/",), ("https://aa.example/b/",)], "u string")
    inside = lambda **k: [r[0] for r in df.select(U.in_site(F.col("u"), F.lit("https://a.example/b/index.html"), **k)).collect()]
    assert inside() == [False, True, False, False, False]
    assert inside(subdomains=True, cdn_hosts=["cdn.test"]) == [True, True, True, True, False]
    assert inside(subdomains=True, cdn_hosts=["cdn.test"], start_folder=True) == [True, True, False, True, False]


def test_worst_severity_counts(spark):
    schema = "check_id string, url string, severity string"
    new = spark.createDataFrame([("B01", "u", "Critical"), ("B01", "u", "Medium"), ("X", "", "High"), ("Y", None, "High")], schema)
    assert [tuple(r) for r in diffs.regressions(diffs.issue_compare(new.limit(0), new)).collect()] == [("B01", "u", "new", "Critical")]


def test_summaries(spark):
    resources = spark.createDataFrame([("c", None, "a", 200, 5), ("c", "image", "b", 404, 7), ("c", "image", "d", 200, None)], "crawl_id string, kind string, url string, status int, bytes long")
    assert {(r.kind, r.total, r.broken, r.bytes) for r in rollups.resource_summary(resources).collect()} == {("unknown", 1, 0, 5), ("image", 2, 1, 7), ("all", 3, 1, 12)}
    assert [r.url for r in rollups.resource_order(resources).collect()] == ["b", "a", "d"]
    issues = spark.createDataFrame([("High", "FLAG"), ("High", "AUTO"), ("Low", "FLAG")], "severity string, tier string")
    assert rollups.filter_issues(issues, "High", "FLAG").count() == 1 and rollups.filter_issues(issues, tier="FLAG").count() == 2
    pages = spark.createDataFrame([("a", "u", 200, True)], "crawl_id string, url string, status int, indexable boolean")
    found = spark.createDataFrame([], "crawl_id string, url string, check_id string, severity string")
    crawls = spark.createDataFrame([("a",), ("b",)], "crawl_id string")
    assert {(r.crawl_id, r.total, r.score) for r in rollups.health(pages, found, crawls).collect()} == {("a", 1, 100), ("b", 0, 100)}
    listed = spark.createDataFrame([(k,) for k in range(30)], "crawl_id int")
    assert [r[0] for r in enrichment.crawl_list(listed, 3).collect()] == [29, 28, 27] and enrichment.crawl_list(listed, -1).count() == 1
    assert enrichment.without_crawl({"pages": pages}, "a")["pages"].count() == 0
    metrics = spark.createDataFrame([("u", 5, 1.0), ("u", 4, 9.0)], "url string, clicks int, position double")
    assert enrichment.join_by_url(pages.select("url"), metrics, ["clicks", "position"]).first()[1:] == (5, 1.0)


def test_grid_as_spreadsheets_read_it(spark, tmp_path):
    pages = spark.createDataFrame([("c", "u1", 'a "b"'), ("c", "u2", None), ("c", "u3", "x")], "crawl_id string, url string, title string").coalesce(1)
    sources.export_grid(pages, str(tmp_path / "g"), ["url", "title"], pages.where("url <> 'u3'"))
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "g").glob("part-*"))
    assert text.startswith('﻿"url","title"\r\n') and sorted(text.splitlines()[1:])[-2:] == ['"u1","a ""b"""', '"u2",""']


def test_vectors_in_small_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    rows = [("a" if k % 3 else "b", k, v.tolist()) for k, v in enumerate(x)] + [("a", 900, []), ("b", 901, None), ("a", 902, [0.0] * 6), ("c", 903, [1.0, 2.0]), ("a", 904, [1.0])]
    df = spark.createDataFrame(rows, "site string, id long, v array<double>")
    cos = lambda p, q: float(np.dot(p, q) / np.linalg.norm(p) / np.linalg.norm(q))
    groups = {s: [k for k in range(120) if ("a" if k % 3 else "b") == s] for s in "ab"}
    want = {(s, i, j) for s, g in groups.items() for i in g for j in g if i < j and cos(x[i], x[j]) >= 0.6}
    got = duplicates.semantic_pairs(df, "id", "v", 0.6, by=("site",), block=16).collect()
    assert {(r.site, r.a, r.b) for r in got} == want and len(got) == len(want)
    near = {i: max(cos(x[i], x[j]) for j in g if j != i) for g in groups.values() for i in g}
    low = {(r.id, round(r.max_similarity, 9)) for r in duplicates.low_relevance(df, "id", "v", 0.7, by=("site",), block=16).collect()}
    assert low == {(i, round(s, 9)) for i, s in near.items() if s < 0.7} | {(902, 0.0), (903, 0.0), (904, 0.0)}
    assert duplicates.similar_report(duplicates.semantic_pairs(df, "id", "v", 0.6, by=("site",)), 3).count() == 3
    assert duplicates.low_relevance_report(duplicates.low_relevance(df, "id", "v", 0.7, by=("site",)), 2).count() == 2


def test_audit_runs_every_check_that_has_its_inputs(spark):
    html = lambda body: f"<html lang=en><head><meta charset=utf-8><title>T</title></head><body>{body}</body></html>"
    rows = [("c", "https://s.example/", html("<a href=/a>a</a><a href=https://o.test/1>o</a><a href=https://spam.test/>s</a><img src=/i.png alt=i>")), ("c", "https://s.example/a", html("text"))]
    pages = spark.createDataFrame(rows, "crawl_id string, url string, html string")
    sites = spark.createDataFrame([("c", "https://s.example/", "User-agent: *\nDisallow:\n", 200, "text/plain")], "crawl_id string, base_url string, robots_txt string, robots_status int, robots_type string")
    body = "<urlset><url><loc>https://s.example/</loc></url><url><loc>https://s.example/gone</loc></url></urlset>"
    audit = run_audit(
        pages, sites,
        sitemap_files=spark.createDataFrame([("c", "https://s.example/sitemap.xml", body)], "crawl_id string, file string, body string"),
        url_status=spark.createDataFrame([("https://o.test/1", 404)], "url string, status int"),
        blocklist=spark.createDataFrame([("spam.test",)], "host string"),
        image_sizes=spark.createDataFrame([("https://s.example/i.png", 200_000, 404, 800, 100)], "src string, bytes long, status int, natural_width int, rendered_width int"),
        sitemap_images=spark.createDataFrame([("https://s.example/j.png",)], "src string"),
    )
    found = {(r.url.removeprefix("https://s.example"), r.check_id) for r in audit.findings.collect()}
    assert {("/", "B05"), ("/", "G01"), ("/", "G05"), ("/", "H04"), ("/", "H06"), ("/", "H10"), ("/", "H11"), ("/a", "K05"), ("/gone", "K08"), ("/gone", "K09"), ("/", "K09"), ("/", "F01")} <= found
    assert {r.url: r.in_sitemap for r in audit.pages.collect()} == {"https://s.example/": True, "https://s.example/a": False}


def test_registries(spark):
    assert reads(CHECKS["F01"], "inlink_count") and not reads(CHECKS["T01"], "inlink_count", "in_sitemap")

    @S.register_site_check
    def own(crawl):
        return crawl.pages.select("crawl_id", "url", F.lit("Z01").alias("check_id"), F.lit("Low").alias("severity"), F.lit("REVIEW").alias("tier"), F.lit(None).cast("string").alias("evidence"))

    try:
        pages = spark.createDataFrame([("c", "https://s.example/", "<p>x")], "crawl_id string, url string, html string")
        assert "Z01" in {r.check_id for r in run_audit(pages).findings.collect()}
    finally:
        del S.SITE_CHECKS["own"]
