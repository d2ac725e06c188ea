import pytest
from pyspark.sql import functions as F

from pagelens.operators import diffs, enrichment, facets, graph, rollups

FIND = "crawl_id string, url string, check_id string, severity string, tier string, evidence string"


def _found(spark, rows):
    return spark.createDataFrame([("c", u, k, s, "REVIEW", None) for u, k, s in rows], FIND)


def _pages(spark, n, status=200):
    return spark.createDataFrame([("c", f"u{i}", status, True) for i in range(n)], "crawl_id string, url string, status int, indexable boolean")


@pytest.mark.parametrize(("base", "affected", "want"), [("Low", 1, "Low"), ("Low", 25, "Medium"), ("Low", 60, "High"), ("Critical", 60, "Critical"), ("Info", 60, "Info"), ("High", 60, "High")])
def test_scaling(spark, base, affected, want):
    got = rollups.rescale(_found(spark, [(f"u{i}", "X01", base) for i in range(affected)]), _pages(spark, 100))
    assert {r.severity for r in got.collect()} == {want}


def test_precedence(spark):
    rows = [("a", "B01", "High"), ("a", "D01", "High"), ("a", "M01", "Low"), ("b", "A04", "Critical"), ("b", "D03", "Low"), ("b", "D07", "Low"), ("c", "E01", "High"), ("c", "E02", "Medium"), ("d", "B10", "High"), ("d", "C04", "High"), ("e", "A02", "High"), ("e", "L03", "High"), ("f", "E02", "Medium")]
    got = {(r.url, r.check_id): r.severity for r in rollups.apply_precedence(_found(spark, rows)).collect()}
    assert set(got) == {(u, k) for u, k, _ in rows} - {("a", "D01"), ("c", "E02"), ("d", "C04"), ("e", "L03")}
    assert got["b", "D03"] == "Info" and got["b", "D07"] == "Low"


def test_health(spark):
    pages = _pages(spark, 10).withColumn("indexable", F.col("url") < "u8").withColumn("status", F.when(F.col("url") == "u9", 404).otherwise(200))
    score = lambda rows: rollups.health(pages, _found(spark, rows)).first().score
    assert score([]) == round(100 * (0.7 + 0.2 * 0.8 + 0.1 * 0.9))
    assert score([("u1", "A", "High"), ("u1", "B", "Critical"), ("u2", "A", "High"), ("u3", "C", "Low")]) == round(100 * (0.7 * 0.8 + 0.16 + 0.09))
    assert score([("site", f"Z{i}", "High") for i in range(9)]) == round(100 * 0.95) - 15


def test_issues_and_reports(spark):
    rows = rollups.issues(_found(spark, [("a", "B01", "High"), ("b", "B01", "Medium"), ("a", "T01", "Low"), ("a", "B01", "High")])).cache()
    got = {r.check_id: (r.severity, r.n_pages, r.urls, r.category) for r in rows.collect()}
    assert got == {"B01": ("High", 2, ["a", "b"], "Indexability"), "T01": ("Low", 1, ["a"], "Links")}
    assert [r.check_id for r in rollups.by_impact(rows).collect()] == ["B01", "T01"] and [r.check_id for r in rollups.priorities(rows).collect()] == ["B01"]
    assert {(r.kind, r.name, r.n) for r in rollups.tallies(rows).where("kind = 'severity'").collect()} == {("severity", "High", 1), ("severity", "Low", 1)}
    assert [r.domain for r in rollups.report_domains(rows).collect()] == ["B", "T"]
    assert rollups.issue_export(rows, _pages(spark, 1)).count() == 3
    assert rollups.digest(rollups.health(_pages(spark, 2), _found(spark, [])), rows).first().digest.startswith("c: 2 pages, health 100\nHigh B01: 2 pages")
    resources = spark.createDataFrame([("c", "css", "x", 200, 5), ("c", "css", "y", 0, 1), ("c", "js", "z", 404, 2)], "crawl_id string, kind string, url string, status int, bytes long")
    assert {(r.kind, r.total, r.broken, r.bytes) for r in rollups.resource_summary(resources).collect()} == {("all", 3, 2, 8), ("css", 2, 1, 6), ("js", 1, 1, 2)}


def _nodes(spark, names):
    return spark.createDataFrame([("c", n) for n in names], "crawl_id string, url string")


def _edges(spark, pairs):
    return spark.createDataFrame([("c", a, b) for a, b in pairs], "crawl_id string, src string, dst string")


def _rank(nodes, edges, rounds):
    out = {n: [b for a, b in edges if a == n and b in nodes] for n in nodes}
    pr = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(pr[n] for n in nodes if not out[n])
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for n in nodes:
            for t in out[n]:
                new[t] += 0.85 * pr[n] / len(out[n])
        pr = new
    return {n: round(100 * v / max(pr.values()), 1) for n, v in pr.items()}


def test_rank(spark):
    nodes, edges = ["h", "a", "b", "x"], [("a", "h"), ("b", "h"), ("h", "a"), ("h", "b"), ("h", "zz"), ("a", "a"), ("a", "h")]
    got = {r.url: r.authority for r in graph.pagerank(_nodes(spark, nodes), _edges(spark, edges), iterations=6).collect()}
    assert got == _rank(nodes, edges, 6) and got["h"] == 100.0


def test_depth_tree_folders(spark):
    edges = _edges(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "r"), ("c", "d"), ("s", "d")])
    seeds = spark.createDataFrame([("c", "r", 0), ("c", "s", 1)], "crawl_id string, url string, depth int")
    depths = graph.crawl_depth(seeds, edges)
    assert {(r.url, r.depth, r.parent) for r in depths.collect()} == {("r", 0, None), ("s", 1, None), ("a", 1, "r"), ("b", 1, "r"), ("c", 2, "a"), ("d", 2, "s")}
    root = spark.createDataFrame([("c", "r")], "crawl_id string, root string")
    assert {r.url: r.parent for r in graph.crawl_tree(_nodes(spark, ["r", "a", "q"]), depths, root).collect()} == {"r": None, "a": "r", "q": "r"}
    pages = _nodes(spark, ["http://h/", "http://h/a/b", "http://h/a/"])
    assert {(r.folder, r.pages) for r in graph.folders(pages).collect()} == {("/", 3), ("/a", 2), ("/a/b", 1)}
    counts = graph.link_counts(_nodes(spark, ["r", "c", "q"]), graph.crawl_edges(edges.union(edges), _nodes(spark, ["r", "c", "d", "a", "b", "s"])))
    assert {r.url: (r.outlink_count, r.inlink_count) for r in counts.collect()} == {"r": (2, 1), "c": (2, 2), "q": (0, 0)}


def test_diffs(spark):
    f = lambda rows: spark.createDataFrame(rows, "check_id string, url string, severity string")
    old, new = f([("A", "x", "High"), ("B", "y", "Low")]), f([("B", "y", "Low"), ("C", "z", "Critical"), ("D", None, "High")])
    assert {r.state: r.n for r in diffs.diff_counts(diffs.finding_diff(old, new)).collect()} == {"resolved": 1, "persisting": 1, "new": 2}
    compared = diffs.issue_compare(old, new)
    assert {(r.check_id, r.state) for r in compared.collect()} == {("A", "resolved"), ("B", "persisting"), ("C", "new")}
    assert [r.check_id for r in diffs.regressions(compared).collect()] == ["C"]
    p = lambda rows: spark.createDataFrame(rows, "url string, status int, title string")
    got = {tuple(r) for r in diffs.url_diff(p([("a", 200, "t"), ("b", 200, None)]), p([("a", 404, "t"), ("c", 200, "x")]), ("status", "title")).collect()}
    assert got == {("a", "changed", "status", "200", "404"), ("b", "missing", None, None, None), ("c", "new", None, None, None)}


def test_grid(spark):
    df = spark.createDataFrame([("B", 5, None), ("a", 10, "xy"), (None, 1, "Z")], "name string, n int, o string").withColumn("url", F.coalesce("name", F.lit("q")))
    assert [r.n for r in facets.grid_sort(df, "name").collect()] == [1, 10, 5]
    assert df.where(facets.rule("n", "greater", 4)).count() == 2 and df.where(facets.rule("name", "equals", "b")).count() == 1 and df.where(facets.rule("name", "starts", "A")).count() == 1
    assert df.where(facets.search(["name", "o"], "z")).count() == 1
    u = F.col("url")
    urls = spark.createDataFrame([("https://a/x?p=1&q=2",), ("https://a/x/y/z",)], "url string")
    assert urls.where(facets.in_scope(u, ["/x"], [r"\?"])).count() == 1 and urls.where(facets.within_limits(u, 50, 1, 2)).count() == 0 and urls.where(facets.within_limits(u, max_params=1)).count() == 1
    assert facets.cap_per(df.withColumn("k", F.lit(1)), ["k"], ["n"], 2).count() == 2


def test_metrics(spark):
    pages = spark.createDataFrame([("c", "https://a/Index.html"), ("c", "https://a/b/"), ("c", "https://a/none")], "crawl_id string, url string")
    m = spark.createDataFrame([("/index.html", 3), ("/b", 5), ("/b", 9), ("/", 1)], "path string, sessions long")
    assert {r.url: r.sessions for r in enrichment.join_ga4(pages, m).collect()} == {"https://a/Index.html": 3, "https://a/b/": 9, "https://a/none": None}
    crawls = spark.createDataFrame([(1, "p", "public"), (2, "p", "public"), (3, "q", "me"), (4, "q", "me")], "crawl_id int, client_id string, owner string")
    assert {tuple(r) for r in enrichment.latest_crawls(crawls).collect()} == {("p", 2, 1), ("q", 4, 3)}
    assert {r.crawl_id for r in enrichment.retained(crawls).collect()} == {2, 3, 4}
