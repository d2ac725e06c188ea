import gzip
import random
import re

from pagelens import sources
from pagelens.operators import robots


def test_nested_indexes_name_spaces_cdata_and_gzip(spark, tmp_path):
    bodies = {
        "root.xml": '<?xml version="1.0"?>\n<!-- x --><sitemapindex xmlns="http://s"><sitemap><loc>one.xml</loc></sitemap><sitemap><loc>root.xml</loc></sitemap></sitemapindex>',
        "one.xml": '<n:sitemapindex xmlns:n="http://s"><n:sitemap><n:loc>\n two.xml.gz </n:loc></n:sitemap></n:sitemapindex>',
        "two.xml.gz": "<sitemapindex><sitemap><loc><![CDATA[three.xml]]></loc></sitemap><sitemap><loc>gone.xml</loc></sitemap></sitemapindex>",
        "three.xml": '﻿<ns:urlset xmlns:ns="http://s" xmlns:image="http://i"><ns:url><ns:loc>https://a/1?x=1&amp;y=2</ns:loc><ns:lastmod>2024-01-02T03:04:05Z</ns:lastmod><image:image><image:loc>https://a/i.png</image:loc></image:image></ns:url><ns:url><ns:loc><![CDATA[https://a/2?a&b]]></ns:loc></ns:url></ns:urlset>',
        "other.xml": "<urlset><url><loc>https://a/none</loc></url></urlset>",
        "broken.xml": "<urlset><url><loc>https://a/3</loc><lastmod>never</lastmod></url><url><n:loc> https://a/4&amp;z</n:loc></url><url><loc>https://a/5",
        "empty.xml": "",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(gzip.compress(body.encode()) if name.endswith(".gz") else body.encode())
    files = sources.read_sitemap_files(spark, str(tmp_path)).selectExpr("'c' as crawl_id", "regexp_extract(file, '[^/]+$', 0) as file", "body")
    reached = sources.follow_sitemaps(spark.createDataFrame([("c", "root.xml"), ("c", "broken.xml"), ("c", "empty.xml")], "crawl_id string, file string"), files)
    assert {(r.file, r.level) for r in reached.collect()} == {("root.xml", 0), ("one.xml", 1), ("two.xml.gz", 2), ("three.xml", 3), ("broken.xml", 0)}  # Spark reads no files without a byte
    got = {(r.file, r.url, str(r.lastmod)) for r in sources.sitemap_entries(reached).collect()}
    assert got == {("three.xml", "https://a/1?x=1&y=2", "2024-01-02 03:04:05"), ("three.xml", "https://a/2?a&b", "None"), ("broken.xml", "https://a/3", "None"), ("broken.xml", "https://a/4&z", "None")}
    assert sources.follow_sitemaps(reached.select("crawl_id", "file").limit(0), files).count() == 0
    assert {r.level for r in sources.follow_sitemaps(reached.select("crawl_id", "file").where("file = 'root.xml'"), files, max_level=1).collect()} == {0, 1}


def _plain(path, group):
    """The longest rule that fits, allow on a tie."""
    best = max(((len(p), allow) for allow, p in group if re.match("".join(".*" if c == "*" else "$" if c == "$" and k == len(p) - 1 else re.escape(c) for k, c in enumerate(p)), path, re.S)), default=(0, True))
    return best[1]


def test_rules_of_large_files_meet_few_addresses(spark):
    r = random.Random(9)
    part = lambda: r.choice(["shop", "item", "a", "b", "x.css", "private", "q$", "é"])
    rules = [(r.random() < 0.4, "/" + "/".join(part() for _ in range(r.randint(0, 3))) + r.choice(["", "", "/", "*", "$", "*.css$", "?p=*"])) for _ in range(150)]
    rules += [(False, f"/shop/item-{k:04d}") for k in range(1000)] + [(True, "*/open"), (False, "/*.pdf$")]
    text = "User-agent: big\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules) + "\n\nUser-agent: *\nDisallow: /b\n"
    sites = spark.createDataFrame([("s", text), ("t", "User-agent: other\nDisallow: /"), ("n", None)], "crawl_id string, robots_txt string")
    paths = ["/" + "/".join(part() for _ in range(r.randint(0, 4))) + r.choice(["", "/", "/open", ".pdf", "?p=1"]) for _ in range(300)] + [f"/shop/item-{k:04d}/x" for k in range(0, 1000, 7)]
    asked = [(c, f"https://h.example{p}", agent) for p in dict.fromkeys(paths) for c, agent in (("s", "BIG"), ("s", "unknown"), ("t", "big"), ("n", "big"))]
    frame, table = spark.createDataFrame(asked, "crawl_id string, url string, agent string"), robots.robots_rules(sites)
    got = {(x.crawl_id, x.url, x.agent): x.allowed for x in robots.robots_allowed(frame, table).collect()}
    path = lambda u: u.removeprefix("https://h.example")
    want = {(c, u, a): _plain(path(u), rules if a == "BIG" else [(False, "/b")]) if c == "s" else True for c, u, a in asked}
    assert {k: (v, got.get(k)) for k, v in want.items() if got.get(k) != v} == {}
    large = "User-agent: *\nDisallow: /*.pdf$\nAllow: /shop\n" + "\n".join(f"Disallow: /shop/item-{k:04d}" for k in range(1000))
    table = robots.robots_rules(spark.createDataFrame([("s", large)], "crawl_id string, robots_txt string"))
    items = frame.where("url like '%/shop/item-%' and crawl_id = 's'")
    assert items.count() < robots.matching_rules(items, table).count() <= 3 * items.count()
