from pagelens.plans import extract as E
from pagelens.plans.page_parser import parse_page

CLEAN = """<!doctype html><html lang="en"><head><meta charset=utf-8><title>Clean Page Title</title><meta name="description" content="d">
<link rel="canonical" href="/clean"><link rel="alternate" hreflang="de" href="/de"><meta property="og:title" content="t"><script type="application/ld+json">{"@graph":[{"@type":"Article"},{"@type":["A","B"]}]}</script>
<link rel=stylesheet href=a.css></head><body><h1> One  </h1><h1></h1><p>Ten words of text stand in this paragraph, or more.<p>Second <b>bold</b> one
<a href="/x" rel="nofollow noopener" target=_blank>X</a><a href="mailto:a@b">m</a><a href="https://o.example/">O</a><a>none</a><img src="/image.png" alt="A nice image" width=10 height=x srcset="b.png 2x, c.png"><form></form>
<script>var a = "<p>not text</p>";</script><ul><li>a<li>b</ul></body></html>"""


def test_page():
    p = parse_page("http://localhost:8080/clean", CLEAN)
    assert (p["title"], p["title_count"], p["canonical"], p["canonical_in_head"]) == ("Clean Page Title", 1, "http://localhost:8080/clean", True)
    assert p["h1"] == ["One"] and p["lang"] == "en" and p["meta_desc"] == "d" and p["forms_count"] == 1
    assert [(x["href"], x["anchor"], x["is_internal"], x["rel"]) for x in p["links"]] == [("http://localhost:8080/x", "X", True, ["nofollow", "noopener"]), ("https://o.example/", "O", False, [])]
    assert [(i["src"], i["alt"], i["width"], i["height"], i["srcset"]) for i in p["images"]] == [
        ("http://localhost:8080/image.png", "A nice image", 10, None, ["http://localhost:8080/b.png", "http://localhost:8080/c.png"])
    ]
    assert p["jsonld"][0]["types"] == ["Article", "A", "B"] and p["hreflang"] == [{"lang": "de", "href": "/de"}] and p["og"] == {"og:title": "t"}
    assert "not text" not in p["main_text"] and len(p["main_text"].split()) > 10
    assert [e["tag"] for e in p["elements"] if e["tag"] == "li"] == ["li", "li"] and {e["parent_id"] for e in p["elements"] if e["tag"] == "li"} != {None}


def test_broken_pages_never_fail():
    for html in ["", "<", "<p", "</p>", "<![x", "<a href='http://[bad'>x</a>", "<script>", "<script type=application/ld+json>{</script>", "\x00<b>"]:
        parse_page("http://a/", html)


def test_job_and_children(spark):
    pages = spark.createDataFrame([("http://localhost:8080/clean", CLEAN, 1, {"x-robots-tag": "NoIndex"}), ("http://a.example/", None, 2, None)], "url string, html string, k int, headers map<string,string>")
    out = E.extract_pages(pages).cache()
    a, b = sorted(out.collect(), key=lambda r: r.k)
    assert a.k == 1 and not a.indexable and a.indexability_reason == "x_robots_noindex" and a.size == len(CLEAN) and a.word_count == len(a.main_text.split())
    assert b.indexable and b.word_count == 0 and b.title is None and b.readability is None
    assert E.child(out, "links").count() == 2 and E.image_candidates(out).count() == 3 and E.resource_sweep(out).count() == 1
    assert E.child(out, "elements").where(E.css_filter("a[target=_blank]")).count() == 1
    found = {r.name: r["values"] for r in E.regex_extractors(out.where("k = 1"), {"alt": 'alt="([^"]*)"'}, {"li": "<li>"}).collect()}
    assert found == {"alt": ["A nice image"], "li": ["2"]}


def test_render_diffs(spark):
    make = lambda html: E.extract_pages(spark.createDataFrame([("http://a.example/", html)], "url string, html string"))
    raw = "<title>a</title><a href=/x>x</a><meta name=robots content=noindex>"
    got = {r.element: r.state for r in E.render_diffs(make(raw), make("<title>b</title><link rel=canonical href=/c><a href=/x>x</a><a href=/x>x</a><a href=https://o.example>o</a>")).collect()}
    assert got == {"title": "modified", "canonical": "created", "meta_robots": "deleted", "internal_links": "duplicated", "external_links": "created"}


def test_headers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("sid=1; Path=/, lang=de; Secure", "Text/HTML; charset=x"), (None, None)], "c string, t string")
    got = [tuple(r) for r in df.select(E.cookie_names(F.col("c")), E.is_page_like(F.col("t")), E.is_html_document(F.col("t"))).collect()]
    assert got == [(["sid", "lang"], True, True), ([], True, True)]


def test_areas_xpath_gates(spark):
    from pyspark.sql import functions as F

    html = "<html><head><title>t</title></head><body><nav class='n'>menu</nav><div id=main class='a b'>Main <i>text</i><p class=ad>ad</p></div><script>x</script></body></html>"
    pages = E.extract_pages(spark.createDataFrame([("https://a.example/", html)], "url string, html string")).cache()
    text = lambda **k: E.with_content_area(pages, **k).select("main_text", "word_count").first()
    assert tuple(text(include=("div#main.a",), exclude=(".ad",))) == ("Main text", 2)
    assert text(exclude=("nav",)).main_text == "Main text ad" and text(include=("article",)).main_text == "menu Main text ad" and text().main_text == "menu Main text ad"
    got = {r.name: r["values"] for r in E.xpath_extractors(pages, {"p": "//div/p/text()", "id": "//div/@id"}).collect()}
    assert got == {"p": ["ad"], "id": ["main"]}
    off = E.gated(pages, content_hash=False, jsonld=False, types=False).first()
    assert off.content_hash == "" and off.jsonld == [] and E.gated(pages).first().content_hash != ""
    assert pages.select(E.readable_text(F.col("html"))).first()[0] == "t Main text ad"
