from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagelens.functions import text as X
from pagelens.functions import urls as U
from pagelens.functions.vectors import cosine


def _one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_join_url(spark):
    base = "https://a.example/b/c/d;p?q=1#f"
    refs = ["g", "./g", "g/", "/g", "//h.example/x", "?y", "g?y", "#s", "g#s", "", "..", "../g", "../../g", "../../../g", ".", "https://z.example/", "mailto:x", "g/../h", " g "]
    got = _one(spark, [(base, r) for r in refs], "b string, r string", U.join_url(F.col("b"), F.col("r")))
    assert [g[0] for g in got] == [urljoin(base, r.strip()) for r in refs]


def test_normal_forms(spark):
    rows = [
        ("HTTP://WWW.Example.com//a///b?utm_source=x&k=v&e=#frag", "http://www.example.com/a/b?k=v&e=", "http://www.example.com/a/b?utm_source=x&k=v&e="),
        ("https://x.org", "https://x.org/", "https://x.org/"),
        ("https://x.org/?sid=1&GCLID=2", "https://x.org/", "https://x.org/?sid=1&GCLID=2"),
    ]
    got = _one(spark, rows, "u string, a string, b string", U.normalize_url(F.col("u")) == F.col("a"), U.norm_url(F.col("u")) == F.col("b"))
    assert got == [(True, True)] * 3


def test_domains_templates_segments(spark):
    c = F.col("u")
    rows = [("https://shop.a.co.uk:80/2024/abc-def-ghi-jkl/12/0a1b2c3d4e?x",), ("https://www.b.com/",), (None,)]
    got = _one(spark, rows, "u string", U.registrable_domain(U.host(c)), U.url_template(c), U.self_canonical(c), U.segment_of(c, [("shop", "shop"), ("all", ".")]))
    assert got[0] == ("a.co.uk", "/{year}/{slug}/{id}/{id}", "https://shop.a.co.uk:80/2024/abc-def-ghi-jkl/12/0a1b2c3d4e?x", "shop")
    assert got[1] == ("b.com", "/", "https://www.b.com/", "all") and got[2][3] is None
    assert _one(spark, [("https://a.com/x?a=1&b=2#f",)], "u string", U.rewrite_url(c, ["a"], [("/x", "/Y")], True)) == [("https://a.com/y?b=2#f",)]
    assert _one(spark, [("/a/index.html",), ("/a/",)], "u string", U.path_variants(c)) == [(["/a/index.html", "/a/index.html/", "/a/"],), (["/a/", "/a"],)]
    assert _one(spark, [("bücher.de",), ("a.b",), (None,)], "u string", U.idna_host(c)) == [("xn--bcher-kva.de",), ("a.b",), (None,)]


def _flesch(text):
    import re

    words = text.split()
    if not words:
        return None

    def syllables(w):
        w = w.lower().strip(".,!?;:\"'()")
        n = len(re.findall("[aeiouy]+", w))
        return max(1, n - (w.endswith("e") and n > 1)) if w else 0

    return round(206.835 - 1.015 * len(words) / max(1, len(re.findall("[.!?]+", text))) - 84.6 * sum(map(syllables, words)) / len(words), 1)


def test_text(spark):
    texts = ["The quick brown fox. It jumped! Over time?", "", "(Hello) 'there' -- ...", "make take. bee"]
    t = F.col("t")
    got = _one(spark, [(x,) for x in texts], "t string", X.flesch(t), X.word_count(t), F.size(X.shingles(t, 2)))
    assert [g[0] for g in got] == [_flesch(x) for x in texts]
    assert [g[1] for g in got] == [len(x.split()) for x in texts] and [g[2] for g in got] == [7, 0, 3, 2]
    widths = {"i": 4, "W": 17, "é": 10, " ": 5, "'": 3}
    assert _one(spark, [("iWé '",), (None,)], "t string", X.pixel_width(t)) == [(sum(widths.values()),), (0,)]
    assert _one(spark, [("\t a b \n",)], "t string", X.strip_ws(t)) == [("a b",)]
    assert _one(spark, [("en_us",), ("zh-Hant",), ("de",)], "t string", X.language_code(t)) == [("en-US",), ("zh-TW",), ("de-DE",)]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    got = _one(spark, rows, "a array<double>, b array<double>", cosine(F.col("a"), F.col("b")))
    assert got[0][0] == pytest.approx(0.5**0.5) and [g[0] for g in got[1:]] == [0.0, 0.0, 0.0]
