"""Every page check on a page where it fires, and all of them on pages where they must be silent."""

from pyspark.sql import functions as F

from pagelens.operators.checks import CHECKS, catalogue, page_findings
from pagelens.operators.checks.registry import INPUTS, with_inputs
from pagelens.plans.extract import extract_pages

LONG = "plain words make a simple text that many people can read. " * 40
HEAD = (
    '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>A title of a good and useful length here</title><meta name="description" content="'
    + "A description with enough words to say what the page is about, so that readers know what they will find here, and why it is worth it."
    + '"><meta name="viewport" content="width=device-width, initial-scale=1"><meta name="author" content="a"><meta property="article:published_time" content="2020">'
    '<meta name="google-extended" content="index"><meta property="og:title" content="x"><meta property="og:description" content="x"><meta property="og:image" content="x">'
    '<link rel="icon" href="/i.ico"><link rel="canonical" href="{url}"><script async src="https://www.googletagmanager.com/gtm.js"></script>'
    '<link rel="preconnect" href="https://www.googletagmanager.com"><script type="application/ld+json">{{"@type": "Article", "headline": "h", "image": "i", "datePublished": "2020", "author": "a"}}</script>'
    '<script type="application/ld+json">{{"@type": "Organization", "name": "n", "url": "u", "logo": "l"}}</script>'
    '<script type="application/ld+json">{{"@type": "BreadcrumbList", "itemListElement": [1]}}</script><script type="application/ld+json">{{"@type": "FAQPage", "mainEntity": [1]}}</script>'
)
BODY = f"<body><nav><a href='/o'>other page</a></nav><main><h1>Heading one</h1><h2>Two</h2><p>{LONG}</p></main></body></html>"
HEADERS = {
    "strict-transport-security": "x", "content-security-policy": "x", "x-content-type-options": "x", "x-frame-options": "x", "referrer-policy": "x",
    "content-encoding": "gzip", "cache-control": "x",
}
URL = "https://site.example/good-page"


def _h(extra="", body=BODY, url=URL, drop=()):
    head = HEAD.format(url=url)
    for d in drop:
        assert d in head, d
        head = head.replace(d, "")
    return head + extra + "</head>" + body


def _b(extra):
    return _h(body=BODY.replace("</main>", extra + "</main>"))


D = {"render_diffs": None}
IMG = "<img src='/{}.png' alt='a' width=1 height=1 loading=lazy>"
JSONLD = '<script type="application/ld+json">{}</script>'
CANONICAL = '<link rel="canonical" href="{}">'
NOCANON = CANONICAL.format(URL)
MOBILE = ("smallTapTargets", "contentWiderThanViewport", "smallFonts", "mobile_text", "hasInterstitial", "blocked_resources")


def _mobile(**k):
    return {"mobile": tuple(k.get(n) for n in MOBILE)}


#: What makes each check fire: columns of an otherwise clean page.
FIRES = {
    "A04": {"html": _h('<meta name="robots" content="NoIndex">')}, "A05": {"headers": HEADERS | {"x-robots-tag": "noindex"}},
    "A06": {"html": _h('<meta name="robots" content="noindex, nofollow">')}, "A07": {"html": _h('<meta name="robots" content="index">'), "headers": HEADERS | {"x-robots-tag": "noindex"}},
    "A08": {"render_diffs": {"meta_robots": "modified"}}, "A09": {"inlink_count": 0, "in_sitemap": True}, "A10": {"depth": 5},
    "A11": {"url": URL + "?utm_source=a"}, "A12": {"html": _h('<meta name="robots" content="noindex">'), "inlink_count": 2},
    "A13": {"html": _b('<a href="/n" rel="nofollow">next one</a>')}, "A14": {"html": _h('<meta name="robots" content="index, nosnippet">')},
    "B01": {"status": 404}, "B02": {"status": 503}, "B03": {"html": _h(drop=["A title of a good and useful length here"]).replace("<title>", "<title>Page not found, try the search instead")},
    "B06": {"redirect_chain": ["a", "b"]}, "B07": {"redirect_chain": ["a", "b", "a"]}, "B08": {"status": 302}, "B11": {"redirect_chain": ["a"], "status": 404},
    "B12": {"html": _h('<meta http-equiv="refresh" content="0; url=/x">')}, "B13": {"url": "http://site.example/x"},
    "C01": {"html": _h(drop=[NOCANON])}, "C02": {"html": _h(CANONICAL.format("https://site.example/other"), drop=[NOCANON])}, "C04": {"status": 301},
    "C05": {"html": _h(CANONICAL.format("/z"))}, "C06": {"headers": HEADERS | {"link": '<https://site.example/z>; rel="canonical"'}},
    "C07": {"render_diffs": {"canonical": "created"}}, "C08": {"html": _h(CANONICAL.format("https://elsewhere.test/x"), drop=[NOCANON])},
    "C09": {"html": _h(CANONICAL.format("/good-page#x"), drop=[NOCANON])}, "C10": {"url": URL + "?gclid=a", "html": _h(drop=[NOCANON])},
    "C11": {"url": URL + "/page/3", "html": _h(url=URL)}, "D01": {"html": _h(drop=["A title of a good and useful length here"])},
    "D03": {"html": _h().replace("useful length", "useful length W" + "W" * 40)}, "D04": {"html": _h().replace("A title of a good and useful length here", "Short")},
    "D05": {"html": _h("<title>b</title>")}, "D07": {"html": _h().replace('name="description"', 'name="x"')}, "D09": {"html": _h().replace("A description with enough words to say what the page is about, so", "So")[:0] + _h().replace("so that readers know what they will find here, and why it is worth it.", "")},
    "D11": {"html": _h('<meta name="description" content="">')}, "D12": {"html": _h().replace("<h1>Heading one</h1>", "")}, "D13": {"html": _b("<h1>again</h1>")},
    "D15": {"html": _b("<h4>deep</h4>")}, "D16": {"html": _b("<h3> </h3>")}, "D17": {"render_diffs": {"title": "created"}}, "D18": {"html": _h('<meta name="keywords" content="a">')},
    "D19": {"html": _h(drop=['<meta property="og:image" content="x">'])}, "D20": {"html": _h(drop=['<meta name="viewport" content="width=device-width, initial-scale=1">'])},
    "D21": {"html": _b(f"<h2>{'x' * 71}</h2>")}, "E04": {"html": _h().replace(LONG, "few words")},
    "E07": {"html": _b("<p>x</p>") + "<script2>", "word_count": 40}, "E08": {"html": _b("<p>Lorem ipsum</p>")},
    "E09": {"html": _h().replace(LONG, "internationalisation characteristically institutionalised " * 60)}, "E10": {"html": _b("<span " + "data-x='" + "y" * 40000 + "'></span>")},
    "E11": {"html": _b("<div class='collapse'></div>" * 3)}, "E12": {"html": _h(drop=['"datePublished": "2020", '])},
    "F01": {"inlink_count": 0}, "F02": {"inlink_count": 1}, "F03": {"outlink_count": 151}, "F04": {"depth": 6}, "F05": {"html": _b("<a href='/e'> </a>")},
    "F06": {"html": _b("<a href='/e'>Read more</a>" * 5)}, "F07": {"status": 301, "inlink_count": 3}, "F08": {"html": _b("<a>no</a><a name=x>no</a><a id=y>no</a>")},
    "F09": {"html": _b("<a href='/e' rel='nofollow'>e text</a>")}, "F10": {"render_diffs": {"internal_links": "created"}},
    "F11": {"depth": 2, "html": _h(drop=['<script type="application/ld+json">{"@type": "BreadcrumbList", "itemListElement": [1]}</script>'])},
    "F12": {"html": _b("<a href='http://site.example/x'>insecure one</a>")}, "G03": {"html": _b("<a href='http://o.test/x'>outside</a>")},
    "G04": {"html": _b("<a href='https://x.doubleclick.net/x'>paid</a>")}, "G06": {"html": _b("<a href='https://o.test/x' target=_blank>outside</a>")},
    "H01": {"html": _b("<img src='/a.webp' width=1 height=1>")}, "H02": {"html": _b("<img src='/a.webp' alt='x' role=presentation width=1 height=1>")},
    "H03": {"html": _b(f"<img src='/a.webp' alt='{'x' * 101}' width=1 height=1>")}, "H05": {"html": _b("<img src='/a.webp' alt='x'>")}, "H07": {"html": _b(IMG.format("a"))},
    "H08": {"html": _b(IMG.format("a") * 3 + "<img src='/d.webp' alt='a' width=1 height=1>")}, "H09": {"html": _b("<img src='/a.webp' alt=a width=1 height=1>"), "lcp_src": "https://site.example/a.webp"},
    "I03": {"html": _h("<link rel=alternate hreflang='english' href='/x'>")}, "I04": {"html": _h("<link rel=alternate hreflang='en' href='/x'>")},
    "I05": {"html": _h("<link rel=alternate hreflang='de' href='https://site.example/de'>" + CANONICAL.format("https://site.example/de"), drop=[NOCANON])},
    "I06": {"html": _h("<link rel=alternate hreflang='de' href='/d'><link rel=alternate hreflang='de' href='/e'>")}, "I08": {"html": _h("<link rel=alternate hreflang='de' href='/d'>")},
    "J01": {"html": _h(JSONLD.format('{"@type": "Product"}'))}, "J02": {"html": _h(JSONLD.format('{"@type": "Product", "name": "a"}'))}, "J03": {"html": _h(JSONLD.format("{"))},
    "J04": {"html": _b("<div itemtype='https://schema.org/Thing'></div>")}, "J05": {"html": _h().replace(LONG, "x")},
    "J08": {"html": _h().replace("BreadcrumbList", "Thing")}, "J09": {"html": _h(drop=[', "author": "a"'])},
    "J10": {"html": _h().replace("FAQPage", "Thing").replace("plain words make", "frequently asked")}, "J12": {"html": _h(JSONLD.format('{"@type": "X", "aggregateRating": {"ratingValue": "9"}}'))},
    "J13": {"render_diffs": {"structured_data": "modified"}}, "J14": {"html": _h(JSONLD.format('{"@graph": [{"@type": "Offer", "price": 1}]}'))},
    "J15": {"html": "<body><div typeof='Thing'>a</div>"}, "M01": {"url": "http://site.example/x"}, "M02": {"html": _b("<img src='http://o.test/a.webp' alt=a>")},
    "M03": {"headers": {"server": "x"}}, "M05": {"html": _b("<img src='//o.test/a.webp' alt=a>")}, "M06": {"headers": {"server": "x"}},
    "M07": {"html": _b("<a href='/x' target='_blank'>new one</a>")}, "M08": {"headers": HEADERS | {"server": "nginx/1.25"}}, "M09": {"html": _h('<meta name="generator" content="WordPress 6">')},
    "N01": {"lcp_s": 3.0}, "N02": {"inp_ms": 300.0}, "N03": {"cls": 0.2}, "N04": {"ttfb_ms": 900.0}, "N05": {"html": _h("<link rel=stylesheet href=/a.css>")},
    "N06": {"html": _b("<script src=/a.js></script>" * 3)}, "N07": {"headers": {"cache-control": "x"}, "html": _b("<p>" + LONG * 3)}, "N08": {"headers": {"content-encoding": "x"}, "html": _b(IMG.format("a") * 5)},
    "N09": {"html": _b("<i></i>" * 1501)}, "N10": {"html": _b("<!--" + "x" * 2_500_001 + "-->")}, "N11": {"html": _b(IMG.format("a") * 101)},
    "N12": {"html": _h("<script src=https://cdn.test/a.js></script>", drop=['<link rel="preconnect" href="https://www.googletagmanager.com">'])},
    "N13": {"html": _h("<style>@font-face{}</style>")}, "N14": {"html": _h("<script src=https://static.hotjar.com/a.js></script>" * 3)},
    "O01": {"html": _h().replace(", initial-scale=1", "")}, "O02": _mobile(smallTapTargets=5), "O03": _mobile(contentWiderThanViewport=True), "O04": _mobile(smallFonts=5),
    "O05": _mobile(mobile_text="x"), "O06": _mobile(hasInterstitial=True), "O07": _mobile(blocked_resources=["a"]), "P01": {"raw_text": "x", "rendered_text": "y" * 501},
    "P02": {"raw_hrefs": ["/a"], "rendered_hrefs": ["/a", "/b"]}, "P03": {"rendered_facts": ("other", None, None, None)}, "P04": {"agentic": (["e"], None)}, "P05": {"render_ms": 3001.0},
    "P06": {"raw_text": "x", "rendered_text": "y" * 501, "html": _b("<div id=root></div>")}, "Q01": {"html": _b("<button></button>")}, "Q02": {"html": _b("<i aria-lable=x>a</i>")},
    "Q03": {"html": _b("<input type=text>")}, "Q04": {"axe_violations": ["color-contrast"]}, "Q05": {"html": _b("<div aria-hidden=true><button>x</button></div>")},
    "Q06": {"html": _b("<div role=listitem>x</div>")}, "Q07": {"html": _h().replace(' lang="en"', "")}, "Q08": {"html": _b("<div onclick=x()>x</div>")}, "Q09": {"html": "<html><body>a"},
    "R01": {"html": _h('<meta name="GPTBot" content="noindex">')}, "R02": {"html": _h('<meta name="PerplexityBot" content="noindex">')}, "R03": {"html": _h('<meta name="ChatGPT-User" content="noindex">')},
    "R05": {"raw_text": "x", "rendered_text": "y" * 101}, "R06": {"html": _b("<div class='Paywall-box'></div>")}, "R07": {"html": _h().replace("<p>", "<p>short</p><p>")},
    "R08": {"html": _h().replace("<h2>Two</h2>", "") .replace(LONG, LONG * 2)}, "R09": {"html": _h(drop=['<meta name="author" content="a">'])}, "R10": {"html": _h().replace("Organization", "Thing")},
    "R11": {"html": _h(drop=['<meta name="google-extended" content="index">'])}, "R12": {"html": _h().replace("FAQPage", "Thing")},
    "R13": {"html": _h().replace(LONG, "internationalisation characteristically institutionalised " * 120)}, "S02": {"url": "https://site.example/llms.txt", "html": "text"},
    "S03": {"url": "https://site.example/llms.txt", "html": "<a href=/x>x</a>" * 801}, "S05": {"html": _b("<button></button>")}, "S06": {"html": _b("<div role=listitem>x</div>")},
    "S07": {"html": _b("<button aria-hidden=true>x</button>")}, "S08": {"agentic": ([], 0.2)}, "S09": {"html": _b("<form></form>")}, "S10": {"html": _b("<form data-mcp='{'></form>")},
    "S11": {"url": "https://site.example/checkout", "html": _b("<form></form>")}, "S12": {"render_diffs": {"internal_links": "modified"}}, "S13": {"html": _h("<script>G-ABCDEF1</script>")},
    "T01": {"url": "https://site.example/Good"}, "T02": {"url": "https://site.example/a%20b"}, "T03": {"url": "https://site.example/a/b/a"}, "T04": {"url": URL + "x" * 120},
    "T05": {"url": URL + "?sid=1"}, "T06": {"url": "https://site.example/a/b/c/d/e"}, "T07": {"url": URL + "?page_id=1"}, "T09": {"url": "https://site.example/a_b"},
    "U01": {"url": URL + "?page=2", "html": _h("<meta name=robots content=noindex>")}, "U02": {"html": _h('<link rel="next" href=/a><link rel="next" href=/b>')},
    "U03": {"url": URL + "?page=2"}, "U04": {"html": _b("<div class=load-more></div>")}, "U05": {"url": URL + "/page/2"}, "V01": {"url": "https://site.example/category/uncategorized/x"},
    "V02": {"url": "https://site.example/tag/x"}, "V03": {"url": URL + "?attachment_id=1"}, "V04": {"url": URL + "/comment-page-2"}, "V05": {"url": URL + "?s=x"},
    "V06": {"html": _b("Yoast SEO Rank Math")}, "V07": {"html": _h(CANONICAL.format("/z"))}, "V08": {"html": _b(IMG.format("a") * 3)}, "V09": {"url": "https://site.example/x/feed/"},
    "V10": {"url": "https://staging.site.example/"}, "V11": {"html": _b("".join(f"wp-content/plugins/p{i}/" for i in range(21)))}, "V12": {"url": "https://site.example/wp-json/wp/v2/users"},
    "W01": {"html": _h(drop=['<script async src="https://www.googletagmanager.com/gtm.js"></script>'])}, "W02": {"url": "https://site.example/"}, "W03": {"html": _h(drop=['<link rel="icon" href="/i.ico">'])},
}
SILENT = {"D10"}


def test_each_fires_and_none_on_a_clean_page(spark):
    assert set(FIRES) | SILENT == set(CHECKS)
    base = {"url": URL, "html": None, "status": 200, "headers": HEADERS, "redirect_chain": [], "depth": 1, "ttfb_ms": 100.0, "in_sitemap": True, "inlink_count": 4, "outlink_count": 5}
    extra = {n: None for n in INPUTS if n not in base}
    rows = []
    for name, change in {"clean": {}, **FIRES}.items():
        row = base | extra | change
        word_count = row.pop("word_count", None)
        row["html"] = row["html"] if row["html"] is not None else _h(url=URL)
        rows.append((name, word_count, *row.values()))
    names = ["crawl_id", "wc", *(base | extra)]
    kinds = {"crawl_id": "string", "wc": "int", "url": "string", "html": "string", "status": "int", "headers": "map<string,string>", "redirect_chain": "array<string>", "depth": "int", "ttfb_ms": "double", "in_sitemap": "boolean"} | INPUTS
    pages = extract_pages(spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names)))
    pages = pages.withColumn("word_count", F.coalesce("wc", "word_count")).cache()
    found = {}
    for r in page_findings(pages).collect():
        found.setdefault(r.crawl_id, set()).add(r.check_id)
    assert found.get("clean", set()) == set()
    assert [k for k in FIRES if k not in found.get(k, ())] == []
    assert page_findings(with_inputs(pages).limit(0)).count() == 0


def test_catalogue(spark):
    rows = catalogue(spark).collect()
    assert len(rows) == len(CHECKS) and {r.severity for r in rows} == {"Critical", "High", "Medium", "Low", "Info"} and {r.tier for r in rows} == {"AUTO", "REVIEW", "FLAG"}
