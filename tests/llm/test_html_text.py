import html
import re

from pagelens.llm import html_text as H
from pagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PAGE = """<html><body><div id="header"><a href=/>Home</a> site</div><div class="wrap"><div class="sidebar">Side text here, long enough to be annoying.</div>
<div class="content"><h1>Title</h1><p>First para &amp; <a href=x>link</a> text.   <p>Second para<br>line two<ul><li>one<li>two</ul>
<script>var x = "<p>no</p>";</script><style>p{}</style><!-- hidden <p>comment --><form><input value=q>Search</form>
<div class="comments"><p>Nice post!</p></div></div></div><div class="cookie-notice">We use cookies</div><footer>foot</footer></body></html>"""


def test_article_without_what_stands_around_it():
    assert H.extract(PAGE) == "Title First para & link text. Second para line two one two"


def test_malformed_and_empty():
    assert [H.extract(x) for x in ("", "<p>x", "text only", "<div><nav>a</nav></div>", "<", "<p", "</p></div>", "&amp;", "<b>a<i>b</b>c</i>", "<script>a")] == [
        "", "x", "text only", "", "<", "", "", "&", "abc", "",
    ]
    deep = "<div>" * 30000 + "x" + "</div>" * 30000
    assert H.extract(deep) == "x"


TEXT = "This is the first sentence of the article. It goes on for a while, so that it has weight."


def test_names_that_only_sound_like_something_beside_the_article():
    wrapped = f'<body><nav><a href=/>Home</a></nav><div class="content has-sidebar side-by-side comments-open"><article><h1>Head</h1><p>{TEXT}</p></article></div></body>'
    assert H.extract(wrapped) == f"Head {TEXT}"
    assert H.extract(f'<body><article><div class="entry-header"><h1>Head</h1></div><p>{TEXT}</p></article></body>') == f"Head {TEXT}"
    in_values = f'<body><article><p title="the hidden truth">{TEXT}</p><p>See <a href="/guide/hidden-costs" data-role="search nav">hidden costs</a> too.</p></article></body>'
    assert H.extract(in_values) == f"{TEXT} See hidden costs too."


def test_forms_labels_and_formulas():
    form = f'<body><form id="aspnetForm"><div class="search"><input><label>Find</label></div><label>Name <input></label><div><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></div></form></body>'
    assert H.extract(form) == f"Head {TEXT} {TEXT}"
    inside = f"<body><article><p>{TEXT}</p><p><label>Figure 1</label> <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><form><p>Send us a word.</p><input><label>Mail</label></form></article></body>"
    assert H.extract(inside) == f"{TEXT} Figure 1 x=2"
    assert H.extract(f"<body><svg/><p>{TEXT}</p><svg><text>drawn</text></svg><p>{TEXT}</p></body>") == f"{TEXT} {TEXT}"


def test_density_decides_without_and_with_article_elements():
    rights = "<div>&copy; 2020 Someone. All rights reserved.</div>"
    assert H.extract(f"<body><div id=a>A short introduction.</div><div id=b><p>{TEXT}</p><p>{TEXT}</p></div>{rights}</body>") == f"A short introduction. {TEXT} {TEXT}"
    links = "".join(f'<li><a href="/{i}">Another story number {i}</a></li>' for i in range(9))
    assert H.extract(f"<body><div><ul>{links}</ul></div><div><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></div></body>") == f"Head {TEXT} {TEXT}"
    assert H.extract(f"<body><h1>Head</h1><article><p>Teaser.</p></article><div><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div></body>") == f"Head {TEXT} {TEXT} {TEXT}"
    assert H.extract(f"<body><div class=ad>{TEXT} {TEXT}</div><article><h1>Short.</h1><p>So short.</article></body>") == "Short. So short."
    two = f"<body><main><h1>Head</h1><article><p>{TEXT}</p></article><article><p>{TEXT} Twice.</p></article><div><ul>{links}</ul></div></main></body>"
    assert H.extract(two) == f"Head {TEXT} {TEXT} Twice."


def test_headers_and_comments():
    site = f"<body><div id=page><header><h1>Site</h1></header><div class=post><header><h1>Head</h1></header><p>{TEXT}</p><p>{TEXT}</p><div class='post-comments'><article class=comment><p>{TEXT * 5}</p></article></div></div></div></body>"
    assert H.extract(site) == f"Head {TEXT} {TEXT}"


def _article(inside="", after=""):
    return f"<body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{TEXT}</p>{inside}<p>{TEXT}</p></article>{after}</body>"


def test_what_stands_inside_an_article_element_but_is_not_of_it():
    plain = f"Head {TEXT} {TEXT}"
    stories = "".join(f"<li><a href=/{i}>Story number {i}</a>" for i in range(3))
    for x in (
        "<div class='newsletter-form'><p>Sign up for our letter today.</p></div>",
        "<ins class='adsbygoogle'>Buy now cheap</ins>",
        "<section class='discussion'><h2>Reader comments</h2><p>I liked this a lot.</p></section>",
        "<div><h3>2 comments</h3><p>I liked this a lot.</p><p>So did I.</p></div>",
        "<div class='more-stories'><h2>More</h2><article><p>A teaser of another one.</p></article></div>",
        f"<div><h3>Read on</h3><ul>{stories}</ul></div>",
        "<aside>By the way.</aside>",
    ):
        assert H.extract(_article(x)) == plain, x
    liked = "<article><p>I liked this piece a lot, and so did all of my friends here.</p></article>"
    assert H.extract(_article(after=f"<section id='discussion'><h2>Discussion</h2>{liked}{liked}{liked}</section>")) == plain
    beside = "<div class='wp-sidebar-widget'>Side text goes here today.</div><div class='cc-window'>We use cookies to make this site better.</div>"
    assert H.extract(f"<body>{beside}<div id=b><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></div></body>") == plain


def test_what_sounds_like_something_else_but_is_of_the_article():
    """Names propose only: density, the share of the text and the heading keep these."""
    for x, text in (
        ("<section id=discussion><h2>Discussion</h2><p>What follows from this is discussed here.</p></section>", "Discussion What follows from this is discussed here."),
        (f"<div class='share-price'>{TEXT} {TEXT} {TEXT}</div>", f"{TEXT} {TEXT} {TEXT}"),
        ("<ul><li>See <a href=1>one</a> of the sources first<li>then <a href=2>two</a> of the others<li>and <a href=3>three</a> at the end</ul>", "See one of the sources first then two of the others and three at the end"),
        ("<p class='notice-of-change'>It has changed.</p>", "It has changed."),
        ("<p>Bake the cookies.</p>", "Bake the cookies."),
    ):
        assert H.extract(_article(x)) == f"Head {TEXT} {text} {TEXT}", x
    assert H.extract(f"<body><div>A recipe for cookies.</div><div id=b><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></div></body>") == f"A recipe for cookies. Head {TEXT} {TEXT}"


def test_density_changes_the_result_on_pages_that_carry_such_parts(spark):
    """Each page of the table with a part put into its article, against the page as it is."""
    parts = ["<div class='wp-related-posts'><p>More of it.</p></div>", "<div><article><p>Teaser.</p></article></div>", "<div class='x'><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div>"]
    for i, r in enumerate(spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()):
        assert H.extract(r.html.replace("</h1>", "</h1>" + parts[i % 3], 1)) == H.extract(r.html)


def test_query_against_the_article_element(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op5_html_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.sub(r"</?(?:p|br|h1)[^>]*>", " ", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        assert r.text == " ".join(html.unescape(re.sub("<[^>]+>", "", article)).split()) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "", "t"), (1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in H.main_texts(df).collect()) == [("", 0), ("", 0), ("a", 1), ("a", 1)]
    assert H.main_texts(df.limit(0)).count() == 0
