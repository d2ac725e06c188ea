"""Checks are compiled, read a page once and look for a pattern only where it can be; F18."""

import random

from pyspark.sql import functions as F

from pagelens.functions import text as X
from pagelens.operators import site_checks as S
from pagelens.operators.checks import page_findings
from pagelens.operators.checks import content, markup, readiness
from pagelens.operators.checks.rules import html, n_html
from pagelens.plans import page_parser
from pagelens.plans.extract import extract_pages

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_generator_only_opens_what_a_projection_has_made(spark):
    pages = extract_pages(spark.read.parquet(f"{SF}/pages.parquet").limit(5))
    plan = _plan(page_findings(pages))
    assert "Generate inline(_found" in plan
    assert "filter(array(CASE" not in plan and "size(array(CASE" not in plan


def test_silent_checks_give_no_rows(spark):
    pages = spark.createDataFrame([("c", "u", "")], "crawl_id string, url string, html string")
    never = S._page_findings(pages, {"V13": (F.lit(None).cast("boolean"), None), "V14": (F.lit(False), None)})
    assert never.count() == 0


def test_validation_reads_pages_once(spark):
    pages = extract_pages(spark.read.parquet(f"{SF}/pages.parquet").limit(5))
    assert _plan(S.validation_checks(pages)).count("MapInArrow") == 1


def test_has_text_is_what_strip_ws_leaves(spark):
    r = random.Random(5)
    texts = ["", " ", "\n", " ", " ", " a", "a ", " x ", "\x1f", *("".join(r.choices(" \t\n\r\x0b\f  a.", k=r.randint(0, 5))) for _ in range(300)), None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~X.has_text(F.col("t")).eqNullSafe(X.strip_ws(F.col("t")) != "")).count() == 0


def test_parts_lose_no_match(spark):
    r = random.Random(7)
    said = ["lorem<b>ipsum", "Dolor Sit AMET", "consectetur adipiscing", "Your text here", "SAMPLE TEXT", "insert text here", "placeholder text", "lorem <i>ipsum", "G-ABC1234", "g-abc1234", "googletagmanager.com/gtag", "FAQ", "How To", "add to cart", "frequently asked", "faqs"]
    marked = ['<META content=x NAME="Keywords">', "<meta name='viewport'>", '<LINK REL="canonical">', '<link rel="shortcut ICON">', 'REL="NEXT"', "rel='prev'", 'CLASS="x TAB-PANE y"', "<p HIDDEN>", 'style="a:b;DISPLAY : none"', '<div class="is-hidden">', 'ONCLICK="window.open()"', 'class="BreadCrumb"', '<meta HTTP-EQUIV="Refresh" content="0;URL=x">']
    texts = [" ".join(r.choices(said + marked + ["İı", "word", "ſ"], k=r.randint(0, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(t, t) for t in [*texts, ""]], "html string, main_text string")
    stripped = X.strip_tags(F.col("html"))
    same = [
        (F.coalesce(stripped.rlike(content.PLACEHOLDER), F.lit(False)), content.mentions(*content.PLACEHOLDER_WORDS) & stripped.rlike(content.PLACEHOLDER)),
        (F.lower("main_text").rlike(r"\b(faq|frequently asked|how to|add to cart)\b"), markup.mentions(*markup.ASKS, of="main_text") & F.lower("main_text").rlike(r"\b(faq|frequently asked|how to|add to cart)\b")),
        (F.lower("html").rlike("infinite-scroll|infinitescroll|load-more|load_more|data-infinite"), readiness.mentions(*readiness.INFINITE)),
        (n_html(content.HIDDEN), n_html(content.HIDDEN, "tab-pane", "collapse", "hidden", "display")),
    ]
    for pattern, *parts in [
        (r"""(?i)<meta[^>]+name=["']keywords["']""", "keywords"), (r"""(?i)<meta[^>]+name=["']viewport["']""", "viewport"), (r"G-[A-Z0-9]{6,}|googletagmanager\.com/gtag", "g-", "googletagmanager"),
        (r"""(?i)<link[^>]*rel=["'][^"']*icon""", "icon"), (r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+url=""", "refresh"), (r"(?i)(class|aria-label)=[\"'][^\"']*breadcrumb", "breadcrumb"),
    ]:
        same.append((html(pattern), html(pattern, *parts)))
    for pattern, part in [(r"""(?i)rel=["']next["']""", "next"), (r"""(?i)rel=["']prev["']""", "prev"), (r"""(?i)<link[^>]*rel=["']?canonical""", "canonical"), (r"(?i)onclick=[\"'][^\"']*(location|window\.open)", "onclick")]:
        same.append((n_html(pattern), n_html(pattern, part)))
    row = rows.select(*[F.count_if(~a.eqNullSafe(b)).alias(f"d{i}") for i, (a, b) in enumerate(same)], *[F.count_if(a.cast("int") > 0).alias(f"n{i}") for i, (a, _) in enumerate(same)]).first()
    assert not any(row[f"d{i}"] for i in range(len(same)))
    assert sum(row[f"n{i}"] > 0 for i in range(len(same))) >= len(same) - 1


def test_different_words_of_one_shape_are_looked_at_once():
    known = {}
    assert page_parser.text_counts([" ".join(f"w{i}x{k}" for k in range(1, 301)) for i in range(40)], known)[2] == [300] * 40
    assert len(known) < 20
