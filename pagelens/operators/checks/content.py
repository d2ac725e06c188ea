"""Checks D and E: titles, descriptions, headings and content."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import text as X

from .registry import check
from .rules import any_el, attr, blank, c, diff, els, filled, first, html, indexable_ok, mentions, n_html, ok, tag, yes

DESCRIPTION = r"""(?i)<meta[^>]+name=["']description["']"""
#: Fixed values.
PLACEHOLDER = r"(?i)\b(lorem ipsum|dolor sit amet|consectetur adipiscing|placeholder text|your text here|sample text|insert text here)\b"
PLACEHOLDER_WORDS = ("ipsum", "amet", "adipiscing", "placeholder", "your", "sample", "insert")
HIDDEN = r"""(?i)(class=["'][^"']*\b(tab-pane|accordion-collapse|collapse|is-hidden)\b|\bhidden\b|style=["'][^"']*display\s*:\s*none)"""


def _levels():
    return F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>.*?</h\1>"), F.lit(1)), lambda x: x.cast("int"))


def _jumps():
    def of(levels):
        later = F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0)))
        return F.filter(F.zip_with(later, F.slice(levels, 1, F.size(later)), lambda b, a: F.when(b - a > 1, F.concat(F.lit("H"), a, F.lit(">H"), b))), lambda x: x.isNotNull())

    return X.let(_levels(), of)


def _missing_og():
    return F.array_except(F.array(F.lit("og:title"), F.lit("og:description"), F.lit("og:image")), F.map_keys("og"))


def _long_headings():
    return F.filter(F.concat("h1", "h2"), lambda t: F.length(t) > 70)


check("D01", "No title", "High", "AUTO", lambda: indexable_ok() & blank(c("title")))
check("D03", "Title too wide for a result list", "Low", "AUTO", lambda: X.pixel_width(c("title")) > 561, lambda: F.struct("title", X.pixel_width(c("title")).alias("px")))
check("D04", "Title very short", "Low", "AUTO", lambda: (c("title") != "") & (X.pixel_width(c("title")) < 200), lambda: F.struct("title", X.pixel_width(c("title")).alias("px")))
check("D05", "Several title elements", "Medium", "AUTO", lambda: F.regexp_count(F.lower("html"), F.lit("<title")) > 1)
check("D07", "No meta description", "Medium", "AUTO", lambda: indexable_ok() & c("meta_desc").isNull())
check("D09", "Meta description too thin", "Low", "AUTO", lambda: F.length(X.strip_ws(c("meta_desc"))).between(1, 119), lambda: F.struct(F.length(X.strip_ws(c("meta_desc"))).alias("chars")))
check("D10", "Meta description too short (part of D09)", "Low", "AUTO", lambda: F.lit(False))
check("D11", "Several meta descriptions", "Low", "AUTO", lambda: n_html(DESCRIPTION) > 1)
check("D12", "No first-level heading", "Medium", "REVIEW", lambda: ok() & (F.size("h1") == 0))
check("D13", "Several first-level headings", "Low", "REVIEW", lambda: F.size("h1") > 1, lambda: F.struct("h1"))
check("D15", "Heading levels skipped", "Low", "REVIEW", lambda: filled(_jumps()), lambda: F.struct(_jumps().alias("jumps")))
check("D16", "Empty heading", "Low", "REVIEW", lambda: any_el(lambda e: tag(e, "h1", "h2", "h3", "h4", "h5", "h6") & (F.trim(e["text"]) == "")))
check("D17", "Title or description made by scripts", "Medium", "REVIEW", lambda: diff("title", "created", "modified") | diff("meta_desc", "created", "modified"))
check("D18", "Keywords meta", "Low", "AUTO", lambda: html(r"""(?i)<meta[^>]+name=["']keywords["']""", "keywords"))
check("D19", "Open Graph tags missing", "Low", "AUTO", lambda: c("indexable") & filled(_missing_og()), lambda: F.struct(_missing_og().alias("missing")))
check("D20", "No viewport meta", "High", "REVIEW", lambda: ok() & ~html(r"""(?i)<meta[^>]+name=["']viewport["']""", "viewport"))
check("D21", "Heading over 70 characters", "Low", "REVIEW", lambda: filled(_long_headings()), lambda: F.struct(first(_long_headings(), 3).alias("headings")))

check("E04", "Thin content", "Medium", "REVIEW", lambda: indexable_ok() & (c("word_count") < 200), lambda: F.struct("word_count"), lambda: F.when(c("word_count") >= 100, "Medium").otherwise("High"))
check(
    "E07",
    "More text around the content than in it",
    "Low",
    "REVIEW",
    lambda: (X.word_regex_count(X.strip_tags(c("html"))) > 200) & (c("word_count") > 0) & (c("word_count") / X.word_regex_count(X.strip_tags(c("html"))) < 0.3),
)
check("E08", "Placeholder text", "Medium", "REVIEW", lambda: yes(mentions(*PLACEHOLDER_WORDS) & X.strip_tags(c("html")).rlike(PLACEHOLDER)), lambda: F.struct(F.regexp_extract(X.strip_tags(c("html")), PLACEHOLDER, 1).alias("phrase")))
check("E09", "Text that is hard to read", "Low", "REVIEW", lambda: (c("word_count") >= 100) & (c("readability") < 30), lambda: F.struct("readability"))
check(
    "E10",
    "Little text for the amount of HTML",
    "Low",
    "REVIEW",
    lambda: (c("size") > 0) & (F.octet_length(F.regexp_replace("html", "<[^>]+>", " ")) / c("size") < 0.1),
)
check("E11", "Content hidden behind tabs or accordions", "Medium", "REVIEW", lambda: (c("word_count") > 100) & (n_html(HIDDEN, "tab-pane", "collapse", "hidden", "display") >= 3))
check(
    "E12",
    "Article without publication date in its schema",
    "Low",
    "REVIEW",
    lambda: (c("word_count") > 300)
    & ~F.exists("jsonld", lambda j: F.arrays_overlap(j["types"], F.array(F.lit("Article"), F.lit("BlogPosting"), F.lit("NewsArticle"))) & j["block"].contains("datePublished")),
)
