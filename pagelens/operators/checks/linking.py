"""Checks F, G and H: internal links, external links and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import text as X
from pagelens.functions import urls as U

from .registry import check
from .rules import REDIRECTS, any_el, attr, blank, c, diff, filled, first, has_attr, html, indexable_ok, n_els, n_html, some_links, tag, yes

#: Anchors that say nothing, and hosts of paid links.
GENERIC = ("click here", "read more", "here", "more", "link", "this", "learn more", "continue")
AD_HOSTS = ("doubleclick.net", "googleadservices.com", "amzn.to", "shareasale.com", "awin1.com", "clickbank.net")
NEXT_GEN = r"(?i)\.(webp|avif)(\?|$)"


def _hrefs(test, n=20):
    return first(F.transform(some_links(test), lambda x: x["href"]), n)


_empty = lambda x: blank(x["anchor"])
_generic = lambda x: F.lower(X.strip_ws(x["anchor"])).isin(*GENERIC)
_inside_nofollow = lambda x: x["is_internal"] & F.array_contains(x["rel"], "nofollow")
_insecure = lambda x: x["is_internal"] & x["href"].startswith("http:")
_outside_http = lambda x: ~x["is_internal"] & x["href"].startswith("http://")
_paid = lambda x: ~x["is_internal"] & U.registrable_domain(U.host(x["href"])).isin(*AD_HOSTS) & ~F.arrays_overlap(x["rel"], F.array(F.lit("sponsored"), F.lit("ugc"), F.lit("nofollow")))
_blank = lambda x: (x["target"] == "_blank") & ~F.arrays_overlap(x["rel"], F.array(F.lit("noopener"), F.lit("noreferrer")))


def _images(test, n=10):
    return first(F.transform(F.filter("images", test), lambda i: i["src"]), n)


_no_alt = lambda i: i["alt"].isNull() & ~i["decorative"]
_decorative = lambda i: i["decorative"] & F.coalesce(i["alt"] != "", F.lit(True))
_long_alt = lambda i: F.length(i["alt"]) > 100
_no_size = lambda i: i["width"].isNull() | i["height"].isNull()

check("F01", "No page links here", "Medium", "REVIEW", lambda: indexable_ok() & (c("inlink_count") == 0))
check("F02", "One page links here", "Low", "REVIEW", lambda: c("indexable") & (c("inlink_count") == 1))
check("F03", "More than 150 links", "Low", "REVIEW", lambda: c("outlink_count") > 150, lambda: F.struct("outlink_count"))
check("F04", "More than four clicks from the start", "Medium", "REVIEW", lambda: (c("depth") > 4) & c("indexable"), lambda: F.struct("depth"))
check("F05", "Links without anchor text", "Low", "REVIEW", lambda: filled(some_links(_empty)), lambda: F.struct(_hrefs(_empty).alias("hrefs")))
check("F06", "Five or more links with anchors that say nothing", "Low", "REVIEW", lambda: F.size(some_links(_generic)) >= 5)
check("F07", "Links to a redirected or canonicalised page", "Medium", "REVIEW", lambda: (c("status").isin(*REDIRECTS) | yes(c("canonical") != c("url"))) & (c("inlink_count") > 0))
check("F08", "Links that only scripts follow", "Medium", "REVIEW", lambda: n_html(r"(?i)onclick=[\"'][^\"']*(location|window\.open)", "onclick") + n_els(lambda e: tag(e, "a") & ~has_attr(e, "href")) >= 3)
check("F09", "Internal links with nofollow", "Low", "REVIEW", lambda: filled(some_links(_inside_nofollow)), lambda: F.struct(_hrefs(_inside_nofollow).alias("hrefs")))
check("F10", "Internal links made by scripts", "Medium", "REVIEW", lambda: diff("internal_links", "created"))
check(
    "F11",
    "Deep page without breadcrumbs",
    "Low",
    "REVIEW",
    lambda: (c("depth") >= 2)
    & ~html(r"(?i)(class|aria-label)=[\"'][^\"']*breadcrumb", "breadcrumb")
    & ~F.exists("jsonld", lambda j: F.array_contains(j["types"], "BreadcrumbList")),
)
check("F12", "https page with internal http links", "Medium", "REVIEW", lambda: c("url").startswith("https:") & filled(some_links(_insecure)), lambda: F.struct(_hrefs(_insecure).alias("hrefs")))

check("G03", "External http links", "Low", "REVIEW", lambda: filled(some_links(_outside_http)), lambda: F.struct(_hrefs(_outside_http).alias("hrefs")), origin="catalogue")
check("G04", "Paid links without sponsored or ugc", "Low", "REVIEW", lambda: filled(some_links(_paid)), lambda: F.struct(_hrefs(_paid).alias("hrefs")), origin="catalogue")
check("G06", "New windows without noopener", "Low", "REVIEW", lambda: filled(some_links(_blank)), lambda: F.struct(_hrefs(_blank, 5).alias("hrefs")), origin="catalogue")

check("H01", "Images without alternative text", "Medium", "AUTO", lambda: filled(F.filter("images", _no_alt)), lambda: F.struct(_images(_no_alt).alias("images")), origin="catalogue")
check("H02", "Decorative images without an empty alternative text", "Low", "REVIEW", lambda: filled(F.filter("images", _decorative)), lambda: F.struct(_images(_decorative).alias("images")), origin="catalogue")
check("H03", "Alternative text over 100 characters", "Low", "REVIEW", lambda: filled(F.filter("images", _long_alt)), lambda: F.struct(_images(_long_alt).alias("images")), origin="catalogue")
check("H05", "Images without width or height", "Medium", "REVIEW", lambda: filled(F.filter("images", _no_size)), lambda: F.struct(_images(_no_size).alias("images")), origin="catalogue")
check("H07", "No image in a modern format", "Low", "REVIEW", lambda: filled(c("images")) & ~F.exists("images", lambda i: i["src"].rlike(NEXT_GEN)), origin="catalogue")
check(
    "H08",
    "Images after the third without lazy loading",
    "Low",
    "REVIEW",
    lambda: F.exists(F.slice("images", 4, F.greatest(F.size("images"), F.lit(1))), lambda i: F.coalesce(i["loading"], F.lit("")) != "lazy"),
    origin="catalogue",
)
check("H09", "Largest image without fetchpriority", "Low", "REVIEW", lambda: F.exists("images", lambda i: (i["src"] == c("lcp_src")) & (F.coalesce(i["fetchpriority"], F.lit("")) != "high")), origin="catalogue")
