"""Checks I to M: languages, structured data, sitemap and robots notes on pages, and security."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import functions as F

from pagelens.functions import text as X
from pagelens.functions import urls as U

from .registry import check
from .rules import any_el, attr, c, diff, els, filled, first, has_header, header, html, mentions, no_schema, schema_types, some_links, tag, yes

#: Properties that a schema type should have.
RECOMMENDED = {
    "Article": ["headline", "image", "datePublished", "author"],
    "BlogPosting": ["headline", "image", "datePublished", "author"],
    "NewsArticle": ["headline", "image", "datePublished", "author"],
    "Product": ["name", "image", "offers"],
    "Offer": ["price", "priceCurrency"],
    "LocalBusiness": ["name", "address", "telephone"],
    "Organization": ["name", "url", "logo"],
    "FAQPage": ["mainEntity"],
    "Recipe": ["name", "image", "recipeIngredient"],
    "Event": ["name", "startDate", "location"],
    "BreadcrumbList": ["itemListElement"],
}
REQUIRED = {"Article": ["headline"], "Product": ["name"], "Offer": ["price"], "Organization": ["name"], "Event": ["name", "startDate"], "Recipe": ["name"], "FAQPage": ["mainEntity"]}
SECURITY_HEADERS = ("content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy")
ASKS = ("faq", "frequently asked", "how to", "add to cart")
LANGUAGE = r"^(x-default|[a-z]{2,3}(-[A-Za-z]{4})?(-([A-Z]{2}|[a-z]{2}|\d{3}))?)$"


def _objects():
    """JSON-LD objects as JSON text; lists and @graph are opened."""
    lists = F.transform(
        "jsonld",
        lambda j: F.when(j["error"].isNotNull(), F.array().cast("array<string>"))
        .when(j["block"].startswith("["), F.from_json(j["block"], "array<string>"))
        .otherwise(F.array(j["block"])),
    )
    graph = F.transform(F.flatten(lists), lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$.@graph"), "array<string>"), F.array(b)))
    return F.flatten(graph)


def _gaps(table: dict[str, list[str]]):
    """Type and property of what the objects of known types lack."""
    pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("property")) for t, ps in table.items() for p in ps])

    def missing(o):
        known = lambda g: (o["kind"] == g["type"]) | o["kind"].contains(F.concat(F.lit('"'), g["type"], F.lit('"')))
        return F.filter(pairs, lambda g: known(g) & F.coalesce(o["fields"][g["property"]], F.lit("")).isin("", "[]", "{}"))

    def of(b):
        """The object is parsed once, not once for each pair."""
        return X.let(F.struct(F.get_json_object(b, "$.@type").alias("kind"), F.from_json(b, "map<string,string>").alias("fields")), missing)

    return F.flatten(F.transform(_objects(), of))


_lang = lambda h: h["lang"]
_bad_lang = lambda h: ~h["lang"].rlike(LANGUAGE)
_loads = ("img", "script", "link", "iframe", "audio", "video", "source")


def _refs(*tags: str):
    return F.transform(els(lambda e: tag(e, *tags)), lambda e: F.coalesce(e["attrs"]["src"], e["attrs"]["href"], F.lit("")))


def _mixed():
    return F.filter(_refs(*_loads), lambda r: r.startswith("http://"))


def _protocol_relative():
    return F.filter(_refs("img", "script", "link", "iframe"), lambda r: r.startswith("//"))


_tabnabbing = lambda e: tag(e, "a") & (attr(e, "target") == "_blank") & ~attr(e, "rel").rlike(r"noopener|noreferrer")

check("I03", "Language codes that don't exist", "Medium", "REVIEW", lambda: filled(F.filter("hreflang", _bad_lang)), lambda: F.struct(F.transform(F.filter("hreflang", _bad_lang), _lang).alias("codes")), origin="catalogue")
check("I04", "Language versions without x-default", "Low", "REVIEW", lambda: filled(c("hreflang")) & ~F.exists("hreflang", lambda h: F.lower(h["lang"]) == "x-default"), origin="catalogue")
check("I05", "Canonical address in another language", "High", "REVIEW", lambda: F.exists("hreflang", lambda h: (h["href"] == c("canonical")) & (c("canonical") != c("url"))), origin="catalogue")
check("I06", "A language listed twice", "Medium", "REVIEW", lambda: F.size(F.array_distinct(F.transform("hreflang", _lang))) < F.size("hreflang"), origin="catalogue")
check("I08", "Language versions without the page itself", "Medium", "REVIEW", lambda: filled(c("hreflang")) & ~F.exists("hreflang", lambda h: h["href"] == c("url")), origin="catalogue")

check("J01", "Required schema property missing", "High", "REVIEW", lambda: filled(_gaps(REQUIRED)), lambda: F.struct(_gaps(REQUIRED).alias("missing")), origin="catalogue")
check("J02", "Recommended schema property missing (catalogue)", "Medium", "REVIEW", lambda: filled(_gaps(RECOMMENDED)) & filled(c("jsonld")), origin="catalogue")
check("J03", "JSON-LD that doesn't parse", "High", "REVIEW", lambda: F.exists("jsonld", lambda j: j["error"].isNotNull()), origin="catalogue")
check("J04", "Microdata or RDFa where JSON-LD is expected", "Low", "REVIEW", lambda: filled(c("microdata_types")) | filled(c("rdfa_types")), origin="catalogue")
check("J05", "Article schema on a page without article text", "Medium", "REVIEW", lambda: F.array_contains(schema_types(), "article") & (c("word_count") < 50), origin="catalogue")
check("J08", "No breadcrumb schema", "Low", "REVIEW", lambda: no_schema("breadcrumblist"), origin="catalogue")
check("J09", "Article schema without author or date", "Medium", "REVIEW", lambda: F.exists(_objects(), lambda b: F.get_json_object(b, "$.@type").contains("Article") & (F.get_json_object(b, "$.author").isNull() | F.get_json_object(b, "$.datePublished").isNull())), origin="catalogue")
check("J10", "Questions or products without their schema", "Medium", "REVIEW", lambda: yes(mentions(*ASKS, of="main_text") & F.lower("main_text").rlike(rf"\b({'|'.join(ASKS)})\b")) & no_schema("faqpage", "howto", "product", "review"), origin="catalogue")
check("J12", "Rating out of range", "High", "FLAG", lambda: F.exists(_objects(), lambda b: ~F.coalesce(F.get_json_object(b, "$.aggregateRating.ratingValue").try_cast("double"), F.lit(1.0)).between(0, 5)), origin="catalogue")
check("J13", "Schema changed by scripts", "Medium", "REVIEW", lambda: diff("structured_data", "created", "modified", "deleted"), origin="catalogue")
check("J14", "Recommended schema properties missing", "Low", "REVIEW", lambda: filled(_gaps(RECOMMENDED)), lambda: F.struct(_gaps(RECOMMENDED).alias("missing")))
check(
    "J15",
    "Microdata or RDFa only",
    "Low",
    "REVIEW",
    lambda: (filled(c("microdata_types")) | filled(c("rdfa_types"))) & (F.size("jsonld") == 0),
    lambda: F.struct("microdata_types", "rdfa_types"),
)

check("M01", "Site not on https", "Critical", "FLAG", lambda: c("url").startswith("http://"))
check("M02", "https page that loads http resources", "High", "REVIEW", lambda: c("url").startswith("https://") & filled(_mixed()), lambda: F.struct(first(_mixed(), 5).alias("resources")))
check("M03", "No HSTS header", "Medium", "FLAG", lambda: c("url").startswith("https://") & ~has_header("strict-transport-security"))
check("M05", "Resources without a scheme", "Low", "REVIEW", lambda: filled(_protocol_relative()), lambda: F.struct(first(_protocol_relative(), 5).alias("resources")))
check(
    "M06",
    "Security headers missing",
    "Low",
    "FLAG",
    lambda: filled(F.array_except(F.array(*[F.lit(h) for h in SECURITY_HEADERS]), F.map_keys("headers"))),
    lambda: F.struct(F.array_except(F.array(*[F.lit(h) for h in SECURITY_HEADERS]), F.map_keys("headers")).alias("missing")),
)
check("M07", "New windows without noopener or noreferrer", "Low", "REVIEW", lambda: any_el(_tabnabbing), lambda: F.struct(first(F.transform(els(_tabnabbing), lambda e: attr(e, "href")), 5).alias("hrefs")))
check("M08", "Version in server headers", "Low", "FLAG", lambda: yes(header("server").rlike(r"\d+\.\d+")) | yes(header("x-powered-by").rlike(r"\d+\.\d+")))
check("M09", "WordPress version shown", "Low", "FLAG", lambda: (c("url").endswith("readme.html") & c("html").contains("WordPress")) | yes(c("generator").contains("WordPress")), lambda: F.struct("generator"))
