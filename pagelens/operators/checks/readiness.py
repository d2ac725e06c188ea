"""Checks R to W: assistants, agents, addresses, series of pages, WordPress and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import urls as U

from .experience import hidden_control, loose_item, unnamed
from .registry import check
from .rules import any_el, attr, c, diff, els, filled, has_attr, html, mentions, n_els, n_html, no_schema, path, query, tag, under, yes

#: Fixed values.
TRAINING_BOTS = ("gptbot", "claudebot", "ccbot", "google-extended")
SEARCH_BOTS = ("oai-searchbot", "claude-searchbot", "perplexitybot")
USER_BOTS = ("chatgpt-user", "claude-user", "perplexity-user")
FLOWS = "checkout|cart|booking|book-now|contact|appointment|register|signup|sign-up|quote"
INFINITE = ("infinite-scroll", "infinitescroll", "load-more", "load_more", "data-infinite")


def _blocked(bots):
    return els(lambda e: tag(e, "meta") & F.lower(attr(e, "name")).isin(*bots) & F.lower(attr(e, "content")).contains("noindex"))


def _bots(bots):
    return lambda: F.struct(F.transform(_blocked(bots), lambda e: F.lower(attr(e, "name"))).alias("bots"))


_meta = lambda name, key="name": any_el(lambda e: tag(e, "meta") & (F.lower(attr(e, key)) == name))
_in_main = lambda e: under(e, lambda a: a["tag"].isin("main", "article"))
_llms = lambda: c("url").endswith("/llms.txt")
_mcp = lambda e: F.exists(F.map_keys(e["attrs"]), lambda k: k.startswith("data-mcp"))

check("R01", "Training crawlers shut out by meta", "Info", "REVIEW", lambda: filled(_blocked(TRAINING_BOTS)), _bots(TRAINING_BOTS))
check("R02", "Answer crawlers shut out by meta", "High", "REVIEW", lambda: filled(_blocked(SEARCH_BOTS)), _bots(SEARCH_BOTS))
check("R03", "User agents of assistants shut out by meta", "Medium", "REVIEW", lambda: filled(_blocked(USER_BOTS)), _bots(USER_BOTS))
check("R05", "Most content needs scripts", "High", "REVIEW", lambda: (F.length("rendered_text") > 100) & (F.length("rendered_text") > 2 * F.length("raw_text")))
check("R06", "Content behind a login or paywall", "Medium", "REVIEW", lambda: any_el(lambda e: (tag(e, "input") & (attr(e, "type") == "password")) | F.lower(attr(e, "class")).rlike("paywall|premium")))
check(
    "R07",
    "No direct answer at the start",
    "Low",
    "REVIEW",
    lambda: (c("word_count") >= 300)
    & any_el(lambda e: tag(e, "h1", "h2") & _in_main(e))
    & (F.length(F.get(F.transform(els(lambda e: tag(e, "p") & _in_main(e)), lambda e: F.trim(e["text"])), 0)) < 40),
)
check("R08", "Long text without second-level headings", "Low", "REVIEW", lambda: (c("word_count") > 400) & (F.size("h2") == 0), lambda: F.struct("word_count"))
check("R09", "No author or date", "Medium", "REVIEW", lambda: ~_meta("author") | ~(_meta("article:published_time", "property") | any_el(lambda e: tag(e, "time"))))
check("R10", "No organisation or website schema", "Medium", "REVIEW", lambda: no_schema("organization", "website"))
check("R11", "No google-extended meta", "Low", "REVIEW", lambda: ~_meta("google-extended"))
check("R12", "No structured facts", "Low", "REVIEW", lambda: no_schema("faqpage", "product", "price"))
check("R13", "Text that is hard to read", "Low", "REVIEW", lambda: (c("word_count") >= 300) & (c("readability") < 30), lambda: F.struct("readability"))

check("S02", "llms.txt without heading, text or links", "Low", "REVIEW", lambda: _llms() & ((F.size("h1") == 0) | (F.length("main_text") < 50) | (F.size("links") == 0)))
check("S03", "llms.txt with over 800 links", "Low", "REVIEW", lambda: _llms() & (n_els(lambda e: tag(e, "a")) > 800))
check("S05", "Controls that agents can't name", "Medium", "REVIEW", lambda: any_el(unnamed))
check("S06", "Broken accessibility tree", "Medium", "REVIEW", lambda: any_el(loose_item))
check("S07", "Controls that agents can't see", "Medium", "REVIEW", lambda: any_el(hidden_control))
check("S08", "Layout shifts after loading", "Medium", "REVIEW", lambda: c("agentic.post_load_cls") > 0.1)
check("S09", "Form without tool annotations", "Low", "REVIEW", lambda: any_el(lambda e: tag(e, "form") & ~_mcp(e)))
check("S10", "Tool annotation that isn't JSON", "Low", "REVIEW", lambda: any_el(lambda e: (attr(e, "data-mcp") != "") & F.expr("true") & F.try_parse_json(attr(e, "data-mcp")).isNull()))
check(
    "S11",
    "Key flow without annotated forms",
    "Medium",
    "REVIEW",
    lambda: F.lower(F.concat_ws(" ", "url", "title")).rlike(FLOWS) & any_el(lambda e: tag(e, "form")) & ~any_el(lambda e: tag(e, "form") & _mcp(e)),
)
check("S12", "Links registered by scripts", "Low", "REVIEW", lambda: diff("internal_links", "created", "modified"))
check("S13", "Analytics present", "Info", "FLAG", lambda: html(r"G-[A-Z0-9]{6,}|googletagmanager\.com/gtag", "g-", "googletagmanager"))


def _segments():
    return F.filter(F.split(path(), "/"), lambda s: s != "")


_series = lambda: query().contains("page=") | query().contains("p=") | path().contains("/page/")

check("T01", "Upper-case letters in the path", "Low", "REVIEW", lambda: path().rlike(r"\p{Lu}"))
check("T02", "Unsafe characters in the path", "Low", "REVIEW", lambda: F.coalesce(F.try_url_decode(F.regexp_replace(path(), r"\+", "%2B")), path()).rlike(r"[^a-zA-Z0-9\-._~/]"))
check("T03", "Double slashes or repeated folders", "Low", "REVIEW", lambda: path().contains("//") | (F.size(F.array_distinct(_segments())) < F.size(_segments())))
check("T04", "Address over 115 characters", "Low", "REVIEW", lambda: F.length("url") > 115)
check("T05", "Session or tracking parameters", "Medium", "REVIEW", lambda: query().rlike("sessionid|sid=|utm_|gclid"))
check("T06", "More than four folders", "Low", "REVIEW", lambda: F.size(_segments()) > 4)
check("T07", "Address that doesn't describe the page", "Low", "REVIEW", lambda: query().rlike("p=|page_id="))
check("T09", "Underscores in the path", "Low", "REVIEW", lambda: path().contains("_"))

check("U01", "Page of a series with noindex", "Medium", "REVIEW", lambda: _series() & html(r"""(?i)<meta[^>]*name=["']?robots["']?[^>]*content=["']?[^>]*noindex"""))
check("U02", "Several next or previous links", "Low", "REVIEW", lambda: (n_html(r"""(?i)rel=["']next["']""", "next") > 1) | (n_html(r"""(?i)rel=["']prev["']""", "prev") > 1))
check("U03", "Page of a series canonicalised to the first", "Medium", "REVIEW", lambda: _series() & (c("canonical") != "") & ~c("canonical").rlike("page=|p=|/page/"))
check("U04", "Endless scrolling without pages", "Medium", "REVIEW", lambda: mentions(*INFINITE) & ~F.lower("html").rlike("""rel=["']next["']"""))
check("U05", "Series without a complete list", "Low", "REVIEW", lambda: (F.lower("html").contains('rel="next"') | F.lower("url").contains("/page/")) & ~mentions("view all", "view-all", "show all", "see all"))

check("V01", "Default category", "Low", "REVIEW", lambda: F.lower("url").contains("/category/uncategorized"))
check("V02", "Tag, author or date archive", "Medium", "REVIEW", lambda: path().rlike(r"/tag/|/author/|/\d{4}/\d{2}/"))
check("V03", "Attachment page", "Medium", "AUTO", lambda: query().contains("attachment_id="))
check("V04", "Pages of comments", "Low", "REVIEW", lambda: c("url").contains("/comment-page-"))
check("V05", "Search results page", "Medium", "REVIEW", lambda: query().contains("s="))
check("V06", "Two SEO plugins", "High", "FLAG", lambda: c("html").contains("Yoast SEO") & c("html").contains("Rank Math"))
check("V07", "Several canonical links", "Medium", "REVIEW", lambda: n_html(r"""(?i)<link[^>]*rel=["']?canonical""", "canonical") > 1)
check("V08", "Three or more JPEG or PNG images", "Low", "REVIEW", lambda: F.size(F.filter("images", lambda i: F.lower(i["src"]).rlike(r"\.(jpe?g|png)(\?|$)"))) >= 3)
check("V09", "Feed, trackback or reply address", "Low", "REVIEW", lambda: query().contains("replytocom=") | path().rlike("/(feed|trackback)/$"))
check("V10", "Test site that may be indexed", "Critical", "FLAG", lambda: U.host(c("url")).rlike(r"staging\.|dev\.") & ~F.lower("html").contains("noindex"))
check("V11", "More than 20 plugins", "Medium", "FLAG", lambda: F.size(F.array_distinct(F.regexp_extract_all("html", F.lit("wp-content/plugins/([^/\"']+)"), F.lit(1)))) > 20)
check("V12", "User list of the REST interface", "Low", "FLAG", lambda: c("url").contains("/wp-json/wp/v2/users"))

_gtm = lambda: n_html(r"googletagmanager\.com/gtm\.js")
_gtag = lambda: n_html(r"googletagmanager\.com/gtag/js")
check("W01", "Analytics missing or doubled", "Low", "FLAG", lambda: ((_gtm() == 0) & (_gtag() == 0)) | (_gtm() > 1) | (_gtag() > 1))
check("W02", "Start page without search-console verification", "Low", "FLAG", lambda: path().isin("", "/") & ~_meta("google-site-verification"))
check("W03", "No icon", "Low", "AUTO", lambda: ~html(r"""(?i)<link[^>]*rel=["'][^"']*icon""", "icon"))
