"""Checks N to Q: speed, mobile, rendering and accessibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import urls as U

from .registry import check
from .rules import any_el, attr, c, els, filled, first, has_attr, has_header, html, n_els, tag, under, yes

#: Fixed values.
THIRD_PARTIES = r"google-analytics\.com|googletagmanager\.com|hotjar\.com|facebook\.net|tiktok\.com|clarity\.ms"
ARIA = (
    "aria-activedescendant aria-atomic aria-autocomplete aria-busy aria-checked aria-colcount aria-colindex aria-colspan aria-controls aria-current "
    "aria-describedby aria-details aria-disabled aria-dropeffect aria-errormessage aria-expanded aria-flowto aria-grabbed aria-haspopup aria-hidden "
    "aria-invalid aria-keyshortcuts aria-label aria-labelledby aria-level aria-live aria-modal aria-multiline aria-multiselectable aria-orientation "
    "aria-owns aria-placeholder aria-posinset aria-pressed aria-readonly aria-relevant aria-required aria-roledescription aria-rowcount aria-rowindex "
    "aria-rowspan aria-selected aria-setsize aria-sort aria-valuemax aria-valuemin aria-valuenow aria-valuetext"
).split()
SPA_ROOTS = ("root", "app", "__next", "__nuxt", "___gatsby")

_stylesheet = lambda e: tag(e, "link") & attr(e, "rel").contains("stylesheet")
_blocking = lambda e: (_stylesheet(e) & ~attr(e, "media").rlike("print|max-width")) | (tag(e, "script") & (attr(e, "src") != "") & e["in_head"] & ~has_attr(e, "async") & ~has_attr(e, "defer"))
_asset = lambda e: ((tag(e, "script") & (attr(e, "src") != "")) | _stylesheet(e))
_address = lambda e: F.concat(attr(e, "src"), attr(e, "href"))
_static = lambda e: (tag(e, "img", "script") & (attr(e, "src") != "")) | _stylesheet(e)
_request = lambda e: (tag(e, "img", "script") & has_attr(e, "src")) | (tag(e, "link") & has_attr(e, "href"))
_hint = lambda e: tag(e, "link") & attr(e, "rel").rlike("preconnect|preload|dns-prefetch")


def _third_origins():
    hosts = F.transform(els(lambda e: tag(e, "script", "link") & _address(e).rlike("^(https?:)?//")), lambda e: U.host(_address(e)))
    return F.array_distinct(F.filter(hosts, lambda h: (h != "") & (h != U.host(c("url")))))


check("N01", "Largest paint later than 2.5 s", "High", "FLAG", lambda: c("lcp_s") > 2.5, lambda: F.struct("lcp_s"))
check("N02", "Interaction slower than 200 ms", "High", "FLAG", lambda: c("inp_ms") > 200, lambda: F.struct("inp_ms"))
check("N03", "Layout shift over 0.1", "High", "REVIEW", lambda: c("cls") > 0.1, lambda: F.struct("cls"))
check("N04", "First byte later than 0.8 s", "Medium", "FLAG", lambda: c("ttfb_ms") / 1000 > 0.8, lambda: F.struct("ttfb_ms"))
check("N05", "Styles and scripts that block rendering", "Medium", "REVIEW", lambda: any_el(_blocking), lambda: F.struct(first(F.transform(els(_blocking), _address), 10).alias("resources")))
check("N06", "Three or more assets that aren't minified", "Low", "REVIEW", lambda: n_els(lambda e: _asset(e) & ~_address(e).contains(".min.")) >= 3)
check("N07", "No compression", "Medium", "FLAG", lambda: ~has_header("content-encoding") & (c("size") > 5000), lambda: F.struct("size"))
check("N08", "Static assets without cache headers", "Low", "FLAG", lambda: ~has_header("cache-control") & ~has_header("expires") & (n_els(_static) >= 5))
check("N09", "More than 1500 elements", "Medium", "REVIEW", lambda: c("dom_node_count") > 1500, lambda: F.struct("dom_node_count"))
check("N10", "Page over 2.5 MB", "Medium", "REVIEW", lambda: c("size") > 2_500_000, lambda: F.struct("size"))
check("N11", "More than 100 requests", "Low", "REVIEW", lambda: n_els(_request) > 100)
check("N12", "Third-party origins without a hint", "Low", "REVIEW", lambda: filled(_third_origins()) & ~any_el(_hint), lambda: F.struct(_third_origins().alias("origins")))
check(
    "N13",
    "Fonts that hide text while loading",
    "Low",
    "REVIEW",
    lambda: any_el(lambda e: tag(e, "link") & attr(e, "href").contains("fonts.googleapis.com") & ~attr(e, "href").contains("display=swap")) | (html("@font-face") & ~html("font-display")),
)
check("N14", "Three or more third-party scripts", "Medium", "FLAG", lambda: n_els(lambda e: tag(e, "script") & F.lower(attr(e, "src")).rlike(THIRD_PARTIES)) >= 3)

_viewport = lambda: F.get(F.transform(els(lambda e: tag(e, "meta") & (attr(e, "name") == "viewport")), lambda e: attr(e, "content")), 0)

check("O01", "Viewport missing or incomplete", "High", "REVIEW", lambda: F.coalesce(~(_viewport().contains("width=device-width") & _viewport().contains("initial-scale")), F.lit(True)))
check("O02", "Small tap targets", "Medium", "REVIEW", lambda: c("mobile.smallTapTargets") >= 5)
check("O03", "Content wider than the screen", "Medium", "REVIEW", lambda: c("mobile.contentWiderThanViewport"))
check("O04", "Small fonts", "Low", "REVIEW", lambda: c("mobile.smallFonts") >= 5)
check("O05", "Mobile page has less text", "High", "REVIEW", lambda: (F.length("main_text") > 500) & (F.length("mobile.mobile_text") < F.length("main_text") * 0.7))
check("O06", "Interstitial on mobile", "Medium", "REVIEW", lambda: c("mobile.hasInterstitial"))
check("O07", "Resources blocked on mobile", "High", "REVIEW", lambda: filled(c("mobile.blocked_resources")), lambda: F.struct(first(c("mobile.blocked_resources"), 10).alias("resources")))

check("P01", "Content only after rendering", "High", "REVIEW", lambda: (F.length("raw_text") < 200) & (F.length("rendered_text") > 500))
check(
    "P02",
    "Internal links only after rendering",
    "Medium",
    "REVIEW",
    lambda: filled(F.filter(F.array_except("rendered_hrefs", "raw_hrefs"), lambda h: h.startswith("/") | (U.netloc(h) == U.netloc(c("url"))))),
    lambda: F.struct(first(F.sort_array(F.filter(F.array_except("rendered_hrefs", "raw_hrefs"), lambda h: h.startswith("/") | (U.netloc(h) == U.netloc(c("url"))))), 10).alias("links")),
)
check(
    "P03",
    "Head differs after rendering",
    "High",
    "REVIEW",
    lambda: c("rendered_facts").isNotNull()
    & ~F.struct("title", "meta_desc", "meta_robots", "canonical").eqNullSafe(c("rendered_facts")),
)
check("P04", "Script errors while rendering", "High", "FLAG", lambda: filled(c("agentic.js_errors")), lambda: F.struct("agentic.js_errors"))
check("P05", "Rendering takes over 3 s", "Medium", "REVIEW", lambda: c("render_ms") > 3000, lambda: F.struct("render_ms"))
check("P06", "Rendered by the client only", "High", "REVIEW", lambda: any_el(lambda e: attr(e, "id").isin(*SPA_ROOTS)) & (F.length("raw_text") < 200) & (F.length("rendered_text") > 500))

_named = lambda e: (F.trim(e["text"]) != "") | (F.trim(attr(e, "aria-label")) != "") | (F.trim(attr(e, "aria-labelledby")) != "") | (F.trim(attr(e, "title")) != "")
unnamed = lambda e: (tag(e, "button") | (tag(e, "a") & has_attr(e, "href"))) & ~_named(e)
_list = lambda a: F.coalesce(a["role"] == "list", F.lit(False)) | a["tag"].isin("ul", "ol")
loose_item = lambda e: (attr(e, "role") == "listitem") & ~under(e, _list)
hidden_control = lambda e: tag(e, "button", "a", "input", "select", "textarea") & ((attr(e, "aria-hidden") == "true") | under(e, lambda a: a["aria_hidden"]))
_wrong_aria = lambda e: F.exists(F.map_keys(e["attrs"]), lambda k: k.startswith("aria-") & ~k.isin(*ARIA))
_fake_button = lambda e: tag(e, "div", "span") & has_attr(e, "onclick") & (attr(e, "role") != "button")
_labels = lambda: F.transform(els(lambda e: tag(e, "label")), lambda e: attr(e, "for"))


def _unlabelled(e):
    control = tag(e, "select", "textarea") | (tag(e, "input") & ~attr(e, "type").isin("hidden", "submit", "button", "reset", "image"))
    named = (attr(e, "aria-label") != "") | (attr(e, "aria-labelledby") != "") | (attr(e, "title") != "")
    return control & ~named & ~under(e, lambda a: a["tag"] == "label") & ~((attr(e, "id") != "") & F.array_contains(F.array_append(_labels(), F.lit("-")), attr(e, "id")))


_main = lambda e: tag(e, "main") | (attr(e, "role") == "main")
_nav = lambda e: tag(e, "nav") | (attr(e, "role") == "navigation")

check("Q01", "Controls without a name", "Medium", "REVIEW", lambda: any_el(unnamed), lambda: F.struct(F.size(els(unnamed)).alias("n")))
check("Q02", "ARIA attributes that don't exist", "Medium", "REVIEW", lambda: any_el(_wrong_aria))
check("Q03", "Form fields without a label", "Medium", "REVIEW", lambda: any_el(_unlabelled), lambda: F.struct(F.size(els(_unlabelled)).alias("n")))
check("Q04", "Contrast too low", "Low", "REVIEW", lambda: F.array_contains("axe_violations", "color-contrast"))
check("Q05", "Controls hidden from assistive technology", "Medium", "REVIEW", lambda: any_el(hidden_control))
check("Q06", "List items outside lists", "Medium", "REVIEW", lambda: any_el(loose_item))
check("Q07", "No language on the page", "Low", "REVIEW", lambda: any_el(lambda e: tag(e, "html") & ~has_attr(e, "lang")))
check("Q08", "Blocks that act as buttons", "Medium", "REVIEW", lambda: any_el(_fake_button))
check("Q09", "Neither main nor navigation landmark", "Low", "REVIEW", lambda: ~any_el(_main) & ~any_el(_nav))
