import random
import re

import pytest

from pagelens.operators import selectors as S
from pagelens.plans.extract import child, extract_pages
from pagelens.plans.storage import settle

SELECTORS = [
    "div > p a[rel]", "main p", "ul > li:nth-child(2n+1) a", "p + p", "h2 ~ p.x", "#top, section *:first-child", "div div > :not(.x)", "li:nth-last-child(2)",
    'a[href^="/a"][rel~=nofollow i]', "a[href$='z']:not([rel])", "[data-k|=en]", ":root > body", "section > section + p, ul li > a:last-child", "p:only-child", "li:nth-child(-n+2)",
]


def _html(r):
    def block(depth):
        tag = r.choice(["div", "main", "section", "ul", "p", "h2", "p"])
        cls = r.choice(["", ' class="x y"', ' class="X"', ' id="top"', ' data-k="en-GB"', ' data-k="end"'])
        link = lambda: f'<a href="{r.choice(["/a", "/bz", "z"])}"{r.choice(["", " rel=nofollow", " rel=\'me NoFollow\'"])}>t{r.randrange(9)}</a>'
        if tag == "ul":
            return f"<ul{cls}>" + "".join(f"<li>{link()}{link() if r.random() < 0.3 else ''}</li>" for _ in range(r.randint(0, 4))) + "</ul>"
        if tag in ("p", "h2"):
            return f"<{tag}{cls}>words {link() if r.random() < 0.6 else ''}</{tag}>"
        return f"<{tag}{cls}>" + "".join(block(depth + 1) for _ in range(r.randint(0, 3) if depth < 4 else 0)) + f"</{tag}>"

    return "<html><body>" + "".join(block(0) for _ in range(r.randint(1, 5))) + "</body></html>"


def _fits(e, compound, kids):
    """A compound against one element of the tree; pseudo-classes from the children of its parent."""
    own = kids[e.parent_id]
    for t in re.findall(r":not\([^)]*\)|:[\w-]+(?:\([^)]*\))?|\[[^\]]*\]|\.[\w-]+|#[\w-]+|\*|[\w-]+", compound):
        if t.startswith(":not"):
            ok = not _fits(e, t[5:-1], kids)
        elif t[0] == ":":
            n, back = own.index(e.node_id) + 1, len(own) - own.index(e.node_id)
            ok = {
                ":first-child": n == 1, ":last-child": back == 1, ":only-child": len(own) == 1, ":root": e.parent_id is None,
                ":nth-child(2n+1)": n % 2 == 1, ":nth-last-child(2)": back == 2, ":nth-child(-n+2)": n <= 2,
            }[t]
        elif t[0] == "[":
            name, how, value, fold = re.match(r"\[([\w-]+)(?:([~|^$]?=)['\"]?([^'\"\] ]*)['\"]?( i)?)?\]", t).groups()
            got = e.attrs.get(name)
            low = (lambda s: s.lower()) if fold else (lambda s: s)
            ok = got is not None and {
                None: lambda: True, "=": lambda: got == value, "^=": lambda: got.startswith(value), "$=": lambda: got.endswith(value),
                "~=": lambda: low(value) in low(got).split(), "|=": lambda: got == value or got.startswith(value + "-"),
            }[how]()
        elif t[0] == ".":
            ok = t[1:] in e.attrs.get("class", "").split()
        elif t[0] == "#":
            ok = e.attrs.get("id") == t[1:]
        else:
            ok = t in ("*", e.tag)
        if not ok:
            return False
    return True


def _walk(page, selector):
    by_id = {e.node_id: e for e in page}
    kids = {}
    for e in page:
        kids.setdefault(e.parent_id, []).append(e.node_id)

    def chain(e, parts):
        *before, last = parts
        if not _fits(e, last, kids):
            return False
        if not before:
            return True
        *before, how = before
        if how == ">":
            return e.parent_id is not None and chain(by_id[e.parent_id], before)
        if how in "+~":
            own = kids[e.parent_id]
            earlier = own[: own.index(e.node_id)]
            return any(chain(by_id[k], before) for k in (earlier[-1:] if how == "+" else earlier))
        while e.parent_id is not None:
            e = by_id[e.parent_id]
            if chain(e, before):
                return True
        return False

    found = set()
    for one in selector.split(","):
        parts = re.split(r"\s*([>~](?!=)|(?<!n)\+)\s*|\s+(?![i]\])", one.strip())
        parts = [" " if p is None else p for p in parts]
        found |= {e.node_id for e in page if chain(e, parts)}
    return found


def test_selectors_against_a_walk_of_the_tree(spark):
    r = random.Random(8)
    pages = spark.createDataFrame([(f"u{k}", _html(r)) for k in range(30)], "url string, html string")
    elements = settle(child(settle(extract_pages(pages).select("crawl_id", "url", "elements")), "elements"))
    by_page = {}
    for e in elements.collect():
        by_page.setdefault(e.page_url, []).append(e)
    for page in by_page.values():
        page.sort(key=lambda e: e.node_id)
    for selector in SELECTORS:
        got = {(e.page_url, e.node_id) for e in S.select(elements, selector).select("page_url", "node_id").collect()}
        want = {(u, k) for u, page in by_page.items() for k in _walk(page, selector)}
        assert got == want, selector
        assert want or selector == "a[href$='z']:not([rel])", selector
    values = {(x.page_url, x.name): x["values"] for x in S.css_extractors(elements, {"links": ("ul > li > a", "href"), "texts": "p > a"}).collect()}
    for u, page in by_page.items():
        links = [e.attrs["href"] for e in page if e.node_id in _walk(page, "ul > li > a")]
        assert values.get((u, "links"), []) == links
    assert S.select(elements.limit(0), "div p").count() == 0


def test_unsupported_selectors_are_named():
    for bad in ("", "div >", "> p", "a:hover", "p::before", ":not(a b)", "li:nth-child(x)", "a[href", "a,,b"):
        with pytest.raises(S.SelectorError):
            S.parse(bad)
