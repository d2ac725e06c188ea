"""Building blocks of check predicates: null-safe tests on a page row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions import text as X
from pagelens.functions import urls as U

#: Parameters that make an address a variant of another.
JUNK = r"(?i)[?&](utm_|sessionid|sid|replytocom|orderby|filter|fbclid|gclid|sort)"
REDIRECTS = (301, 302, 307, 308)


def c(name: str) -> Column:
    return F.col(name)


def ok() -> Column:
    return c("status") == 200


def indexable_ok() -> Column:
    return ok() & c("indexable")


def yes(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def has(name: str, part: str) -> Column:
    return yes(F.lower(name).contains(part))


def blank(col: Column) -> Column:
    return ~yes(X.has_text(col))


def mentions(*parts: str, of: str = "html") -> Column:
    """Whether a text holds one of the parts, which are in lower case; far less work than to search it by a pattern."""
    return reduce(Column.__or__, [F.lower(of).contains(p) for p in parts])


def html(pattern: str, *parts: str) -> Column:
    """Whether the HTML matches; with parts it is searched only where it holds one of them, as all that match must do."""
    found = c("html").rlike(pattern)
    return yes(mentions(*parts) & found if parts else found)


def n_html(pattern: str, *parts: str) -> Column:
    """How many matches the HTML has; parts as in html."""
    n = F.regexp_count("html", F.lit(pattern))
    return F.coalesce(F.when(mentions(*parts), n) if parts else n, F.lit(0))


def header(name: str) -> Column:
    return c("headers")[name]


def has_header(name: str) -> Column:
    return yes(F.map_contains_key("headers", F.lit(name)))


def tokens(name: str) -> Column:
    return F.filter(F.transform(F.split(F.lower(name), ","), X.strip_ws), lambda t: t != "")


def diff(element: str, *states: str) -> Column:
    return yes(c("render_diffs")[element].isin(*states))


def els(test: Callable[[Column], Column]) -> Column:
    return F.filter("elements", test)


def any_el(test: Callable[[Column], Column]) -> Column:
    return yes(F.exists("elements", test))


def n_els(test: Callable[[Column], Column]) -> Column:
    return F.size(els(test))


def tag(e: Column, *names: str) -> Column:
    return e["tag"].isin(*names)


def attr(e: Column, name: str) -> Column:
    return F.coalesce(e["attrs"][name], F.lit(""))


def has_attr(e: Column, name: str) -> Column:
    return F.map_contains_key(e["attrs"], F.lit(name))


def under(e: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(e["ancestors"], test)


def first(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def some_links(test: Callable[[Column], Column]) -> Column:
    return F.filter("links", test)


def filled(items: Column) -> Column:
    return yes(F.size(items) > 0)


def path() -> Column:
    return U.path(c("url"))


def query() -> Column:
    return U.query(c("url"))


def schema_types() -> Column:
    return F.transform(F.flatten(F.transform("jsonld", lambda j: j["types"])), F.lower)


def no_schema(*types: str) -> Column:
    return ~F.arrays_overlap(F.array_append(schema_types(), F.lit("")), F.array(*[F.lit(t) for t in types]))


def see(**columns: Column) -> Callable[[], Column]:
    return lambda: F.struct(*[v.alias(k) for k, v in columns.items()])
