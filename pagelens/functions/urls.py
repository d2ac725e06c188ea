"""URL expressions as Spark columns; none raises on malformed input."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track, and public suffixes of two labels.
TRACKING = r"(?i)^(utm_|fbclid=|gclid=|replytocom=|sessionid=|sid=|msclkid=|(fbclid|gclid|replytocom|sessionid|sid|msclkid)$)"
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "co.jp", "com.au", "net.au", "org.au", "co.nz", "co.za", "com.br", "com.mx", "co.in", "com.sg",
)

#: scheme, authority, path, query, fragment by the generic syntax.
_GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _GENERIC, k), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^[^@]*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(False))


def has_fragment(url: Column) -> Column:
    return F.coalesce(F.contains(url, F.lit("#")), F.lit(False))


def _with_query(head: Column, q: Column) -> Column:
    return F.when(q != "", F.concat(head, F.lit("?"), q)).otherwise(head)


def _clean_path(p: Column) -> Column:
    collapsed = F.regexp_replace(p, "/{2,}", "/")
    return F.when(collapsed == "", F.lit("/")).otherwise(collapsed)


def normalize_url(url: Column) -> Column:
    """For de-duplication: no fragment, no tracking parameters, lower-case scheme and host, single slashes."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    head = F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), _clean_path(path(url)))
    return _with_query(head, F.concat_ws("&", kept))


def norm_url(url: Column) -> Column:
    """As checks compare: no fragment, lower-case scheme and host, single slashes, query kept. Null stays null."""
    head = F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), _clean_path(path(url)))
    return _with_query(head, query(url))


def _remove_dots(p: Column) -> Column:
    """RFC 3986 dot segments, by folding over the segments."""
    parts = F.split(p, "/")
    step = lambda acc, s: (
        F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s))
    )
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.when(p.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(folded, "/"), ends)


def join_url(base: Column, ref: Column) -> Column:
    """Reference resolution of RFC 3986 for hierarchical addresses; an empty reference is the base itself, null stays null."""
    ref = F.regexp_replace(ref, r"^\s+|\s+$", "")
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    tail = F.concat(
        F.when(ref.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), query(ref))).otherwise(F.lit("")),
        F.when(fragment(ref) != "", F.concat(F.lit("#"), fragment(ref))).otherwise(F.lit("")),
    )
    own_path = F.when(path(ref).startswith("/"), path(ref)).otherwise(F.concat(folder, path(ref)))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref == "", base)
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(root, path(base), tail))
        .otherwise(F.concat(root, _remove_dots(own_path), tail))
    )


def registrable_domain(host_: Column) -> Column:
    """The last two labels; three for the listed suffixes."""
    labels = F.split(F.lower(host_), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when((F.size(labels) >= 3) & two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def last_two_labels(url: Column) -> Column:
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def same_host(a: Column, b: Column) -> Column:
    """Equal hosts, www. or not."""
    return F.regexp_replace(a, "(?i)^www\\.", "") == F.regexp_replace(b, "(?i)^www\\.", "")


def in_site(url: Column, home: Column, subdomains: bool = False, cdn_hosts: Sequence[str] = (), start_folder: bool = False) -> Column:
    """Whether a link leads into the site of the home address: its host, if asked for its sub-domains and named content hosts, and below its folder."""
    here, mine = F.lower(netloc(url)), F.lower(netloc(home))
    below = lambda domain: (here == domain) | here.endswith(F.concat(F.lit("."), domain))
    out = here == mine
    if subdomains:
        out = out | below(registrable_domain(host(home)))
    for name in cdn_hosts:
        out = out | below(F.lit(name.lower()))
    if start_folder:
        folder = F.regexp_replace(path(home), r"[^/]*$", "")
        out = out & F.when(path(url) == "", F.lit("/")).otherwise(path(url)).startswith(folder)
    return out


def strictly_indexable(url: Column, status: Column, meta_robots: Column, x_robots: Column, canonical: Column) -> Column:
    """Answers 200, has no noindex, and its canonical address, if any, is its own."""
    noindex = F.concat(F.coalesce(meta_robots, F.lit("")), F.lit(" "), F.coalesce(x_robots, F.lit(""))).contains("noindex")
    own = (F.coalesce(canonical, F.lit("")) == "") | (norm_url(join_url(url, canonical)) == url)
    return F.coalesce((status == 200) & ~noindex & own, F.lit(False))


def rewrite_url(url: Column, drop_params: Sequence[str] = (), replaces: Sequence[tuple[str, str]] = (), lower: bool = False) -> Column:
    """Named parameters go, then the regular-expression replaces in order, then lower case if asked for."""
    if drop_params:
        kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*drop_params))
        head = F.concat(scheme(url), F.lit("://"), netloc(url), path(url))
        tail = F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise(F.lit(""))
        url = F.concat(_with_query(head, F.concat_ws("&", kept)), tail)
    for pattern, to in replaces:
        url = F.regexp_replace(url, pattern, to)
    return F.lower(url) if lower else url


def self_canonical(url: Column) -> Column:
    """https, no fragment, query kept, at least the path /."""
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return _with_query(F.concat(F.lit("https://"), netloc(url), p), query(url))


def url_template(url: Column) -> Column:
    """The path with numbers, years, hashes and slugs as placeholders."""
    named = F.transform(
        F.filter(F.split(path(url), "/"), lambda s: s != ""),
        lambda s: (
            F.when(s.rlike(r"^\d{4}$"), F.lit("{year}"))
            .when(s.rlike(r"^\d+$"), F.lit("{id}"))
            .when(s.rlike(r"^[0-9a-f]{8,}$"), F.lit("{id}"))
            .when(s.contains("-") & (F.length(s) > 12), F.lit("{slug}"))
            .otherwise(s)
        ),
    )
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def segment_of(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first rule (name, pattern) that the address matches; null without any."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(url.rlike(p), F.lit(n)) for n, p in rules])


def path_variants(p: Column) -> Column:
    """A path as metrics may know it: as it is, slash toggled, index document as its folder."""
    toggled = F.when(p.endswith("/") & (p != "/"), F.regexp_replace(p, "/$", "")).when(p != "/", F.concat(p, F.lit("/")))
    folder = F.when(p.rlike(r"(?i)/(index|default)\.(html?|php|aspx?)$"), F.regexp_replace(p, r"[^/]*$", ""))
    return F.array_distinct(F.array_compact(F.array(p, toggled, folder)))


@F.pandas_udf(T.StringType())
def idna_host(hosts: pd.Series) -> pd.Series:
    """Hosts in punycode; those that can't be encoded stay as they are."""

    def one(h: str | None) -> str | None:
        try:
            return h.encode("idna").decode("ascii") if h else h
        except UnicodeError:
            return h

    return hosts.map(one)
