"""Queries over site files and platform marks derived from the given pages, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import agentic, stack

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: (probe, category, path, what a passing file is: status, type, body); a failing one answers 404, or 200 with a body that doesn't do.
FILES = [
    ("AGT.SITEMAP", "discoverability", "/sitemap.xml", 200, "application/xml", "<urlset></urlset>"),
    ("AGT.MARKDOWN", "content", "/#markdown", 200, "text/markdown", "# x"),
    ("AGT.LLMS_TXT", "content", "/llms.txt", 200, "text/plain", "# Site\n[a](https://a.example)"),
    ("AGT.AUTH_MD", "capabilities", "/auth.md", 200, "text/markdown", "# x"),
    ("AGT.X402", "commerce", "/api", 402, "text/plain", "x"),
    *[(p, c, paths[0], 200, "application/json", "{" + ", ".join(f'"{f}": [1]' for f in (fields if how == "all" else fields[:1])) + "}") for p, c, paths, fields, how in agentic.JSON_PROBES],
]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a site with a start page, a robots file of five kinds and other files, each absent, right, missing or wrong by page_id."""
    i = F.col("i")
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("i"), F.col("page_id").cast("string").alias("site"))
    none = F.create_map().cast("map<string,string>")
    file = lambda path, status, kind, body, headers=none: F.struct(F.lit(path).alias("path"), status.alias("status"), kind.alias("content_type"), headers.alias("headers"), body.alias("body"))
    linked = F.when(i % 3 == 1, F.create_map(F.lit("link"), F.lit("</llms.txt>; rel=alternate"))).otherwise(none)
    start = file("/", F.lit(200), F.lit("text/html"), F.when(i % 2 == 0, "<script src='https://cdn.shopify.com/x.js'></script>").otherwise("<p>hello"), linked)
    kinds = {1: "User-agent: GPTBot\nContent-Signal: search=yes\n", 2: "User-agent: *\n", 4: "nothing"}
    robots_body = F.lit("")
    for k, text in kinds.items():
        robots_body = F.when(i % 5 == k, F.lit(text)).otherwise(robots_body)
    robots = F.when(i % 5 > 0, file("/robots.txt", F.when(i % 5 == 3, 404).otherwise(200), F.lit("text/plain"), robots_body))
    more = []
    for k, (_, _, path, status, kind, body) in enumerate(FILES):
        state = (i * (k + 1) + k) % 4
        answer = F.when(state == 1, status).when(state == 2, 404).otherwise(200)
        more.append(F.when(state > 0, file(path, answer, F.when(state == 3, "text/html").otherwise(kind), F.when(state == 3, '{"x": 1}').otherwise(body))))
    return rows.select("site", F.inline(F.array_compact(F.array(start, robots, *more))))


_STATES = ", ".join(f"('{p}', '{c}', {k})" for k, (p, c, *_) in enumerate(FILES))
_INFORM = ", ".join(f"'{p}'" for p in agentic.INFORM)
_PROBED = f"""with t as (select * from (values {_STATES}) v(probe_id, category, k)), raw as (
  select page_id::varchar as site, page_id as i, probe_id, category, case (page_id * (k + 1) + k) % 4 when 0 then 'error' when 1 then 'pass' else 'fail' end as s from pages, t
  union all select page_id::varchar, page_id, 'AGT.LINK_HEADERS', 'discoverability', case when page_id % 3 = 1 then 'pass' else 'fail' end from pages
  union all select page_id::varchar, page_id, 'AGT.ROBOTS', 'discoverability', case when page_id % 5 = 0 then 'error' when page_id % 5 in (1, 2) then 'pass' else 'fail' end from pages
  union all select page_id::varchar, page_id, unnest(['AGT.AI_BOTS', 'AGT.CONTENT_SIGNALS']), 'access', case page_id % 5 when 0 then 'error' when 1 then 'pass' else 'fail' end from pages
), probed as (select site, probe_id, category, case when category = 'commerce' and i % 2 = 1 then 'n/a' when s = 'fail' and probe_id in ({_INFORM}) then 'info' else s end as status from raw)"""


@_query(f"{_PROBED} select site, probe_id, category, status from probed")
def site_agent_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every probe of every site."""
    return agentic.probe_results(_files(spark, sf_dir))


@_query(
    f"""{_PROBED}, n as (select site, category, count(*) filter (status = 'pass') as passed, count(*) filter (status in ('pass', 'fail')) as total from probed group by all)
select *, case when total > 0 then round_even(100.0::double * passed / total, 0)::int end as score from n"""
)
def site_agent_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by category."""
    return agentic.category_scores(agentic.probe_results(_files(spark, sf_dir)))


@_query(
    f"""{_PROBED}, n as (select site, count(*) filter (status = 'pass') as passed, count(*) filter (status in ('pass', 'fail')) as scored from probed group by all),
s as (select *, case when scored > 0 then round_even(100.0::double * passed / scored, 0)::int else 0 end as score from n)
select *, 'Level ' || case when score >= 95 then 5 when score >= 80 then 4 when score >= 60 then 3 when score >= 40 then 2 when score >= 20 then 1 else 0 end as level from s"""
)
def site_agent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and levels of sites."""
    return agentic.site_scores(agentic.probe_results(_files(spark, sf_dir)))


@_query(
    r"""with h as (select page_id::varchar as site, [case when page_id % 3 = 0 then 'ecommerce_platform_runtime' end, case when page_id % 4 = 1 then 'cart_or_checkout_route' end, case when page_id % 5 = 2 then 'schema_org_product' end] as s from pages)
select site, array_to_string(list_filter(s, lambda x: x is not null), ',') as signals from h"""
)
def site_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of a shop in pages with a platform's script, a cart link or a product's type added."""
    i = F.col("page_id")
    html = F.concat(
        "html", F.when(i % 3 == 0, "<script src='https://cdn.shopify.com/x.js'></script>").otherwise(""), F.when(i % 4 == 1, '<a href="/cart">c</a>').otherwise(""),
        F.when(i % 5 == 2, '<script>{"@type": "Product"}</script>').otherwise(""),
    )
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(i.cast("string").alias("site"), F.array_join(agentic.commerce_signals(html), ",").alias("signals"))


#: Every signal of every platform: (platform, place, weight, where, text, most).
_SIGNALS = [(name, place, w, k, t, min(sum(x for x, _, _ in signals), 10)) for place, (name, signals) in enumerate(stack.SIGNALS.items()) for w, k, t in signals]


def _sample(kind: str, text: str) -> tuple[str, str, str]:
    """A fragment of HTML, and a header's name and value, that show a signal."""
    if kind in ("header", "cookie"):
        name, _, value = (text if kind == "header" else f"set-cookie: {text}=1").partition(":")
        return "", name, value.strip() or "x"
    if kind == "gen":
        return f'<meta name="generator" content="{text} 1">', "", ""
    return re.sub(r"\(\?:[^)]*\)\??", "", text).replace("\\", "") if kind == "re" else text, "", ""


_SHOWN = [_sample(k, t) for _, _, _, k, t, _ in _SIGNALS]
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_LISTS = [f"[{', '.join(_quoted(x[n]) for x in _SHOWN)}][page_id % {len(_SHOWN)} + 1]" for n in range(3)]


@_query(
    f"""with g as (select * from (values {", ".join(f"({_quoted(n)}, {p}, {w}, {_quoted(k)}, {_quoted(t)}, {m})" for n, p, w, k, t, m in _SIGNALS)}) v(stack, place, w, kind, signal, most)),
p as (select page_id, url, html || {_LISTS[0]} as html, {_LISTS[1]} as name, {_LISTS[2]} as value from pages),
f as (select *, lower(html) as low, case when name = '' then '' else lower(name) || ': ' || lower(value) end as blob, case when name = 'set-cookie' then lower(value) else '' end as cookie,
  lower(regexp_extract(html, '(?i)<meta[^>]+name=["'']generator["''][^>]+content=["'']([^"'']+)["'']', 1)) as gen from p),
s as (select url, stack, place, most, sum(w) as score from f join g on case kind when 'html' then contains(low, signal) when 'header' then contains(blob, signal) when 'cookie' then contains(cookie, signal) when 'gen' then contains(gen, signal) else regexp_matches(html, signal) end group by all),
b as (select url, arg_max(stack, (score, -place)) as stack, max(score) as score, arg_max(most, (score, -place)) as most from s group by url)
select f.url, coalesce(b.stack, 'generic') as stack, case when b.stack = 'wordpress' and ({" or ".join(f"contains(low, {_quoted(t)})" for t in stack.SHOP_SIGNALS)}) then 'woocommerce' else '' end as subcategory,
  coalesce(round_even(least(1.0::double, b.score::double / b.most), 2), 0.0::double) as confidence from f left join b on b.url = f.url"""
)
def site_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms of pages that each show one more signal."""
    pick = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in _SHOWN]), (F.col("page_id") % len(_SHOWN) + 1).cast("int"))
    headers: Column = F.when(pick(1) != "", F.create_map(pick(1), pick(2))).otherwise(F.create_map().cast("map<string,string>"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("c").alias("crawl_id"), "url", F.concat("html", pick(0)).alias("html"), headers.alias("headers"))
    return stack.fingerprint(pages).select("url", "stack", "subcategory", "confidence")
