"""Registered queries of the explorer's views over rows derived from the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import enrichment, facets, graph
from pagelens.plans import extract as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _pick(n: int, *values: object) -> Column:
    """One of the values by the remainder of page_id."""
    out = None
    for k, v in enumerate(values):
        out = F.when(F.col("page_id") % n == k, F.lit(v)) if out is None else out.when(F.col("page_id") % n == k, F.lit(v))
    return out


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    return pages.select(
        "page_id",
        F.concat(F.lit("c"), i % 3).alias("crawl_id"),
        F.concat(F.lit("https://s.example/p/"), i, F.when(i % 17 == 4, ".PDF?x=1").otherwise("")).alias("url"),
        _pick(6, 200, 200, 301, 404, 503, None).alias("status"),
        (i % 4 != 1).alias("indexable"),
        (i % 5).alias("inlink_count"),
        F.when(i % 8 == 1, None).when(i % 8 == 2, " ").when(i % 8 == 3, F.concat(F.lit(" Same title "), i % 10)).otherwise(F.repeat(F.lit("t"), (i % 80).cast("int"))).alias("title"),
        F.when(i % 7 == 1, None).when(i % 7 == 2, F.concat(F.lit("Shared "), i % 6)).otherwise(F.repeat(F.lit("d"), (i % 170).cast("int"))).alias("meta_desc"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("A"), F.lit("b"))).otherwise(F.array(F.concat(F.lit("h"), i % 50))).alias("h1"),
        _pick(5, None, "NoIndex,follow", "noindex, NOFOLLOW", "", "all").alias("meta_robots"),
        F.when(i % 6 == 1, None).when(i % 6 == 2, " ").when(i % 6 == 3, F.lit("https://s.example/other")).otherwise(F.concat(F.lit("https://s.example/p/"), i, F.when(i % 17 == 4, ".PDF?x=1").otherwise(""))).alias("canonical"),
        (i % 400).cast("int").alias("word_count"),
        (i % 100).cast("double").alias("readability"),
        (i % 3).cast("int").alias("forms_count"),
        F.when(i % 2 == 0, i % 9).alias("sessions"),
        F.when(i % 2 == 0, i % 4).alias("conversions"),
        F.when(i % 3 > 0, i % 3 - 1).alias("spelling_issues"),
    )


_PAGES = """p as (select page_id as i, 'c' || (page_id % 3) as crawl_id, 'https://s.example/p/' || page_id || case when page_id % 17 = 4 then '.PDF?x=1' else '' end as url,
  ([200, 200, 301, 404, 503, null])[(page_id % 6 + 1)::int] as status, page_id % 4 <> 1 as indexable, page_id % 5 as inlink_count,
  case page_id % 8 when 1 then null when 2 then ' ' when 3 then ' Same title ' || (page_id % 10) else repeat('t', (page_id % 80)::int) end as title,
  case page_id % 7 when 1 then null when 2 then 'Shared ' || (page_id % 6) else repeat('d', (page_id % 170)::int) end as meta_desc,
  case page_id % 4 when 0 then [] when 1 then ['A', 'b'] else ['h' || (page_id % 50)] end as h1,
  ([null, 'NoIndex,follow', 'noindex, NOFOLLOW', '', 'all'])[(page_id % 5 + 1)::int] as meta_robots,
  case page_id % 6 when 1 then null when 2 then ' ' when 3 then 'https://s.example/other' else 'https://s.example/p/' || page_id || case when page_id % 17 = 4 then '.PDF?x=1' else '' end end as canonical,
  page_id % 400 as word_count, page_id % 100 as readability, page_id % 3 as forms_count,
  case when page_id % 2 = 0 then page_id % 9 end as sessions, case when page_id % 2 = 0 then page_id % 4 end as conversions, case when page_id % 3 > 0 then page_id % 3 - 1 end as spelling_issues
  from pages)"""


#: Each facet's condition in SQL; shared(x) is written out below.
_FACETS = {
    ("internal", "all"): "true", ("internal", "indexable"): "indexable", ("internal", "non_indexable"): "not indexable", ("internal", "orphan"): "inlink_count = 0",
    ("internal", "3xx"): "status = 301", ("internal", "4xx"): "status = 404", ("internal", "5xx"): "status = 503", ("response", "2xx"): "status = 200", ("response", "3xx"): "status = 301",
    ("response", "4xx"): "status = 404", ("response", "5xx"): "status = 503", ("response", "none"): "status is null",
    ("titles", "missing"): "coalesce(trim(title), '') = ''", ("titles", "duplicate"): "ts", ("titles", "over_60"): "length(title) > 60", ("titles", "under_30"): "length(title) between 1 and 29",
    ("descriptions", "missing"): "coalesce(meta_desc, '') = ''", ("descriptions", "duplicate"): "ds", ("descriptions", "under_120"): "length(meta_desc) between 1 and 119", ("descriptions", "120_and_more"): "length(meta_desc) >= 120",
    ("h1", "missing"): "len(h1) = 0", ("h1", "multiple"): "len(h1) > 1", ("h1", "duplicate"): "hs",
    ("directives", "noindex"): "i % 5 in (1, 2)", ("directives", "nofollow"): "i % 5 = 2", ("directives", "canonicalised"): "i % 6 in (2, 3)",
    ("canonicals", "missing"): "i % 6 in (1, 2)", ("canonicals", "self"): "i % 6 in (0, 4, 5)", ("canonicals", "canonicalised"): "i % 6 in (2, 3)",
    ("content", "thin"): "word_count < 200", ("content", "hard_to_read"): "readability < 30", ("content", "has_forms"): "forms_count > 0",
    ("analytics", "has_data"): "sessions is not null", ("analytics", "no_data"): "sessions is null", ("analytics", "sessions"): "sessions > 0", ("analytics", "conversions"): "conversions > 0",
    ("spelling", "issues"): "spelling_issues > 0", ("spelling", "clean"): "spelling_issues = 0", ("pdf", "all"): "i % 17 = 4", ("pdf", "non_indexable"): "i % 17 = 4 and not indexable",
}


@query(
    f"with {_PAGES}, q as (select *, count(*) over (partition by crawl_id, lower(trim(title))) > 1 and trim(title) <> '' as ts, count(*) over (partition by crawl_id, lower(trim(meta_desc))) > 1 and meta_desc <> '' as ds, count(*) over (partition by crawl_id, lower(array_to_string(h1, ' '))) > 1 and len(h1) > 0 as hs from p) "
    + " union all ".join(f"select crawl_id, '{v}' as \"view\", '{n}' as name, count(*) filter ({c}) as pages from q group by crawl_id" for (v, n), c in _FACETS.items())
)
def facet_counts_all(spark, sf_dir):
    """Every facet of every view, with values for each of them."""
    return facets.facet_counts(_pages(spark, sf_dir))


@query(
    f"""with {_PAGES}, scoped as (select *, string_split(url, '?')[1] as bare from p)
select crawl_id, count(*) filter (i % 10 in (1, 3) and i % 100 not between 10 and 19) as in_scope, count(*) filter (length(url) <= 24) as short, count(*) filter (i % 17 <> 4) as plain, count(*) filter (not coalesce(i % 5 in (1, 2), false) and (i % 6 not in (2, 3))) as shown,
  count(*) filter (status = 404) as focused, count(*) filter (i % 10 = 7 and status > 300) as by_rules, count(*) filter (contains(lower(title), 'same') or contains(lower(meta_robots), 'nofollow')) as found from scoped group by crawl_id"""
)
def page_filters(spark, sf_dir):
    """Pages in scope, within limits, not hidden, in focus, by grid rules and by a search."""
    pages = _pages(spark, sf_dir)
    url = F.col("url")
    flags = pages.withColumn("bare_id", F.col("page_id") % 10).withColumn("x_robots", F.lit(None).cast("string"))
    shown = facets.without_hidden(flags, noindex=True, canonicalised=True).select("page_id", F.lit(True).alias("shown"))
    focused = facets.focus(flags, flags.where("status = 404").select("crawl_id", "url", F.lit("B04").alias("check_id")), "B04").select("page_id", F.lit(True).alias("focused"))
    rows = flags.join(shown, "page_id", "left").join(focused, "page_id", "left")
    conditions = {
        "in_scope": facets.in_scope(F.substring_index(url, ".PDF", 1), (r"[13]$",), (r"1\d$",)),
        "short": facets.within_limits(url, max_length=24),
        "plain": facets.within_limits(url, max_params=0, max_depth=2),
        "shown": F.col("shown"),
        "focused": F.col("focused"),
        "by_rules": facets.rule("bare_id", "equals", 7) & facets.rule("status", "greater", 300),
        "found": facets.search(["title"], "SAME") | facets.search(["meta_robots"], "nofollow"),
    }
    return rows.groupBy("crawl_id").agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


@query(
    """with i as (select page_id, (['Critical', 'High', 'Medium', 'Low', 'Info'])[(page_id % 5 + 1)::int] as severity, (['Content', 'Links', 'Speed'])[(page_id % 3 + 1)::int] as category, 'Title ' || (page_id % 7) as title, case when page_id % 4 > 0 then 'Why it MATTERS ' || (page_id % 6) end as why, 'D' || (page_id % 20) as check_id from pages)
select 'category' as filter, page_id from i where category = 'Links' union all
select 'severities', page_id from i where severity in ('High', 'Low') union all
select 'words', page_id from i where contains(lower(title), 'matters 3') or contains(lower(coalesce(why, '')), 'matters 3') or contains(lower(check_id), 'matters 3') union all
select 'all of them', page_id from i where category = 'Content' and severity in ('Critical', 'Info') and (contains(lower(check_id), 'd1') or contains(lower(title), 'd1'))"""
)
def issue_hub(spark, sf_dir):
    """Issues by category, by a set of severities, by words, and by all at once."""
    i = F.col("page_id")
    issues = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", _pick(5, "Critical", "High", "Medium", "Low", "Info").alias("severity"), _pick(3, "Content", "Links", "Speed").alias("category"),
        F.concat(F.lit("Title "), i % 7).alias("title"), F.when(i % 4 > 0, F.concat(F.lit("Why it MATTERS "), i % 6)).alias("why_it_matters"), F.concat(F.lit("D"), i % 20).alias("check_id"),
    )
    asked = {
        "category": {"category": "Links"},
        "severities": {"severities": ("High", "Low")},
        "words": {"words": " Matters 3 "},
        "all of them": {"category": "Content", "severities": {"Critical", "Info"}, "words": "d1"},
    }
    out = None
    for name, how in asked.items():
        rows = facets.hub_filter(issues, **how).select(F.lit(name).alias("filter"), "page_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    """with cl as (select c_custkey as client_id, c_name as name, 'https://' || lower(c_mktsegment) || '.example' as base_url, c_custkey % 7 = 0 as is_public from customer where c_custkey % 11 <> 0),
cr as (select o_orderkey as crawl_id, o_custkey as client_id, case when o_orderkey % 3 = 0 then 'https://t.example/' || o_orderkey when o_orderkey % 3 = 1 then '' end as target_url, o_orderkey % 500 as url_count from orders)
select 'all' as listing, crawl_id, client_id, case when is_public then 'Public audit' else coalesce(name, 'Unknown') end as client_name, coalesce(nullif(target_url, ''), base_url, '') as base_url, coalesce(target_url, '') as target_url, coalesce(is_public, false) as public, url_count from cr left join cl using (client_id)
union all select 'own', crawl_id, client_id, coalesce(name, 'Unknown'), coalesce(nullif(target_url, ''), base_url, ''), coalesce(target_url, ''), false, url_count from cr left join cl using (client_id) where not coalesce(is_public, false)"""
)
def crawl_clients(spark, sf_dir):
    """Crawls with their clients, with and without public ones."""
    clients = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 11 <> 0").selectExpr("c_custkey as client_id", "c_name as name", "'https://' || lower(c_mktsegment) || '.example' as base_url", "c_custkey % 7 = 0 as is_public")
    crawls = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey as crawl_id", "o_custkey as client_id", "case when o_orderkey % 3 = 0 then 'https://t.example/' || o_orderkey when o_orderkey % 3 = 1 then '' end as target_url", "o_orderkey % 500 as url_count"
    )
    every = enrichment.crawls_with_clients(crawls, clients, include_public=True).select(F.lit("all").alias("listing"), "*")
    return every.unionByName(enrichment.crawls_with_clients(crawls, clients).select(F.lit("own").alias("listing"), "*"))


_TYPES = ["text/html; charset=utf-8", "APPLICATION/PDF", "application/octet-stream", "", None, "image/png", "application/rss+xml", "image/svg+xml", "application/xhtml+xml", "binary/octet-stream"]


@query(
    """select page_id, page_id % 10 in (0, 3, 4, 6, 7, 8) as page_like, page_id % 10 in (0, 3, 4, 8) as html, page_id % 10 = 1 or (page_id % 10 in (2, 3, 4, 9) and page_id % 17 = 4) as pdf from pages"""
)
def content_types(spark, sf_dir):
    """Which responses count as pages, as HTML and as PDF."""
    ct = _pick(10, *_TYPES)
    return _pages(spark, sf_dir).select("page_id", E.is_page_like(ct).alias("page_like"), E.is_html_document(ct).alias("html"), E.is_pdf(ct, F.col("url")).alias("pdf"))


@query(
    """with n as (select count(*) as n from pages), l as (
  select 'c' || (page_id % 3) as crawl_id, 'https://s.example/p/' || page_id as src, (page_id % 6)::int + 1 as depth, unnest([(page_id * 7 + 1) % (2 * n), (page_id * 13 + 3) % (2 * n)]) as t, unnest([false, page_id % 5 = 0]) as nofollow from pages, n)
select crawl_id, 'https://s.example/p/' || t as url, min(depth) as depth, arg_min(src, (depth, src)) as src from l where not nofollow and t % 3 > 0 group by all"""
)
def frontier_next(spark, sf_dir):
    """What the pages' links name that hasn't been visited, with the nearest page that does."""
    i, n = F.col("page_id"), F.col("n")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    rows = pages.join(F.broadcast(pages.agg(F.count("*").alias("n"))))
    link = lambda t, nofollow: F.struct(F.concat(F.lit("https://s.example/p/"), t).alias("href"), F.when(nofollow, F.array(F.lit("nofollow"))).otherwise(F.array().cast("array<string>")).alias("rel"), F.lit(True).alias("is_internal"))
    crawl = F.concat(F.lit("c"), i % 3).alias("crawl_id")
    linked = rows.select(crawl, F.concat(F.lit("https://s.example/p/"), i).alias("url"), (i % 6).cast("int").alias("depth"), F.array(link((i * 7 + 1) % (2 * n), F.lit(False)), link((i * 13 + 3) % (2 * n), i % 5 == 0)).alias("links"))
    ids = rows.select(F.explode(F.array(i * 2, i * 2 + 1)).alias("t")).where("t % 3 = 0").select(F.explode(F.array(*[F.lit(f"c{k}") for k in range(3)])).alias("crawl_id"), F.concat(F.lit("https://s.example/p/"), "t").alias("url"))
    return graph.frontier(linked, ids)
