"""The whole audit over crawls of derived pages, and what it must find in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.plans.audit import run_audit

#: The checks that the derived pages are made to set off.
CHECKS = ("A04", "B01", "D01", "D02", "D07", "D13", "E01", "E02")


def derived_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two crawls, clean but for a fault by the last digit of page_id: no title (1, 3), a shared title (4), no description (5), noindex (6),
    not found and two headings (7), two headings (8); of twenty, the text of 12 is that of 2, and that of 19 is nearly that of 9."""
    i = F.col("page_id")
    digit, of_twenty = i % 10, i % 20
    own = F.when(of_twenty.isin(12, 19), i - 10).otherwise(i)
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.concat(F.lit("w"), own.cast("string"), F.lit("x"), k.cast("string"))), " ")
    title = F.when(digit.isin(1, 3), "").when(digit == 4, "<title>One title that many pages of this site have</title>").otherwise(F.concat(F.lit("<title>Page "), i.cast("string"), F.lit(" and what there is to say of it</title>")))
    about = F.concat(F.lit('<meta name="description" content="What page '), i.cast("string"), F.lit(" is about, in a sentence that is long enough to be shown whole, and goes on for a while so that it isn't too short"), F.lit('">'))
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head>'), title, F.when(digit == 5, "").otherwise(about), F.when(digit == 6, '<meta name="robots" content="noindex">').otherwise(""), F.lit("</head><body><main><h1>Main heading</h1>"),
        F.when(digit.isin(7, 8), "<h1>Further heading</h1>").otherwise(""), F.lit("<p>"), words, F.when(of_twenty == 19, " changed").otherwise(" end"), F.lit("</p></main></body></html>"),
    )
    crawl = F.when(i % 2 == 0, "even").otherwise("odd")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        crawl.alias("crawl_id"), F.concat(F.lit("https://"), crawl, F.lit(".example/p"), i.cast("string")).alias("url"), html.alias("html"), F.when(digit == 7, 404).otherwise(200).alias("status")
    )


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of run_audit with their severities after coverage and precedence, and how many pages each check counts."""
    audit = run_audit(derived_crawls(spark, sf_dir))
    found = audit.findings.where(F.col("check_id").isin(*CHECKS)).select("crawl_id", "url", "check_id", "severity", "tier")
    return found.join(audit.issues.select("crawl_id", "check_id", "n_pages"), ["crawl_id", "check_id"])


QUERIES = {"audit_findings": audit_findings}
SQL = {
    "audit_findings": """
with p as (
  select page_id as i, page_id % 10 as d, case when page_id % 2 = 0 then 'even' else 'odd' end as crawl_id, page_id % 10 <> 6 as indexable, case when page_id % 10 = 7 then 404 else 200 end as status,
    case when page_id % 20 in (12, 19) then page_id - 10 else page_id end as own, page_id % 20 = 19 as changed from pages
), q as (
  select *, 'https://' || crawl_id || '.example/p' || i as url, count(*) over (partition by crawl_id, own, changed, d in (7, 8)) as same, count(*) over (partition by crawl_id, own) as alike,
    count(*) filter (d = 4) over (partition by crawl_id) as titled from p
), f as (
  select crawl_id, url, 'A04' as check_id, 4 as rank, 'REVIEW' as tier from q where d = 6
  union all select crawl_id, url, 'B01', 2, 'REVIEW' from q where d = 7
  union all select crawl_id, url, 'D01', 3, 'AUTO' from q where d in (1, 3)
  union all select crawl_id, url, 'D02', 3, 'REVIEW' from q where d = 4 and titled > 1
  union all select crawl_id, url, 'D07', 2, 'AUTO' from q where d = 5
  union all select crawl_id, url, 'D13', 1, 'REVIEW' from q where d in (7, 8)
  union all select crawl_id, url, 'E01', 3, 'REVIEW' from q where same > 1
  union all select crawl_id, url, 'E02', 2, 'REVIEW' from q where alike > 1
), eligible as (
  select crawl_id, count(*) filter (status = 200) as n from p group by crawl_id
), affected as (
  select crawl_id, check_id, count(distinct url) as n from f group by all
), scaled as (
  select f.*, case when a.n < 5 then rank else greatest(rank, least(3, rank + case when a.n / e.n >= 0.4 then 2 when a.n / e.n >= 0.2 then 1 else 0 end)) end as raised
  from f join affected a using (crawl_id, check_id) join eligible e using (crawl_id)
), kept as (
  select s.* from scaled s where not (s.check_id[1] in ('D', 'E') and exists (select 1 from f where f.url = s.url and f.check_id = 'B01')) and not (s.check_id = 'E02' and exists (select 1 from f where f.url = s.url and f.check_id = 'E01'))
)
select crawl_id, url, check_id, (['Info', 'Low', 'Medium', 'High', 'Critical'])[raised + 1] as severity, tier, count(*) over (partition by crawl_id, check_id) as n_pages from kept
"""
}
