"""A whole audit: pages in, findings, issues and scores out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens import sources
from pagelens.operators import graph, rollups
from pagelens.operators import site_checks as S
from pagelens.operators.checks import CHECKS, page_findings
from pagelens.operators.checks.registry import reads

from .extract import extract_pages
from .storage import settle


@dataclass(frozen=True)
class Audit:
    """Results of an audit; all lazy but the extracted pages, which are written once."""

    pages: DataFrame
    edges: DataFrame
    findings: DataFrame
    issues: DataFrame
    health: DataFrame


def page_links(pages: DataFrame) -> DataFrame:
    """(crawl_id, src, dst) of internal links."""
    return pages.select("crawl_id", F.col("url").alias("src"), F.explode("links").alias("l")).where("l.is_internal").select("crawl_id", "src", F.col("l.href").alias("dst"))


#: Columns that joins add to the pages; only checks that read them are evaluated after the joins.
JOINED = ("inlink_count", "outlink_count", "in_sitemap")


def all_findings(crawl: S.Crawl) -> DataFrame:
    """Findings of every page check and every check over a crawl, before scaling.

    Page checks that read what joins add run on the few columns they need; all others on the extracted
    pages, without a shuffle of them.
    """
    late = [c for c in CHECKS.values() if reads(c, *JOINED)]
    early = [c for c in CHECKS.values() if c not in late]
    found = S.union(page_findings(crawl.pages, early), page_findings(crawl.counted, late), S.site_findings(crawl))
    return found.dropDuplicates(["crawl_id", "url", "check_id"])


def run_audit(pages: DataFrame, sites: DataFrame | None = None, near_threshold: float = 0.9, *, sitemap_files: DataFrame | None = None, **inputs: DataFrame) -> Audit:
    """pages(url, html, and any response columns) through extraction, the link graph, all checks, scaling and precedence.

    sitemap_files(crawl_id, file, body) give each page its membership and the sitemap checks; inputs are those
    of site_checks.Crawl: bots, url_status, blocklist, image_sizes, sitemap_images, sitemap_hreflang, site_names.
    """
    extracted = settle(extract_pages(pages))
    edges = settle(graph.crawl_edges(page_links(extracted), extracted))
    entries = None if sitemap_files is None else sources.sitemap_entries(sitemap_files)
    counted = graph.link_counts(extracted if entries is None else sources.with_sitemap(extracted, entries), edges)
    files = None if sitemap_files is None else sources.sitemap_summary(sitemap_files)
    crawl = S.Crawl(extracted, counted, edges, near_threshold, sites=sites, sitemap_files=files, sitemap_entries=entries, **inputs)
    found = settle(all_findings(crawl))
    final = rollups.apply_precedence(rollups.rescale(found, counted))
    return Audit(counted, edges, final, rollups.issue_counts(final), rollups.health(counted, final))
