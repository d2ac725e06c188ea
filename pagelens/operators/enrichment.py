"""Metrics of other tools joined to pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls as U


def join_by_url(pages: DataFrame, metrics: DataFrame, columns: list[str], key: str = "url") -> DataFrame:
    """Left join of search-console or rank metrics by address, or by another key of pages; of several rows of a key the largest counts, by the columns in turn, and whole."""
    one = metrics.groupBy(key).agg(F.max(F.struct(*columns)).alias("_m")).select(key, *[F.col("_m")[c].alias(c) for c in columns])
    return pages.join(one, key, "left")


def best_ga4(metrics: DataFrame) -> DataFrame:
    """The row with the most sessions of each path."""
    rest = [c for c in metrics.columns if c != "path"]
    return metrics.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("sessions", *[c for c in rest if c != "sessions"])).alias("m")).select("path", *[f"m.{c}" for c in rest])


def join_ga4(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each page with the metrics of the first of its path's variants that is known: exact before regardless of case, variant by variant.

    Variants are exploded and joined on equality; the best match per page is picked by rank.
    """
    known = best_ga4(metrics)
    rest = [c for c in known.columns if c != "path"]
    path = F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url")))
    tried = pages.select("crawl_id", "url", F.posexplode(U.path_variants(path)).alias("k", "p"))
    keys = tried.select("crawl_id", "url", F.inline(F.array(F.struct((F.col("k") * 2).alias("rank"), F.col("p").alias("key"), F.lit(False).alias("folded")), F.struct((F.col("k") * 2 + 1).alias("rank"), F.lower("p").alias("key"), F.lit(True).alias("folded")))))
    exact = known.select(F.col("path").alias("key"), F.lit(False).alias("folded"), *rest)
    folded = known.groupBy(F.lower("path").alias("key")).agg(F.max_by(F.struct(*rest), "sessions").alias("m")).select("key", F.lit(True).alias("folded"), *[f"m.{c}" for c in rest])
    hits = keys.join(exact.unionByName(folded), ["key", "folded"])
    best = hits.groupBy("crawl_id", "url").agg(F.min_by(F.struct(*rest), "rank").alias("m")).select("crawl_id", "url", *[f"m.{c}" for c in rest])
    return pages.join(best, ["crawl_id", "url"], "left")


def core_vitals(psi: DataFrame) -> DataFrame:
    """(url, lcp_s, inp_ms, cls, performance): field data before lab data, of psi(url, field_*, lab_*, performance)."""
    return psi.select(
        "url",
        F.coalesce("field_lcp_s", "lab_lcp_s").alias("lcp_s"),
        F.coalesce("field_inp_ms", "lab_inp_ms").alias("inp_ms"),
        F.coalesce("field_cls", "lab_cls").alias("cls"),
        F.bround(F.col("performance") * 100, 0).cast("int").alias("performance"),
    )


def spelling_summary(issues: DataFrame) -> DataFrame:
    """(crawl_id, kind, n) of spelling findings."""
    return issues.groupBy("crawl_id", "kind").agg(F.count("*").alias("n"))


def latest_crawls(crawls: DataFrame) -> DataFrame:
    """The latest crawl of each client and the one before: (client_id, crawl_id, previous_id)."""
    order = Window.partitionBy("client_id").orderBy(F.col("crawl_id").desc())
    rows = crawls.select("client_id", "crawl_id", F.lead("crawl_id").over(order).alias("previous_id"), F.row_number().over(order).alias("place"))
    return rows.where("place = 1").drop("place")


def crawl_list(crawls: DataFrame, n: int = 20) -> DataFrame:
    """The newest crawls, 1 to 200 of them."""
    return crawls.orderBy(F.col("crawl_id").desc()).limit(max(1, min(200, n)))


def crawls_with_clients(crawls: DataFrame, clients: DataFrame, include_public: bool = False) -> DataFrame:
    """(crawl_id, client_id, client_name, base_url, target_url, public, url_count) of crawls(crawl_id, client_id, target_url, url_count) and clients(client_id, name, base_url, is_public).

    Crawls of a public client are left out unless asked for, and then named as such; a crawl without a client stays,
    as `Unknown`. Clients must have one row each.
    """
    known = clients.select("client_id", F.col("name").alias("_name"), F.col("base_url").alias("_base"), "is_public")
    joined = crawls.select("crawl_id", "client_id", "target_url", "url_count").join(known, "client_id", "left")
    public = F.coalesce("is_public", F.lit(False))
    name = F.when(public, "Public audit").otherwise(F.coalesce("_name", F.lit("Unknown")))
    base = F.coalesce(F.nullif("target_url", F.lit("")), "_base", F.lit(""))
    rows = joined if include_public else joined.where(~public)
    return rows.select("crawl_id", "client_id", name.alias("client_name"), base.alias("base_url"), F.coalesce("target_url", F.lit("")).alias("target_url"), public.alias("public"), "url_count")


def without_crawl(tables: dict[str, DataFrame], crawl_id: str) -> dict[str, DataFrame]:
    """Every table without one crawl's rows, to be written in its place; on tables partitioned by crawl_id a filter of folders."""
    return {name: df.where(~F.col("crawl_id").eqNullSafe(F.lit(crawl_id))) for name, df in tables.items()}


def retained(crawls: DataFrame, public_owner: str = "public") -> DataFrame:
    """Crawls to keep: of the public workspace only the latest."""
    newest = crawls.where(F.col("owner") == public_owner).agg(F.max("crawl_id").alias("newest"))
    return crawls.join(newest, (crawls["owner"] == public_owner) & (crawls["crawl_id"] < newest["newest"]), "left_anti")
