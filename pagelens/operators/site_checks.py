"""Checks that need more than one page: joins and groups over a crawl."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as X
from pagelens.functions import urls as U

from . import duplicates as D
from . import robots as R

FINDING = ["crawl_id", "url", "check_id", "severity", "tier", "evidence"]
#: Elements that don't belong into a head.
FLOW = (
    r"(?i)<(img|div|p|span|a|h[1-6]|ul|ol|li|table|section|article|header|footer|nav|form|button|iframe|main|aside|picture|figure)\b"
)
ASSET_PATHS = ("/wp-includes/css/style.css", "/wp-includes/js/main.js", "/assets/app.css", "/assets/app.js")
#: Severity and tier of each check here.
SPECS = {
    "D02": ("High", "REVIEW"), "D06": ("Low", "REVIEW"), "D08": ("Medium", "REVIEW"), "D14": ("Low", "REVIEW"), "E01": ("High", "REVIEW"),
    "E02": ("Medium", "REVIEW"), "E03": ("Medium", "REVIEW"), "E05": ("Medium", "REVIEW"), "E06": ("Medium", "REVIEW"), "I01": ("High", "REVIEW"),
    "I02": ("High", "REVIEW"), "K01": ("Medium", "REVIEW"), "K02": ("Medium", "REVIEW"), "K03": ("Medium", "REVIEW"), "K04": ("Low", "REVIEW"),
    "K05": ("Medium", "REVIEW"), "K06": ("Medium", "FLAG"), "K07": ("High", "FLAG"), "K08": ("Low", "REVIEW"), "K09": ("Low", "REVIEW"),
    "K10": ("Low", "FLAG"), "L01": ("Critical", "FLAG"), "L02": ("High", "REVIEW"), "L03": ("High", "REVIEW"), "L04": ("Medium", "FLAG"),
    "L05": ("Medium", "FLAG"), "L06": ("Low", "REVIEW"), "L07": ("Low", "FLAG"), "M04": ("Critical", "FLAG"), "M10": ("Medium", "FLAG"),
    "R01": ("Info", "REVIEW"), "R02": ("High", "REVIEW"), "R04": ("High", "FLAG"), "S01": ("Info", "REVIEW"), "S02": ("Low", "REVIEW"),
    "S03": ("Low", "REVIEW"), "S04": ("Info", "REVIEW"), "T08": ("Medium", "REVIEW"), "V10": ("Critical", "FLAG"), "W04": ("Low", "REVIEW"),
    "W05": ("Medium", "REVIEW"), "B04": ("High", "REVIEW"), "B05": ("Medium", "REVIEW"), "B09": ("Medium", "REVIEW"), "B10": ("High", "REVIEW"),
    "B14": ("High", "REVIEW"), "C03": ("High", "REVIEW"), "A01": ("Critical", "REVIEW"), "A02": ("High", "REVIEW"), "A03": ("Critical", "FLAG"),
    "A15": ("Low", "REVIEW"), "G01": ("Medium", "REVIEW"), "G02": ("Low", "REVIEW"), "G05": ("Medium", "FLAG"), "H04": ("Medium", "AUTO"),
    "H06": ("Medium", "REVIEW"), "H10": ("Low", "REVIEW"), "H11": ("Low", "REVIEW"), "J06": ("Medium", "REVIEW"), "J07": ("Medium", "REVIEW"),
    "J11": ("High", "REVIEW"), "I07": ("Medium", "REVIEW"), "V13": ("Low", "REVIEW"), "V14": ("Low", "REVIEW"), "V15": ("Low", "REVIEW"),
    "V16": ("Low", "REVIEW"), "V17": ("Low", "REVIEW"),
}


def finding(rows: DataFrame, check_id: str, evidence: Column | None = None, severity: Column | None = None) -> DataFrame:
    base, tier = SPECS[check_id]
    return rows.select(
        "crawl_id",
        F.col("url"),
        F.lit(check_id).alias("check_id"),
        (F.lit(base) if severity is None else severity).alias("severity"),
        F.lit(tier).alias("tier"),
        (F.lit(None).cast("string") if evidence is None else F.to_json(evidence)).alias("evidence"),
    )


def _page_findings(rows: DataFrame, checks: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """finding of each check, with its condition and evidence, in one scan of the rows."""
    no_evidence = F.lit(None).cast("string")
    parts = [
        F.when(
            condition,
            F.struct(*[F.lit(x).alias(n) for x, n in zip((k, *SPECS[k]), ("check_id", "severity", "tier"), strict=True)], (no_evidence if e is None else F.to_json(e)).alias("evidence")),
        )
        for k, (condition, e) in checks.items()
    ]
    return rows.select("crawl_id", "url", F.array(*parts).alias("_found")).select("crawl_id", "url", F.inline_outer("_found")).where("check_id is not null")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _eligible(pages: DataFrame) -> DataFrame:
    return pages.where((F.col("status") == 200) & F.col("indexable"))


def _key(c: Column) -> Column:
    return F.nullif(F.lower(X.strip_ws(c)), F.lit(""))


def duplicate_checks(pages: DataFrame, near_threshold: float = 0.9, skip_paginated: bool = False) -> DataFrame:
    """D02, D08, D14, D06, E01, E02, E03, E05 and E06."""
    good = _eligible(pages)
    title, desc, h1 = _key(F.col("title")), _key(F.col("meta_desc")), _key(F.get("h1", 0))
    shared = lambda rows, key, check: finding(D.exact_duplicates(rows, key, "crawl_id"), check, F.struct("key_value", "members"))
    body = pages if not skip_paginated else pages.where(~D.is_paginated(F.col("url"), F.col("prev_url"), F.col("next_url")))
    both = pages.where("title is not null and size(h1) > 0")
    same = both.groupBy("crawl_id").agg(F.bool_and(F.trim("title") == F.trim(F.get("h1", 0))).alias("same")).where("same")
    for_near = body.where("main_text <> ''").select("crawl_id", "url", "main_text")
    clusters = D.near_duplicate_clusters(for_near, "url", "main_text", near_threshold, by=("crawl_id",))
    near = clusters.select("crawl_id", F.col("id").alias("url"), (F.col("members") - 1).alias("near"), "cluster", "similarity")
    wp_query = r"(?:^|&)(p|page_id|attachment_id)=\d+"
    return union(
        shared(good, title, "D02"),
        shared(good, desc, "D08"),
        shared(good, h1, "D14"),
        finding(both.join(same, "crawl_id", "left_semi"), "D06"),
        shared(body, F.nullif(F.col("content_hash"), F.md5(F.lit(""))), "E01"),
        finding(near, "E02", F.struct("near", "cluster", "similarity")),
        finding(pages.where(U.path(F.col("url")).endswith("/index.php") | U.query(F.col("url")).rlike(wp_query)), "E03"),
        shared(good, F.when(title.isNotNull() & desc.isNotNull(), F.concat_ws("|", title, desc)), "E05"),
        shared(good, F.when(title.isNotNull() & h1.isNotNull(), F.concat_ws("|", title, h1)), "E06"),
    )


def link_checks(pages: DataFrame, edges: DataFrame, url_status: DataFrame | None = None, external: DataFrame | None = None, blocklist: DataFrame | None = None) -> DataFrame:
    """B04 and B09 by the status of crawled targets, B05, G01, G02 and G05 by that of known external ones.

    edges(crawl_id, src, dst), external(crawl_id, src, href), url_status(url, status), blocklist(host).
    Targets are reduced to the broken or redirecting ones before the join; the first ten per page are shown.
    """
    target = pages.where(F.col("status") >= 300).select("crawl_id", F.col("url").alias("dst"), F.col("status").alias("dst_status"))
    hits = edges.join(target, ["crawl_id", "dst"])
    shown = F.struct(F.slice(F.array_sort(F.collect_set("dst")), 1, 10).alias("targets"))

    def per_page(rows: DataFrame, check: str) -> DataFrame:
        grouped = rows.groupBy("crawl_id", F.col("src").alias("url")).agg(shown.alias("e"))
        return finding(grouped, check, F.col("e"))

    parts = [per_page(hits.where("dst_status >= 400"), "B04"), per_page(hits.where("dst_status between 300 and 399"), "B09")]
    if external is not None and url_status is not None:
        known = external.withColumnRenamed("href", "dst").join(url_status.select(F.col("url").alias("dst"), F.col("status").alias("dst_status")), "dst")
        broken = known.where("dst_status >= 400 or dst_status = 0")
        parts += [per_page(broken, "B05"), per_page(known.where("dst_status >= 400"), "G01"), per_page(known.where("dst_status between 300 and 399"), "G02")]
    if external is not None and blocklist is not None:
        spam = external.withColumn("host", U.host(F.col("href"))).join(blocklist, "host", "left_semi").withColumnRenamed("href", "dst")
        parts.append(per_page(spam, "G05"))
    return union(*parts)


def canonical_checks(pages: DataFrame) -> DataFrame:
    """B10, C03 and B14: canonical targets that redirect or aren't indexable, and templates with mixed redirects."""
    target = pages.select("crawl_id", F.col("url").alias("canonical"), F.col("status").alias("t_status"), F.col("indexable").alias("t_indexable"))
    joined = pages.where("canonical is not null").select("crawl_id", "url", "canonical").join(target, ["crawl_id", "canonical"])
    template = U.url_template(F.col("url"))
    moved = pages.where(F.col("status").isin(301, 302)).withColumn("template", template)
    mixed = moved.groupBy("crawl_id", "template").agg(F.count_distinct("status").alias("kinds")).where("kinds > 1")
    return union(
        finding(joined.where("t_status between 300 and 399"), "B10", F.struct("canonical", "t_status")),
        finding(joined.where("not t_indexable and canonical <> url"), "C03", F.struct("canonical")),
        finding(moved.join(mixed, ["crawl_id", "template"], "left_semi"), "B14", F.struct("template")),
    )


def hreflang_checks(pages: DataFrame, sitemap_hreflang: DataFrame | None = None) -> DataFrame:
    """I01 versions that don't link back, I02 versions that don't answer 200, I07 page and sitemap that differ."""
    refs = pages.select("crawl_id", "url", F.explode("hreflang").alias("h")).select("crawl_id", "url", F.col("h.lang").alias("lang"), F.col("h.href").alias("dst"))
    crawled = pages.select("crawl_id", F.col("url").alias("dst"), "status", "canonical")
    known = refs.where("dst <> url").join(crawled, ["crawl_id", "dst"])
    back = refs.select("crawl_id", F.col("url").alias("dst"), F.col("dst").alias("url")).distinct()
    missing = known.join(back, ["crawl_id", "url", "dst"], "left_anti")
    wrong = known.where("status <> 200 or canonical <> dst")
    per_page = lambda rows: rows.groupBy("crawl_id", "url").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    parts = [finding(per_page(missing), "I01", F.struct("targets")), finding(per_page(wrong), "I02", F.struct("targets"))]
    if sitemap_hreflang is not None:
        a, b = refs.select("crawl_id", "url", "lang", "dst").distinct(), sitemap_hreflang.select("crawl_id", "url", "lang", "dst").distinct()
        differ = a.exceptAll(b).unionByName(b.exceptAll(a))
        parts.append(finding(per_page(differ), "I07", F.struct("targets")))
    return union(*parts)


def sitemap_checks(pages: DataFrame, sitemap_files: DataFrame, sites: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """K01 to K06 from pages with in_sitemap, sitemap_files(crawl_id, file, n_urls, bytes, well_formed) and sites; K07 to K10 with entries(crawl_id, url, lastmod)."""
    site_url = F.coalesce("base_url", F.concat(F.lit("https://"), "crawl_id", F.lit("/")))
    listed = pages.where("in_sitemap")
    has_files = sitemap_files.select("crawl_id").distinct()
    no_files = sites.join(has_files, "crawl_id", "left_anti").withColumn("url", site_url)
    unnamed = sites.join(has_files, "crawl_id", "left_semi").where(~F.coalesce(F.lower("robots_txt").contains("sitemap:"), F.lit(False))).withColumn("url", site_url)
    files = sitemap_files.withColumn("url", F.col("file"))
    parts = [
        finding(no_files, "K01", severity=F.lit("Medium")),
        finding(unnamed, "K01", severity=F.lit("Low")),
        finding(listed.where("status <> 200"), "K02", F.struct("status")),
        finding(listed.where("not indexable or canonical <> url"), "K03"),
        finding(listed.where("status in (301, 302, 307, 308)"), "K04", F.struct("status")),
        finding(_eligible(pages).where("not in_sitemap").join(has_files, "crawl_id", "left_semi"), "K05"),
        finding(files.where("n_urls > 50000 or bytes > 52428800"), "K06", F.struct("n_urls", "bytes")),
        finding(files.where("not well_formed"), "K07"),
    ]
    if entries is not None:
        known = pages.select("crawl_id", "url", "inlink_count")
        linked = entries.join(known.where("inlink_count > 0"), ["crawl_id", "url"], "left_anti")
        dates = entries.groupBy("crawl_id").agg(F.count_distinct("lastmod").alias("dates"), F.count("*").alias("n"), F.max("lastmod").alias("newest"))
        bad = entries.join(dates, "crawl_id").where("lastmod is null or lastmod > current_timestamp() or (dates = 1 and n > 1)")
        parts += [finding(bad, "K08"), finding(linked, "K09")]
        if "modified_at" in pages.columns:
            fresh = pages.groupBy("crawl_id").agg(F.max("modified_at").alias("page_newest"))
            stale = dates.join(fresh, "crawl_id").where("newest < page_newest").join(sites, "crawl_id").withColumn("url", site_url)
            parts.append(finding(stale, "K10", F.struct("newest", "page_newest")))
    return union(*parts)


def robots_checks(pages: DataFrame, sites: DataFrame, important: tuple[str, ...] = ("/blog/", "/products/", "/services/")) -> DataFrame:
    """A01, A02, A03, A15 and L01 to L07 from pages, their links and sites(crawl_id, base_url, robots_txt, robots_status, robots_type)."""
    url = F.coalesce("base_url", F.concat(F.lit("https://"), "crawl_id", F.lit("/")))
    site = sites.withColumn("url", url)
    rules, lines = R.robots_rules(sites), R.robots_lines(sites)
    with_url = lambda rows: rows.join(site.select("crawl_id", "url"), "crawl_id").dropDuplicates(["crawl_id"])
    allowed = lambda asked: R.robots_allowed(asked.withColumn("agent", F.lit("Googlebot")), rules)
    root = F.regexp_replace("url", r"^([a-z]+://[^/]+).*$", "$1")

    def paths(which) -> DataFrame:
        asked = site.select("crawl_id", F.explode(F.transform(F.array(*[F.lit(p) for p in which]), lambda p: F.concat(root, p))).alias("url"))
        shut = allowed(asked).where("not allowed").groupBy("crawl_id").agg(F.array_sort(F.collect_set("url")).alias("paths"))
        return shut.join(site.select("crawl_id", "url"), "crawl_id")

    assets = paths(ASSET_PATHS)
    linked = pages.select("crawl_id", F.col("url").alias("src"), F.explode("links").alias("l")).where("l.is_internal").select("crawl_id", "src", F.col("l.href").alias("url")).distinct()
    shut = allowed(linked).where("not allowed").groupBy("crawl_id", F.col("src").alias("url")).agg(F.slice(F.array_sort(F.collect_set("url")), 1, 10).alias("targets"))
    return union(
        finding(allowed(pages.where("status = 200").select("crawl_id", "url")).where("not allowed"), "A01"),
        finding(assets, "A02", F.struct("paths")),
        finding(site.where("robots_status >= 500"), "A03", F.struct("robots_status")),
        finding(shut, "A15", F.struct("targets")),
        finding(with_url(lines.where("field = 'disallow' and value = '/'").select("crawl_id")), "L01"),
        finding(paths(important), "L02", F.struct("paths")),
        finding(assets, "L03", F.struct("paths")),
        finding(with_url(lines.where(F.col("field").isin("allow", "disallow") & F.col("value").rlike(r"^[^/*]|\*\*|\$.")).select("crawl_id")), "L04"),
        finding(site.where((F.col("robots_status") == 200) & ~F.coalesce(F.lower("robots_type").contains("text/plain"), F.lit(False))), "L05", F.struct("robots_type")),
        finding(site.where("robots_txt is not null").join(lines.where("field = 'sitemap'"), "crawl_id", "left_anti"), "L06"),
        finding(with_url(lines.where((F.col("field") == "crawl-delay") & (F.col("value").try_cast("double") > 5)).select("crawl_id")), "L07"),
    )


def probe_checks(sites: DataFrame, bots: DataFrame | None = None) -> DataFrame:
    """M04, M10, R01, R02, R04, S01 to S04, V10, W04 and W05 from what probes measured of each site."""
    url = F.coalesce("base_url", F.concat(F.lit("https://"), "crawl_id", F.lit("/")))
    site = sites.withColumn("url", url)
    for name, kind in {
        "cert_days": "int", "xmlrpc_open": "boolean", "rest_users_open": "boolean", "llms_status": "int", "llms_body": "string", "llms_full_status": "int",
        "not_found_status": "int", "homepage_versions_200": "int", "robots_txt": "string",
    }.items():
        if name not in site.columns:
            site = site.withColumn(name, F.lit(None).cast(kind))
    n_links = F.greatest(F.regexp_count("llms_body", F.lit(r"\[[^\]]*\]\([^)]+\)")), F.regexp_count("llms_body", F.lit(r"https?://\S+")))
    has_h1 = F.col("llms_body").rlike(r"(?m)^#\s+\S")
    flags = F.array_compact(F.array(F.when(F.col("xmlrpc_open"), "xmlrpc"), F.when(F.col("rest_users_open"), "rest_users")))
    parts = [
        finding(site.where("cert_days <= 30"), "M04", F.struct("cert_days"), F.when(F.col("cert_days") < 0, "Critical").otherwise("High")),
        finding(site.withColumn("flag", F.explode(flags)), "M10", F.struct("flag")),
        finding(site.where("llms_status <> 200"), "S01"),
        finding(site.where((F.col("llms_status") == 200) & (~has_h1 | (F.length("llms_body") < 50) | (n_links == 0))), "S02"),
        finding(site.where((n_links > 0) & (F.length("llms_body") < 40 * n_links)), "S03"),
        finding(site.where("llms_status = 200 and llms_full_status <> 200"), "S04"),
        finding(site.where(F.lower("url").rlike(r"staging\.|dev\.|test\.") & (F.trim("robots_txt") != "") & ~F.lower("robots_txt").contains("disallow: /")), "V10"),
        finding(site.where("not_found_status <> 0 and not_found_status <> 404 and not_found_status < 500"), "W04", F.struct("not_found_status")),
        finding(site.where("homepage_versions_200 > 1"), "W05", F.struct("homepage_versions_200")),
    ]
    if bots is not None:
        shut = lambda names: bots.where(F.col("bot").isin(*names) & ~F.col("robots_allowed")).groupBy("crawl_id").agg(F.array_sort(F.collect_set("bot")).alias("bots"))
        live = bots.where("robots_allowed and not live_ok").groupBy("crawl_id").agg(F.array_sort(F.collect_set("bot")).alias("bots"))
        urls = site.select("crawl_id", "url")
        parts += [
            finding(shut(R.TRAINING_BOTS).join(urls, "crawl_id"), "R01", F.struct("bots")),
            finding(shut(R.SEARCH_BOTS).join(urls, "crawl_id"), "R02", F.struct("bots")),
            finding(live.join(urls, "crawl_id"), "R04", F.struct("bots")),
        ]
    return union(*parts)


def slash_check(pages: DataFrame) -> DataFrame:
    """T08: a crawl whose indexable addresses end in a slash here and not there; one finding per crawl."""
    path = U.path(F.col("url"))
    inner = pages.where(F.col("indexable") & ~path.isin("", "/"))
    counts = inner.groupBy("crawl_id").agg(
        F.count_if(path.endswith("/")).alias("with_slash"), F.count_if(~path.endswith("/")).alias("without_slash"), F.min("url").alias("url")
    )
    return finding(counts.where("with_slash > 0 and without_slash > 0"), "T08", F.struct("with_slash", "without_slash"))


def validation_checks(pages: DataFrame) -> DataFrame:
    """V13 to V17 on HTML pages that answer 200."""
    kind = F.lower(F.coalesce(F.col("headers")["content-type"], F.lit("")))
    rows = pages.where((F.col("status") == 200) & ((kind == "") | kind.contains("html")) & X.has_text(F.col("html")))
    head = F.regexp_extract("html", r"(?is)<head\b[^>]*>(.*?)</head>", 1)
    bare = F.regexp_replace(F.regexp_replace(head, r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>", ""), r"(?s)<!--.*?-->", "")
    flow = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(FLOW), F.lit(1)), F.lower))
    return _page_findings(
        rows,
        {
            "V13": (~F.col("html").rlike(r"(?i)^\s*<!doctype\s+html"), None),
            "V14": (F.coalesce(F.trim("lang"), F.lit("")) == "", None),
            "V15": (F.col("title_count") > 1, F.struct("title_count")),
            "V16": (~F.lower(F.substring("html", 1, 1024)).contains("charset") & ~kind.contains("charset"), None),
            "V17": (F.size(flow) > 0, F.struct(F.slice(flow, 1, 10).alias("flow"))),
        },
    )


def image_checks(pages: DataFrame, sizes: DataFrame, sitemap_images: DataFrame | None = None) -> DataFrame:
    """H04, H06 and H10 by sizes(src, bytes, status, natural_width, rendered_width), H11 by sitemap_images(src)."""
    images = pages.select("crawl_id", "url", F.explode("images").alias("i")).select("crawl_id", "url", F.col("i.src").alias("src"))
    known = images.join(sizes, "src")
    per_page = lambda rows: rows.groupBy("crawl_id", "url").agg(F.slice(F.array_sort(F.collect_set("src")), 1, 10).alias("images"))
    parts = [
        finding(per_page(known.where("bytes > 102400")), "H04", F.struct("images")),
        finding(per_page(known.where("status between 400 and 499")), "H06", F.struct("images")),
        finding(per_page(known.where("rendered_width > 0 and natural_width >= 2 * rendered_width")), "H10", F.struct("images")),
    ]
    if sitemap_images is not None:
        parts.append(finding(per_page(images.join(sitemap_images, "src", "left_anti")), "H11", F.struct("images")))
    return union(*parts)


def schema_checks(pages: DataFrame, site_names: DataFrame | None = None) -> DataFrame:
    """J06 ids with several types, J07 sites without their own schema, J11 names that differ from site_names(crawl_id, name)."""
    blocks = pages.select("crawl_id", "url", F.explode("jsonld").alias("j")).where("j.error is null")
    items = blocks.select("crawl_id", "url", F.get_json_object("j.block", "$.@id").alias("id"), F.array_join("j.types", ",").alias("types"), "j.block")
    several = items.where("id is not null").groupBy("crawl_id", "id").agg(F.count_distinct("types").alias("kinds")).where("kinds > 1")
    own = blocks.where(F.arrays_overlap(F.transform("j.types", F.lower), F.array(F.lit("organization"), F.lit("localbusiness"), F.lit("website")))).select("crawl_id").distinct()
    without = pages.groupBy("crawl_id").agg(F.min("url").alias("url")).join(own, "crawl_id", "left_anti")
    parts = [finding(items.join(several, ["crawl_id", "id"], "left_semi").select("crawl_id", "url", "id").distinct(), "J06", F.struct("id")), finding(without, "J07")]
    if site_names is not None:
        named = items.where(F.col("types").rlike("LocalBusiness|Organization")).withColumn("said", F.get_json_object("block", "$.name"))
        parts.append(finding(named.join(site_names, "crawl_id").where("said <> name").select("crawl_id", "url", "said").distinct(), "J11", F.struct("said")))
    return union(*parts)


@dataclass(frozen=True)
class Crawl:
    """What checks over a crawl read. pages are the extracted ones; counted has link counts and sitemap membership too; the rest may be missing."""

    pages: DataFrame
    counted: DataFrame
    edges: DataFrame
    near_threshold: float = 0.9
    skip_paginated: bool = False
    sites: DataFrame | None = None
    bots: DataFrame | None = None
    url_status: DataFrame | None = None
    blocklist: DataFrame | None = None
    image_sizes: DataFrame | None = None
    sitemap_images: DataFrame | None = None
    sitemap_files: DataFrame | None = None
    sitemap_entries: DataFrame | None = None
    sitemap_hreflang: DataFrame | None = None
    site_names: DataFrame | None = None

    def external_links(self) -> DataFrame:
        rows = self.pages.select("crawl_id", F.col("url").alias("src"), F.explode("links").alias("l")).where("not l.is_internal")
        return rows.select("crawl_id", "src", F.col("l.href").alias("href")).distinct()


SiteCheck = Callable[[Crawl], DataFrame | None]
SITE_CHECKS: dict[str, SiteCheck] = {}


def register_site_check(check: SiteCheck) -> SiteCheck:
    """Adds a function from a Crawl to findings, or to None where its inputs are missing; the last one of a name counts."""
    SITE_CHECKS[check.__name__] = check
    return check


def site_findings(crawl: Crawl) -> DataFrame:
    """The findings of all registered checks that have their inputs."""
    return union(*[found for check in SITE_CHECKS.values() if (found := check(crawl)) is not None])


@register_site_check
def duplicates(crawl: Crawl) -> DataFrame:
    return duplicate_checks(crawl.pages, crawl.near_threshold, crawl.skip_paginated)


@register_site_check
def links(crawl: Crawl) -> DataFrame:
    outward = crawl.url_status is not None or crawl.blocklist is not None
    return link_checks(crawl.pages, crawl.edges, crawl.url_status, crawl.external_links() if outward else None, crawl.blocklist)


@register_site_check
def canonicals(crawl: Crawl) -> DataFrame:
    return canonical_checks(crawl.pages)


@register_site_check
def languages(crawl: Crawl) -> DataFrame:
    return hreflang_checks(crawl.pages, crawl.sitemap_hreflang)


@register_site_check
def sitemaps(crawl: Crawl) -> DataFrame | None:
    if crawl.sitemap_files is None or crawl.sites is None:
        return None
    return sitemap_checks(crawl.counted, crawl.sitemap_files, crawl.sites, crawl.sitemap_entries)


@register_site_check
def robots(crawl: Crawl) -> DataFrame | None:
    return None if crawl.sites is None else robots_checks(crawl.pages, crawl.sites)


@register_site_check
def probes(crawl: Crawl) -> DataFrame | None:
    return None if crawl.sites is None else probe_checks(crawl.sites, crawl.bots)


@register_site_check
def slashes(crawl: Crawl) -> DataFrame:
    return slash_check(crawl.pages)


@register_site_check
def validation(crawl: Crawl) -> DataFrame:
    return validation_checks(crawl.pages)


@register_site_check
def images(crawl: Crawl) -> DataFrame | None:
    return None if crawl.image_sizes is None else image_checks(crawl.pages, crawl.image_sizes, crawl.sitemap_images)


@register_site_check
def schemas(crawl: Crawl) -> DataFrame:
    return schema_checks(crawl.pages, crawl.site_names)
