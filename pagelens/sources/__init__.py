"""Readers and writers of crawls and of the files around them."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.text import strip_ws
from pagelens.plans.storage import settle

#: Column names of a crawler's export.
EXPORT = {
    "Address": ("url", "string"), "Status Code": ("status", "int"), "Title 1": ("title", "string"), "Meta Description 1": ("meta_desc", "string"),
    "H1-1": ("h1", "string"), "H2-1": ("h2", "string"), "Canonical Link Element 1": ("canonical", "string"), "Meta Robots 1": ("meta_robots", "string"),
    "X-Robots-Tag 1": ("x_robots", "string"), "Word Count": ("word_count", "int"), "Size (bytes)": ("size", "int"), "Response Time": ("response_time", "double"),
    "Crawl Depth": ("depth", "int"), "Inlinks": ("inlink_count", "int"), "Outlinks": ("outlink_count", "int"), "Indexability": ("indexability", "string"),
    "Hash": ("content_hash", "string"),
}
DEFAULTS = {"status": 200, "word_count": 0, "size": 0, "depth": 0, "inlink_count": 0, "outlink_count": 0}


def read_pages(spark: SparkSession, path: str, crawl_id: str | None = None) -> DataFrame:
    """Stored pages; with a crawl_id only that partition is read."""
    pages = spark.read.parquet(path)
    return pages if crawl_id is None else pages.where(F.col("crawl_id") == crawl_id)


def write_pages(pages: DataFrame, path: str, with_html: bool = True) -> None:
    """Pages by crawl, without the elements and, if asked for, without the HTML; a crawl written again replaces its partition."""
    kept = [c for c in pages.columns if c != "elements" and (with_html or c != "html")]
    writer = pages.select(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("crawl_id").parquet(path)


def read_crawl_csv(spark: SparkSession, path: str) -> DataFrame:
    """A crawler's CSV export with the page columns: a leading byte-order mark is ignored, numbers that don't parse get their defaults, rows without an address go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    columns = []
    for label, (name, kind) in EXPORT.items():
        value = F.col(f"`{label}`") if label in raw.columns else F.lit(None).cast("string")
        if kind != "string":
            value = F.coalesce(value.try_cast(kind), F.lit(DEFAULTS.get(name)).cast(kind))
        elif name in ("h1", "h2"):
            value = F.filter(F.array(value), lambda v: strip_ws(v) != "")
        columns.append(value.alias(name))
    return raw.select(columns).where(strip_ws(F.col("url")) != "").withColumn("indexable", F.coalesce(F.lower("indexability") != "non-indexable", F.lit(True)))


def parse_url_list(rows: DataFrame, column: str = "value") -> DataFrame:
    """(url): addresses out of pasted text, https added where the scheme lacks, other words left out, each once."""
    items = rows.select(F.explode(F.split(column, "[\n,]")).alias("u")).select(strip_ws(F.col("u")).alias("u"))
    kept = items.where(F.col("u").rlike(r"(?i)^https?://") | F.col("u").rlike(r"(?i)^[\w.-]+\.[a-z]{2,}"))
    return kept.select(F.when(F.col("u").rlike(r"(?i)^https?://"), F.col("u")).otherwise(F.concat(F.lit("https://"), "u")).alias("url")).distinct()


_SITEMAP = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string,lastmod:string>>, _broken string"


def _with_xml(files: DataFrame) -> DataFrame:
    """files with the column x: the body as Spark's XML parser reads it, whatever its name spaces; null fields where it isn't well-formed."""
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_broken"}
    return files.withColumn("x", F.from_xml("body", _SITEMAP, options))


def _locations(kind: str) -> Column:
    """(loc, lastmod) of the url or sitemap items of a parsed file; of one that isn't well-formed, what its whole items say."""
    items = F.regexp_extract_all("body", F.lit(rf"(?is)<(?:[\w-]+:)?{kind}\b[^>]*>(.*?)</(?:[\w-]+:)?{kind}>"), F.lit(1))

    def inside(item: Column, tag: str) -> Column:
        raw = F.regexp_extract(item, rf"(?is)<(?:[\w-]+:)?{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:[\w-]+:)?{tag}>", 1)
        return F.replace(raw, F.lit("&amp;"), F.lit("&"))

    found = F.transform(items, lambda i: F.struct(inside(i, "loc").alias("loc"), inside(i, "lastmod").alias("lastmod")))
    return F.when(F.col("x._broken").isNotNull(), found).otherwise(F.col(f"x.{kind}"))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(crawl_id, file, url, lastmod) of files(crawl_id, file, body); entries of index files are those of other files and aren't pages.

    Bodies are read as XML, with any prefixes and CDATA; of a body that isn't well-formed the whole entries count.
    Empty and null bodies have none.
    """
    rows = _with_xml(files).select("crawl_id", "file", F.inline(_locations("url")))
    last = F.nullif(strip_ws(F.col("lastmod")), F.lit(""))
    return rows.select("crawl_id", "file", strip_ws(F.col("loc")).alias("url"), last.try_cast("timestamp").alias("lastmod")).where("url <> ''")


def with_sitemap(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages with in_sitemap: whether an entry(crawl_id, url) names the address, fragments aside. Only crawls with entries get a value."""
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    listed = entries.select("crawl_id", bare(F.col("url")).alias("_bare")).distinct().withColumn("_listed", F.lit(True))
    known = entries.select("crawl_id").distinct().withColumn("_known", F.lit(True))
    joined = pages.drop("in_sitemap").withColumn("_bare", bare(F.col("url"))).join(listed, ["crawl_id", "_bare"], "left").join(known, "crawl_id", "left")
    return joined.withColumn("in_sitemap", F.coalesce("_listed", F.when(F.col("_known"), False))).drop("_bare", "_listed", "_known")


def child_sitemaps(files: DataFrame) -> DataFrame:
    """(crawl_id, file): further files that index files name."""
    rows = _with_xml(files).select("crawl_id", F.inline(_locations("sitemap")))
    return rows.select("crawl_id", strip_ws(F.col("loc")).alias("file")).where("file <> ''").distinct()


def follow_sitemaps(start: DataFrame, stored: DataFrame, max_level: int | None = None) -> DataFrame:
    """(crawl_id, file, level, body): the files of stored(crawl_id, file, body) that start(crawl_id, file) names or that index files reached so name.

    Level by level to a fixed point, so indexes of indexes of any depth are followed, and each file once, also where
    indexes name each other; level is the smallest. Named files that aren't stored are left out. Each round joins only the files
    that are new in it and is written.
    """
    pending = settle(start.select("crawl_id", "file").distinct())
    seen, out, level = pending, None, 0
    while not pending.isEmpty() and (max_level is None or level <= max_level):
        here = stored.join(pending, ["crawl_id", "file"], "left_semi").select("crawl_id", "file", F.lit(level).alias("level"), "body")
        here = settle(here.dropDuplicates(["crawl_id", "file"]))
        out = here if out is None else out.unionByName(here)
        pending = settle(child_sitemaps(here).join(seen, ["crawl_id", "file"], "left_anti"))
        seen, level = seen.unionByName(pending), level + 1
    return stored.select("crawl_id", "file", F.lit(0).alias("level"), "body").limit(0) if out is None else out


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of the stored files below path, but for those without a byte; what is compressed with gzip is unpacked, bytes that aren't UTF-8 are replaced."""

    def unpacked(batches):
        for batch in batches:
            bodies = []
            for data in batch.column("content").to_pylist():
                if data[:2] == b"\x1f\x8b":
                    whole = zlib.decompressobj(31)
                    data = whole.decompress(data) + whole.flush()
                bodies.append(data.decode("utf-8", "replace").removeprefix("\ufeff"))
            yield pa.record_batch([batch.column("path"), pa.array(bodies, pa.string())], names=["file", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(unpacked, "file string, body string")


def sitemap_summary(files: DataFrame) -> DataFrame:
    """(crawl_id, file, n_urls, bytes, well_formed)."""
    body = F.coalesce("body", F.lit(""))
    closed = F.lower(body).rlike(r"(?s)<(urlset|sitemapindex)\b.*</(urlset|sitemapindex)>\s*$")
    return files.select(
        "crawl_id", "file", F.regexp_count(body, F.lit(r"(?i)<loc>")).alias("n_urls"), F.octet_length(body).alias("bytes"), closed.alias("well_formed")
    )


def llms_facts(files: DataFrame) -> DataFrame:
    """(crawl_id, llms_status, llms_body, has_h1, links) of fetched llms.txt files; bare addresses where there are no Markdown links."""
    marked = F.regexp_extract_all("body", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract_all("body", F.lit(r"(https?://[^\s)>\]]+)"), F.lit(1))
    return files.select(
        "crawl_id", F.col("status").alias("llms_status"), F.col("body").alias("llms_body"), F.col("body").rlike(r"(?m)^#\s+\S").alias("has_h1"), F.when(F.size(marked) > 0, marked).otherwise(bare).alias("links")
    )


def owned(rows: DataFrame, owner: str | Column) -> DataFrame:
    """Rows of one workspace."""
    return rows.where(F.col("owner") == owner)


def export_csv(rows: DataFrame, path: str) -> None:
    """Rows as quoted CSV with a header."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("lineSep", "\n").csv(path)


def export_grid(pages: DataFrame, path: str, columns: list[str] | None = None, selected: DataFrame | None = None) -> None:
    """Rows of the grid, or the selected(crawl_id, url) ones, as spreadsheets read them: quoted CSV, lines end in CR LF, a byte-order mark before the header.

    Written as text, so that the mark can stand first; every file has the header.
    """
    rows = pages if selected is None else pages.join(selected.select("crawl_id", "url").distinct(), ["crawl_id", "url"], "left_semi")
    names = columns or [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct"))]
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = rows.select(F.concat_ws(",", *[quoted(F.col(f"`{n}`").cast("string")) for n in names]).alias("value"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    header = "\ufeff" + ",".join(f'"{n}"' for n in names) + "\r\n"
    first = F.col("_row") == F.shiftleft(F.col("_part").cast("long"), 33)
    lines.select(F.concat(F.when(first, F.lit(header)).otherwise(F.lit("")), "value").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
