"""The page-extraction job: HTML rows to one nested page table and its child tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelens.functions import text as X
from pagelens.functions import urls as U

from .page_parser import area_text, dom_xml, parse_page, text_counts

_LINK = "struct<href:string,anchor:string,rel:array<string>,is_internal:boolean,target:string>"
_IMAGE = (
    "struct<node_id:int,src:string,alt:string,width:int,height:int,loading:string,fetchpriority:string,decorative:boolean,srcset:array<string>>"
)
_ELEMENT = (
    "struct<node_id:int,parent_id:int,last_id:int,nth:int,siblings:int,tag:string,attrs:map<string,string>,text:string,in_head:boolean,"
    "ancestors:array<struct<tag:string,role:string,aria_hidden:boolean>>>"
)
_PARSED = ", ".join(
    [
        "title string, title_count int, meta_desc string, meta_desc_count int, meta_robots string, meta_keywords string, viewport string",
        "generator string, canonical string, canonical_raw string, canonical_count int, canonical_in_head boolean",
        *(f"h{k} array<string>" for k in range(1, 7)),
        f"links array<{_LINK}>, resources array<struct<url:string,kind:string>>, images array<{_IMAGE}>",
        "jsonld array<struct<block:string,types:array<string>,error:string>>, microdata_types array<string>, rdfa_types array<string>",
        "og map<string,string>, twitter map<string,string>, hreflang array<struct<lang:string,href:string>>",
        "prev_url string, next_url string, amp_url string, mobile_alternate string, lang string",
        f"main_text string, full_text string, forms_count int, dom_node_count int, elements array<{_ELEMENT}>",
    ]
)


@cache
def parsed_schema() -> T.StructType:
    """What the parser adds to a page row; needs a session."""
    return T.StructType.fromDDL(_PARSED)



#: Columns a crawl may bring along; those that are missing are added with these values.
RESPONSE = {
    "crawl_id": ("string", lambda: U.registrable_domain(U.host(F.col("url")))),
    "status": ("int", lambda: F.lit(200)),
    "headers": ("map<string,string>", lambda: F.create_map()),
    "redirect_chain": ("array<string>", lambda: F.array()),
    "depth": ("int", lambda: F.lit(None)),
    "ttfb_ms": ("double", lambda: F.lit(None)),
    "in_sitemap": ("boolean", lambda: F.lit(None)),
}


#: Pages an Arrow batch to the parser holds at most, and bytes; so many of them are parsed at a time, or fewer if they have more characters.
BATCH_PAGES = 256
BATCH_BYTES = 4 << 20
PARSED_PAGES = 64
PARSED_CHARS = 1 << 20
#: Counts of a page's text that the parser gives along, for facts that are expressions over them.
_COUNTS = ("_words", "_sentences", "_syllables")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PARSED_PAGES pages, that end where they reach PARSED_CHARS."""
    start = chars = 0
    for i, n in enumerate(pc.utf8_length(batch["html"]).fill_null(0).to_pylist()):
        if i > start and (i - start == PARSED_PAGES or chars + n > PARSED_CHARS):
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += n
    if start < batch.num_rows:
        yield batch.slice(start)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One nested row per row of pages(url, html, and any of RESPONSE): the wide page record.

    One pass of Arrow batches over the rows, without a shuffle. The session's batches are bounded by BATCH_PAGES and
    BATCH_BYTES, and few pages are parsed at a time, so that a task needs no more memory for larger tables. Null html is parsed as empty. Further columns are kept. All other logic is relational and reads only the columns it needs.
    """
    parsed_fields = parsed_schema()
    for name, (kind, default) in RESPONSE.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, default().cast(kind))
    kept = [c for c in pages.columns if c != "html" and c not in parsed_fields.names]
    schema = T.StructType([*(f for f in pages.select(*kept, "html").schema), *parsed_fields, *(T.StructField(c, T.IntegerType()) for c in _COUNTS)])
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_PAGES))
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    arrow = to_arrow_schema(parsed_fields)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in _parts(batch):
                rows = [parse_page(u or "", h or "") for u, h in zip(part["url"].to_pylist(), part["html"].to_pylist(), strict=True)]
                parsed = pa.Table.from_pylist(rows, schema=arrow).combine_chunks().to_batches()[0]
                counts = [pa.array(n, pa.int32()) for n in text_counts([r["main_text"] for r in rows], known)]
                yield pa.RecordBatch.from_arrays([*part.columns, *parsed.columns, *counts], names=[*part.schema.names, *parsed.schema.names, *_COUNTS])

    parsed = pages.select(*kept, "html").mapInArrow(stage, schema)
    return with_text_facts(parsed, [F.col(c) for c in _COUNTS]).drop(*_COUNTS)


def with_text_facts(parsed: DataFrame, counts: list[Column] | None = None) -> DataFrame:
    """Counts, hashes and flags that are expressions over a parsed page; counts are the words, ends of sentences and syllables of main_text where they are known."""
    html_bytes, text_bytes = F.octet_length(F.coalesce("html", F.lit(""))), F.octet_length("full_text")
    x_robots = F.col("headers")["x-robots-tag"]
    noindex_meta = F.coalesce(F.lower("meta_robots").contains("noindex"), F.lit(False))
    noindex_header = F.coalesce(F.lower(x_robots).contains("noindex"), F.lit(False))
    return parsed.withColumns(
        {
            "html": F.coalesce("html", F.lit("")),
            "x_robots": x_robots,
            "word_count": counts[0] if counts else X.word_count(F.col("main_text")),
            "content_hash": F.md5("main_text"),
            "readability": X.flesch_of(*counts) if counts else X.flesch(F.col("main_text")),
            "size": F.length(F.coalesce("html", F.lit(""))),
            "html_bytes": html_bytes,
            "text_bytes": text_bytes,
            "text_to_code": F.when(html_bytes > 0, F.bround(text_bytes / html_bytes, 4)).otherwise(0.0),
            "indexable": ~(noindex_meta | noindex_header),
            "indexability_reason": F.when(noindex_meta, "meta_robots_noindex").when(noindex_header, "x_robots_noindex"),
        }
    )


KEYS = ("crawl_id", "url")


def child(pages: DataFrame, name: str) -> DataFrame:
    """A child table, one row per item, with its place on the page: links, images, resources, jsonld, hreflang, elements.

    The page's address is called page_url.
    """
    rows = pages.select("crawl_id", F.col("url").alias("page_url"), F.posexplode(name).alias("pos", "item"))
    return rows.select("crawl_id", "page_url", "pos", "item.*")


def image_candidates(pages: DataFrame) -> DataFrame:
    """Images with one row for each address, of src and srcset."""
    images = child(pages, "images")
    return images.select("crawl_id", "page_url", "node_id", F.explode(F.array_distinct(F.concat(F.array("src"), "srcset"))).alias("src"), "alt")


def resource_sweep(pages: DataFrame) -> DataFrame:
    """Every resource of a crawl, its kind, and the number of pages that refer to it."""
    return child(pages, "resources").groupBy("crawl_id", "url").agg(F.count_distinct("page_url").alias("ref_count"), F.min("kind").alias("kind"))


def render_diffs(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """(crawl_id, url, element, state) between two extractions of the same pages.

    Scalars are created, deleted or modified; link sets likewise, and duplicated where the sets are
    equal but their numbers differ; structured data by its blocks.
    """
    scalars = ["title", "meta_desc", "canonical", "meta_robots"]
    href = lambda side, internal: F.transform(F.filter(f"{side}.links", lambda x: x["is_internal"] == internal), lambda x: x["href"])
    joined = raw.alias("a").join(rendered.alias("b"), list(KEYS))

    def scalar(c: str) -> Column:
        a, b = F.nullif(F.col(f"a.{c}"), F.lit("")), F.nullif(F.col(f"b.{c}"), F.lit(""))
        return F.when(a.isNull() & b.isNotNull(), "created").when(a.isNotNull() & b.isNull(), "deleted").when(a != b, "modified")

    def sets(a: Column, b: Column) -> Column:
        x, y = F.array_distinct(a), F.array_distinct(b)
        return (
            F.when((F.size(x) == 0) & (F.size(y) > 0), "created")
            .when((F.size(x) > 0) & (F.size(y) == 0), "deleted")
            .when((F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0), "modified")
            .when(F.size(a) != F.size(b), "duplicated")
        )

    blocks = lambda side: F.transform(f"{side}.jsonld", lambda x: x["block"])
    states = [
        *(F.struct(F.lit(c).alias("element"), scalar(c).alias("state")) for c in scalars),
        F.struct(F.lit("internal_links").alias("element"), sets(href("a", True), href("b", True)).alias("state")),
        F.struct(F.lit("external_links").alias("element"), sets(href("a", False), href("b", False)).alias("state")),
        F.struct(F.lit("structured_data").alias("element"), sets(blocks("a"), blocks("b")).alias("state")),
    ]
    return joined.select(*KEYS, F.inline(F.array(*states))).where("state is not null")


def regex_extractors(pages: DataFrame, patterns: dict[str, str], counters: dict[str, str] | None = None) -> DataFrame:
    """(crawl_id, url, name, values): what each pattern's first group (or the whole match) finds in the HTML; counters give the number of matches."""
    found = [
        F.struct(F.lit(n).alias("name"), F.regexp_extract_all("html", F.lit(p if "(" in p else f"({p})"), F.lit(1)).alias("values")) for n, p in patterns.items()
    ]
    counted = [F.struct(F.lit(n).alias("name"), F.array(F.regexp_count("html", F.lit(p)).cast("string")).alias("values")) for n, p in (counters or {}).items()]
    return pages.select(*KEYS, F.inline(F.array(*found, *counted)))


def css_filter(selector: str) -> Column:
    """A simple selector (tag, .class, #id, [attr], [attr=value] and combinations) as a predicate on the elements table."""
    tokens = re.findall(r"^[a-zA-Z][\w-]*|\.[\w-]+|#[\w-]+|\[[^\]]+\]", selector.strip())
    if not tokens or "".join(tokens) != selector.strip().replace("*", ""):
        raise ValueError(f"not a simple selector: {selector}")
    out = F.lit(True)
    attr = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    for t in tokens:
        if t[0] == ".":
            out = out & F.array_contains(F.split(attr("class"), r"\s+"), t[1:])
        elif t[0] == "#":
            out = out & (attr("id") == t[1:])
        elif t[0] == "[":
            name, _, value = t[1:-1].partition("=")
            out = out & (attr(name) == value.strip("\"'") if value else F.map_contains_key("attrs", F.lit(name)))
        else:
            out = out & (F.col("tag") == t.lower())
    return out


def cookie_names(set_cookie: Column) -> Column:
    """Names that a Set-Cookie header sets, without the words of its attributes."""
    names = F.regexp_extract_all(F.coalesce(set_cookie, F.lit("")), F.lit(r"(?:^|[,;\n])\s*([^=;,\s]+)="), F.lit(1))
    words = ["path", "domain", "expires", "max-age", "samesite", "secure", "httponly", "priority"]
    return F.array_distinct(F.filter(names, lambda n: ~F.lower(n).isin(words)))


def is_page_like(content_type: Column) -> Column:
    ct = F.lower(X.strip_ws(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return (ct == "") | ct.rlike(r"^(text/|application/(xhtml|xml|json|ld\+json|rss|atom))") | ct.endswith("+xml")


def is_html_document(content_type: Column, assume_html: bool = True) -> Column:
    ct = F.lower(X.strip_ws(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return F.when(ct == "", F.lit(assume_html)).otherwise(ct.isin("text/html", "application/xhtml+xml"))


def is_pdf(content_type: Column, url: Column) -> Column:
    """PDF by its declared type, or by the address where that says nothing."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    vague = (ct == "") | ct.startswith("application/octet-stream") | ct.startswith("binary/")
    return ct.contains("application/pdf") | (vague & F.lower(F.substring_index(F.coalesce(url, F.lit("")), "?", 1)).endswith(".pdf"))


def with_content_area(pages: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """pages with the text facts taken from a part of the page, where the selectors find one: main_text and what follows from it."""

    @F.pandas_udf(T.StringType())
    def area(html: pd.Series) -> pd.Series:
        return html.map(lambda h: area_text(h or "", list(include), list(exclude)))

    if not include and not exclude:
        return pages
    text = F.coalesce("_area", "main_text")
    return (
        pages.withColumn("_area", area("html"))
        .withColumn("main_text", text)
        .drop("_area")
        .withColumns({"word_count": X.word_count(F.col("main_text")), "content_hash": F.md5("main_text"), "readability": X.flesch(F.col("main_text"))})
    )


def xpath_extractors(pages: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """(crawl_id, url, name, values) of XPath expressions, by Spark's own xpath over the page as well-formed XML below /dom."""

    @F.pandas_udf(T.StringType())
    def xml(html: pd.Series) -> pd.Series:
        return html.map(lambda h: dom_xml(h or ""))

    rows = pages.select(*KEYS, xml("html").alias("_xml"))
    return rows.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.xpath("_xml", F.lit(e)).alias("values")) for n, e in expressions.items()])))


def gated(pages: DataFrame, *, content_hash: bool = True, jsonld: bool = True, types: bool = True) -> DataFrame:
    """pages with what is switched off emptied, as if it hadn't been extracted."""
    off = {}
    if not content_hash:
        off["content_hash"] = F.lit("")
    if not jsonld:
        off["jsonld"] = F.slice("jsonld", 1, 0)
    if not types:
        off |= {c: F.array().cast("array<string>") for c in ("microdata_types", "rdfa_types")}
    return pages.withColumns(off) if off else pages


def readable_text(html: Column, chars: int = 3500) -> Column:
    """What a reader sees without navigation and the like, white space collapsed, its first characters."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|footer|header|aside|form|svg|template)\b.*?</\1\s*>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]+>", " "), r"\s+", " ")), 1, chars)
