"""Named filters of the page grid, their counts, sorting and rules."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as X


def _blank(c: str) -> Column:
    return F.coalesce(X.strip_ws(F.col(c)), F.lit("")) == ""


def facets() -> dict[tuple[str, str], Column]:
    """Predicates by (view, name). Those for duplicates read the flags that with_duplicate_flags adds."""
    s, i = F.col("status"), F.col("indexable")
    tl, dl = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("meta_desc", F.lit("")))
    robots = F.lower(F.coalesce("meta_robots", F.lit("")))
    return {
        ("internal", "all"): F.lit(True),
        ("internal", "indexable"): i,
        ("internal", "non_indexable"): ~i,
        ("internal", "orphan"): F.col("inlink_count") == 0,
        ("internal", "3xx"): s.between(300, 399),
        ("internal", "4xx"): s.between(400, 499),
        ("internal", "5xx"): s >= 500,
        ("response", "2xx"): s.between(200, 299),
        ("response", "3xx"): s.between(300, 399),
        ("response", "4xx"): s.between(400, 499),
        ("response", "5xx"): s >= 500,
        ("response", "none"): s.isNull() | (s == 0),
        ("titles", "missing"): _blank("title"),
        ("titles", "duplicate"): F.col("title_shared"),
        ("titles", "over_60"): tl > 60,
        ("titles", "under_30"): (tl > 0) & (tl < 30),
        ("descriptions", "missing"): _blank("meta_desc"),
        ("descriptions", "duplicate"): F.col("desc_shared"),
        ("descriptions", "under_120"): (dl > 0) & (dl < 120),
        ("descriptions", "120_and_more"): dl >= 120,
        ("h1", "missing"): F.size("h1") == 0,
        ("h1", "multiple"): F.size("h1") > 1,
        ("h1", "duplicate"): F.col("h1_shared"),
        ("directives", "noindex"): robots.contains("noindex"),
        ("directives", "nofollow"): robots.contains("nofollow"),
        ("directives", "canonicalised"): F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url")),
        ("canonicals", "missing"): _blank("canonical"),
        ("canonicals", "self"): F.col("canonical") == F.col("url"),
        ("canonicals", "canonicalised"): F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url")),
        ("content", "thin"): F.col("word_count") < 200,
        ("content", "hard_to_read"): F.col("readability") < 30,
        ("content", "has_forms"): F.col("forms_count") > 0,
        ("analytics", "has_data"): F.col("sessions").isNotNull(),
        ("analytics", "no_data"): F.col("sessions").isNull(),
        ("analytics", "sessions"): F.col("sessions") > 0,
        ("analytics", "conversions"): F.col("conversions") > 0,
        ("spelling", "issues"): F.col("spelling_issues") > 0,
        ("spelling", "clean"): F.col("spelling_issues") == 0,
        ("pdf", "all"): F.lower("url").rlike(r"\.pdf(\?|$)"),
        ("pdf", "non_indexable"): F.lower("url").rlike(r"\.pdf(\?|$)") & ~i,
    }


OPTIONAL = {"sessions": "long", "conversions": "long", "spelling_issues": "int"}


def with_duplicate_flags(pages: DataFrame) -> DataFrame:
    """pages with title_shared, desc_shared and h1_shared: values counted by group and joined back, so that common ones don't gather in a window."""
    out = pages.withColumns({n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in pages.columns})
    for flag, key in (("title_shared", F.lower(X.strip_ws(F.col("title")))), ("desc_shared", F.lower(X.strip_ws(F.col("meta_desc")))), ("h1_shared", F.lower(F.array_join("h1", " ")))):
        keyed = out.withColumn("_key", F.nullif(key, F.lit("")))
        shared = keyed.where("_key is not null").groupBy("crawl_id", "_key").agg((F.count("*") > 1).alias(flag)).where(flag)
        out = keyed.join(shared, ["crawl_id", "_key"], "left").fillna(False, [flag]).drop("_key")
    return out


def facet_counts(pages: DataFrame) -> DataFrame:
    """(crawl_id, view, name, pages): all facets in one aggregation."""
    items = list(facets().items())
    counts = with_duplicate_flags(pages).groupBy("crawl_id").agg(*[F.count_if(p).alias(f"c{k}") for k, (_, p) in enumerate(items)])
    rows = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(n).alias("name"), F.col(f"c{k}").alias("pages")) for k, ((v, n), _) in enumerate(items)])
    return counts.select("crawl_id", F.inline(rows))


def rule(column: str, op: str, value: str | float) -> Column:
    """A grid rule: equals, contains, starts, greater or less; texts regardless of case."""
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    if op in ("greater", "less"):
        number = F.col(column).try_cast("double")
        return F.coalesce(number > float(value) if op == "greater" else number < float(value), F.lit(False))
    return {"equals": text == str(value).lower(), "contains": text.contains(str(value).lower()), "starts": text.startswith(str(value).lower())}[op]


def search(columns: Sequence[str], words: str) -> Column:
    """Rows with the words in any of the columns, regardless of case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c).cast("string")).contains(words.lower()), F.lit(False))
    return out


def hub_filter(issues: DataFrame, category: str = "all", severities: Collection[str] = (), words: str = "") -> DataFrame:
    """Issues as the hub lists them: of one category (or `all`), of any of the severities (all without any), and with the words in title, why_it_matters, domain or check_id, regardless of case."""
    out = issues if category == "all" else issues.where(F.col("category") == category)
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    words = words.strip()
    return out.where(search([c for c in ("title", "why_it_matters", "domain", "check_id") if c in issues.columns], words)) if words else out


def grid_sort(pages: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """In order of a column, texts regardless of case, null as empty."""
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    key = F.col(column) if dict(pages.dtypes)[column] not in ("string", "boolean") else text
    return pages.orderBy(key.desc() if descending else key.asc(), "url")


def grid_columns(pages: DataFrame) -> DataFrame:
    """Lengths, joined headings and hop counts beside the page columns."""
    return pages.withColumns(
        {
            "title_length": F.length(F.coalesce("title", F.lit(""))),
            "desc_length": F.length(F.coalesce("meta_desc", F.lit(""))),
            "h1_text": F.array_join("h1", " | "),
            "h2_text": F.array_join("h2", " | "),
            "hops": F.size("redirect_chain"),
        }
    )


def custom_columns(pages: DataFrame, custom: DataFrame, names: Sequence[str]) -> DataFrame:
    """pages with one column for each extractor name of custom(crawl_id, url, name, values), values joined."""
    wide = custom.groupBy("crawl_id", "url").pivot("name", list(names)).agg(F.array_join(F.first("values"), ", "))
    return pages.join(wide, ["crawl_id", "url"], "left")


def in_scope(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any of the include patterns (if there are some) and none of the exclude ones."""
    out = F.lit(True)
    if include:
        out = url.rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        out = out & ~url.rlike("|".join(f"(?:{p})" for p in exclude))
    return out


def within_limits(url: Column, max_length: int | None = None, max_params: int | None = None, max_depth: int | None = None) -> Column:
    from pagelens.functions import urls as U

    out = F.lit(True)
    if max_length is not None:
        out = out & (F.length(url) <= max_length)
    if max_params is not None:
        out = out & (F.size(F.filter(F.split(U.query(url), "&"), lambda p: p != "")) <= max_params)
    if max_depth is not None:
        out = out & (F.size(F.filter(F.split(U.path(url), "/"), lambda s: s != "")) <= max_depth)
    return out


def without_hidden(pages: DataFrame, noindex: bool = False, canonicalised: bool = False) -> DataFrame:
    """Pages as stored when pages with noindex, or with another canonical address, are to be hidden; the link graph keeps them."""
    out = pages
    if noindex:
        out = out.where(~F.coalesce(F.lower(F.coalesce("meta_robots", F.lit(""))).contains("noindex") | F.lower(F.coalesce("x_robots", F.lit(""))).contains("noindex"), F.lit(False)))
    if canonicalised:
        out = out.where(F.coalesce(F.nullif("canonical", F.lit("")) == F.col("url"), F.lit(True)))
    return out


def focus(pages: DataFrame, findings: DataFrame, check_id: str) -> DataFrame:
    """The pages that a check fired on."""
    return pages.join(findings.where(F.col("check_id") == check_id).select("crawl_id", "url").distinct(), ["crawl_id", "url"], "left_semi")


def cap_per(pages: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key: per-depth and per-host caps of a crawl. Spark keeps n a key before the shuffle."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return pages.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n).drop("_place")


def on_indexable_pages(issue_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings of checks that concern at least one indexable page of their crawl."""
    good = pages.where("indexable").select("crawl_id", "url")
    checks = issue_rows.join(good, ["crawl_id", "url"], "left_semi").select("crawl_id", "check_id").distinct()
    return issue_rows.join(checks, ["crawl_id", "check_id"], "left_semi")
