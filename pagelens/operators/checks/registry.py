"""Registry of page checks and the projection that runs them all in one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = Callable[[], Column]

#: Inputs of checks beside the extracted page; pages that lack them get nulls, and such checks stay silent.
INPUTS = {
    "inlink_count": "int",
    "outlink_count": "int",
    "lcp_s": "double",
    "inp_ms": "double",
    "cls": "double",
    "render_ms": "double",
    "render_diffs": "map<string,string>",
    "raw_text": "string",
    "rendered_text": "string",
    "raw_hrefs": "array<string>",
    "rendered_hrefs": "array<string>",
    "rendered_facts": "struct<title:string,meta_desc:string,meta_robots:string,canonical:string>",
    "mobile": "struct<smallTapTargets:int,contentWiderThanViewport:boolean,smallFonts:int,mobile_text:string,hasInterstitial:boolean,blocked_resources:array<string>>",
    "agentic": "struct<js_errors:array<string>,post_load_cls:double>",
    "axe_violations": "array<string>",
    "lcp_src": "string",
}


@dataclass(frozen=True)
class CheckDef:
    """A predicate over a page row, with what is reported where it holds.

    origin is "reference" for rules of the audited catalogue that act on pages, and "catalogue" for
    those the catalogue only describes.
    """

    check_id: str
    title: str
    severity: str
    tier: str
    rule: Rule
    evidence: Rule | None = None
    severity_rule: Rule | None = None
    origin: str = "reference"


CHECKS: dict[str, CheckDef] = {}


def register_check(check: CheckDef) -> CheckDef:
    """Adds a check; the last one of an id counts."""
    CHECKS[check.check_id] = check
    return check


def check(check_id: str, title: str, severity: str, tier: str, rule: Rule, evidence: Rule | None = None, severity_rule: Rule | None = None, origin: str = "reference") -> None:
    register_check(CheckDef(check_id, title, severity, tier, rule, evidence, severity_rule, origin))


def catalogue(spark: SparkSession, checks: Iterable[CheckDef] | None = None) -> DataFrame:
    """(check_id, title, severity, tier, origin), one row per check."""
    rows = [(c.check_id, c.title, c.severity, c.tier, c.origin) for c in (checks or CHECKS.values())]
    return spark.createDataFrame(rows, "check_id string, title string, severity string, tier string, origin string")


def reads(check: CheckDef, *names: str) -> bool:
    """Whether a check's expressions name one of these columns."""
    return any(n in str(e()) for e in (check.rule, check.evidence, check.severity_rule) if e for n in names)


def with_inputs(pages: DataFrame) -> DataFrame:
    """pages with every input a check may read."""
    missing = {n: F.lit(None).cast(t) for n, t in INPUTS.items() if n not in pages.columns}
    return pages.withColumns(missing) if missing else pages


def page_findings(pages: DataFrame, checks: Iterable[CheckDef] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(crawl_id, url, keep.., check_id, severity, tier, evidence) of extracted pages; keep are further columns of theirs.

    All predicates stand in one projection, so a single scan serves every check, without a shuffle and
    without Python; it works on a stream as well. A predicate that is null doesn't fire. The projection is compiled, and what
    several checks read of a page is worked out once; inside the generator, or below a lambda, it would be interpreted.
    """
    parts = []
    for c in checks or CHECKS.values():
        severity = c.severity_rule() if c.severity_rule else F.lit(c.severity)
        evidence = F.to_json(c.evidence()) if c.evidence else F.lit(None).cast("string")
        parts.append(
            F.when(
                c.rule(),
                F.struct(F.lit(c.check_id).alias("check_id"), severity.alias("severity"), F.lit(c.tier).alias("tier"), evidence.alias("evidence")),
            )
        )
    rows = with_inputs(pages).select("crawl_id", "url", *keep, F.array(*parts).alias("_found"))
    # an array without checks gives a row of nulls, like a check that doesn't fire; the inner form would have all checks evaluated once more, by a filter on the size
    return rows.select("crawl_id", "url", *keep, F.inline_outer("_found")).where("check_id is not null")
