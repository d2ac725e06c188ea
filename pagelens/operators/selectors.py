"""CSS selectors over the elements table: compounds as predicates, combinators as joins on the elements' numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells the elements of one page from those of others.
PAGE = ("crawl_id", "page_url")
_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_ATTR = re.compile(rf"\[\s*({_NAME}(?::{_NAME})?)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]\"']+))\s*(i)?\s*)?\]")
_NTH = re.compile(r"\s*(?:(odd)|(even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


class SelectorError(ValueError):
    """A selector that isn't CSS, or uses what isn't supported."""


@dataclass(frozen=True)
class Compound:
    """What one element must be, and how it stands to the one before: '' for the first, else ' ', '>', '+' or '~'."""

    combinator: str
    tests: tuple[tuple, ...] = field(default=())


def _nth(text: str) -> tuple[int, int]:
    m = _NTH.match(text)
    if not m:
        raise SelectorError(f"not a place: {text}")
    if m[1] or m[2]:
        return (2, 1 if m[1] else 0)
    if m[6] is not None:
        return (0, int(m[6]))
    step = {"": 1, "+": 1, "-": -1}.get(m[3], None)
    return (int(m[3]) if step is None else step, int((m[4] or "+") + (m[5] or "0")))


def _compound(text: str, at: int) -> tuple[tuple[tuple, ...], int]:
    tests: list[tuple] = []
    while at < len(text):
        if m := re.compile(rf"(\*|{_NAME})").match(text, at):
            if tests:
                break
            tests.append(("tag", m[1].lower()))
        elif m := re.compile(rf"\.({_NAME})").match(text, at):
            tests.append(("attr", "class", "~=", m[1], False))
        elif m := re.compile(r"#([\w\u0080-\U0010ffff-]+)").match(text, at):
            tests.append(("attr", "id", "=", m[1], False))
        elif m := _ATTR.match(text, at):
            value = next((v for v in m.group(3, 4, 5) if v is not None), None)
            tests.append(("attr", m[1].lower(), m[2] or "", value, bool(m[6])))
        elif m := re.compile(r":(first-child|last-child|only-child|root)(?![\w-])").match(text, at):
            tests += {"first-child": [("nth", "nth", 0, 1)], "last-child": [("nth", "back", 0, 1)], "only-child": [("nth", "nth", 0, 1), ("nth", "back", 0, 1)], "root": [("root",)]}[m[1]]
        elif m := re.compile(r":(nth-child|nth-last-child)\(([^)]*)\)").match(text, at):
            tests.append(("nth", "nth" if m[1] == "nth-child" else "back", *_nth(m[2])))
        elif m := re.compile(r":not\(").match(text, at):
            inner, end = _compound(text, m.end())
            if text[end : end + 1] != ")" or not inner:
                raise SelectorError(f"only one compound in :not(): {text}")
            tests.append(("not", inner))
            at = end + 1
            continue
        else:
            break
        at = m.end()
    return tuple(tests), at


def parse(selector: str) -> list[list[Compound]]:
    """A selector list as chains of compounds. Raises SelectorError for what isn't supported."""
    chains: list[list[Compound]] = []
    chain: list[Compound] = []
    text, at, combinator = selector.strip(), 0, ""
    while True:
        tests, end = _compound(text, at)
        if end == at:
            raise SelectorError(f"not a selector: {selector!r} at {at}")
        chain.append(Compound(combinator, tests))
        if end == len(text):
            return [*chains, chain]
        m = re.compile(r"\s*([,>+~])\s*|\s+").match(text, end)
        if not m or m.end() == len(text):
            raise SelectorError(f"not a selector: {selector!r} at {end}")
        at, combinator = m.end(), m[1] or " "
        if combinator == ",":
            chains.append(chain)
            chain, combinator = [], ""


def _place(c: Column, step: int, offset: int) -> Column:
    """Whether c = step * k + offset for a k of 0 or more."""
    if step == 0:
        return c == offset
    return (F.pmod(c - offset, F.lit(abs(step))) == 0) & ((c >= offset) if step > 0 else (c <= offset))


def predicate(tests: tuple[tuple, ...]) -> Column:
    """A compound as a predicate on rows of elements."""
    out = F.lit(True)
    for test in tests:
        if test[0] == "tag":
            out = out if test[1] == "*" else out & (F.col("tag") == test[1])
        elif test[0] == "nth":
            out = out & _place(F.col("nth") if test[1] == "nth" else F.col("siblings") - F.col("nth") + 1, test[2], test[3])
        elif test[0] == "root":
            out = out & F.col("parent_id").isNull()
        elif test[0] == "not":
            out = out & ~predicate(test[1])
        else:
            _, name, how, value, any_case = test
            has, got = F.map_contains_key("attrs", F.lit(name)), F.coalesce(F.col("attrs")[name], F.lit(""))
            if any_case:
                got, value = F.lower(got), value.lower()
            if how == "~=":
                one = F.array_contains(F.split(got, r"[ \t\n\r\f]+"), value) if value and not re.search(r"\s", value) else F.lit(False)
            elif how == "|=":
                one = (got == value) | got.startswith(value + "-")
            elif how in ("^=", "$=", "*="):
                one = {"^=": got.startswith, "$=": got.endswith, "*=": got.contains}[how](value) if value else F.lit(False)
            else:
                one = got == value if how else F.lit(True)
            out = out & has & one
    return F.coalesce(out, F.lit(False))


def _within(rows: DataFrame, found: DataFrame, combinator: str, page: tuple[str, ...]) -> DataFrame:
    """Those of rows that stand to one of found as the combinator says."""
    up = F.coalesce("parent_id", F.lit(-1))
    if combinator == ">":
        return rows.join(found.select(*page, F.col("node_id").alias("parent_id")), [*page, "parent_id"], "left_semi")
    if combinator in "+~":
        # of siblings the first one found is what the others come after
        before = found.select(*page, up.alias("_up"), F.col("nth").alias("_nth"))
        if combinator == "+":
            keyed = rows.withColumns({"_up": up, "_nth": F.col("nth") - 1})
            return keyed.join(before, [*page, "_up", "_nth"], "left_semi").drop("_up", "_nth")
        first = before.groupBy(*page, "_up").agg(F.min("_nth").alias("_nth"))
        return rows.withColumn("_up", up).join(first, [*page, "_up"]).where("nth > _nth").drop("_up", "_nth")
    spans = found.select(*(F.col(c).alias(f"_{c}") for c in page), F.col("node_id").alias("_first"), F.col("last_id").alias("_last"))
    inside = (F.col("node_id") > F.col("_first")) & (F.col("node_id") <= F.col("_last"))
    for c in page:
        inside = inside & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(spans, inside, "left_semi")


def select(elements: DataFrame, selector: str, page: tuple[str, ...] = PAGE) -> DataFrame:
    """The rows of elements(page.., node_id, parent_id, last_id, nth, siblings, tag, attrs, ..) that a CSS selector fits, each once.

    Tags, *, .class, #id, attributes with = ~= |= ^= $= *= (and i), :first-child, :last-child, :only-child, :nth-child(),
    :nth-last-child(), :root, :not() of a compound, the four combinators and lists. A compound filters the rows;
    each combinator is a semi-join within the page: on the parent, on a sibling's number, or for descendants on the
    interval of numbers below the ancestor, as elements are numbered in page order. Narrow columns are joined, and no tree is
    walked. Elements of a page stay together: a page is what the joins' keys bound. No rows give no rows.
    """
    narrow = [*page, "node_id", "parent_id", "last_id", "nth"]
    chosen = None
    for chain in parse(selector):
        found = None
        for compound in chain:
            rows = elements.where(predicate(compound.tests)).select(*narrow)
            found = rows if found is None else _within(rows, found, compound.combinator, page)
        chosen = found if chosen is None else chosen.unionByName(found)
    if len(parse(selector)) == 1 and len(parse(selector)[0]) == 1:
        return elements.where(predicate(parse(selector)[0][0].tests))
    return elements.join(chosen.select(*page, "node_id").distinct(), [*page, "node_id"], "left_semi").select(elements.columns)


def css_extractors(elements: DataFrame, rules: dict[str, str | tuple[str, str]], page: tuple[str, ...] = PAGE) -> DataFrame:
    """(page.., name, values) for rules {name: selector or (selector, attribute)}: in page order what the attribute or the text of the fitting elements says, empty ones left out.

    One row for each page and name that has a value. The text of elements that only hold others (div, section and the
    like) isn't in the table; ask for the elements inside them.
    """
    out = None
    for name, rule in rules.items():
        selector, attr = (rule, None) if isinstance(rule, str) else rule
        value = F.trim("text") if attr is None else F.col("attrs")[attr]
        rows = select(elements, selector, page).select(*page, "node_id", value.alias("v")).where("v <> ''")
        found = rows.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "v"))), lambda x: x["v"]).alias("values"))
        found = found.select(*page, F.lit(name).alias("name"), "values")
        out = found if out is None else out.unionByName(found)
    return out
