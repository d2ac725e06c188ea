"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, texts

#: Kinds whose spans are all returned, and kinds that must reach LEAST_SCORE; spans are listed in this order.
BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "national_id", "local_phone")
LEAST_SCORE = 0.7
#: Characters before and after a span in which words are looked for, and what such a word adds.
BEFORE, AFTER, NEARBY = 48, 16, 0.35

_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NATIONAL_ID = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,5}(?![0-9A-Za-z]|[.-][0-9])")

#: Signs of an IBAN by country (ISO 13616).
IBAN_SIGNS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

#: Words that make a kind likelier.
WORDS = {
    "email": r"e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": r"ip|address|host|server|adresse|dirección",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|tel|telephone|mobile|call|fax|telefon|téléphone|teléfono|handy|móvil",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "national_id": r"ssn|social security|national id|tax id|taxpayer",
    "local_phone": r"phone|tel|telephone|mobile|call|fax|telefon|téléphone|teléfono|handy|móvil",
}
_NEAR = {kind: re.compile(rf"(?<!\w)(?:{words})(?!\w)") for kind, words in WORDS.items()}
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.5, "local_phone": 0.4}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum ends in 0."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[Span]:
    """From the sign @ outwards, so that long runs of letters are looked at once."""
    last = 0
    for m in _EMAIL_REST.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield Span("email", start, last)


def _small(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield Span("ip", m.start(), m.end())


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield Span("card", m.start(), m.end())


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield Span("phone", m.start(), m.end())


def _ibans(text: str) -> Iterator[Span]:
    at = 0
    while m := _IBAN.search(text, at):
        left, end, at = IBAN_SIGNS.get(m[0][:2], 0), m.start(), m.start() + 4
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        if left == 0 and end - m.start() >= 15 and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
            at = end
            yield Span("iban", m.start(), end)


def _local_phones(text: str) -> Iterator[Span]:
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m[0])) <= 12:
            yield Span("local_phone", m.start(), m.end())


def _score(text: str, span: Span) -> float:
    around = text[max(0, span.start - BEFORE) : span.start].lower() + "\n" + text[span.end : span.end + AFTER].lower()
    return min(1.0, round(_SCORE[span.kind] + NEARBY * bool(_NEAR[span.kind].search(around)), 2))


def spans_of(text: str, least_score: float = LEAST_SCORE) -> list[tuple[Span, float]]:
    """The spans of one text with their scores, by kind, then start.

    Spans of BASE are all there. One of a further kind must reach least_score and overlap neither a span of BASE nor
    one of a kind before its own.
    """
    found = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return [(s, _score(text, s)) for s in found]
    found += [*_ips(text), *_cards(text)]
    if "+" in text:
        found += _phones(text)
    out = [(s, _score(text, s)) for s in found]
    more = [*_ibans(text), *(Span("national_id", m.start(), m.end()) for m in _NATIONAL_ID.finditer(text)), *_local_phones(text)]
    scored = [(s, score) for s in more if (score := _score(text, s)) >= least_score]
    if scored:
        taken = bytearray(len(text))
        for s in found:
            taken[s.start : s.end] = b"\1" * (s.end - s.start)
        for s, score in scored:
            if 1 not in taken[s.start : s.end]:
                taken[s.start : s.end] = b"\1" * (s.end - s.start)
                out.append((s, score))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, spans) per row of docs; spans is an array of structs (kind, start, end, score, value), by kind in the order of BASE + FURTHER, then start.

    Places are code points of the text, the end exclusive. Kinds of BASE: email addresses; ip addresses whose parts
    are 255 at most; cards of 13 to 19 digits that pass Luhn; phone numbers after a plus sign with 9 to 15 digits. Leftmost
    spans that don't overlap within their kind, and what fails its check is left out without another try; all others are
    returned whatever their score. Of FURTHER: IBANs of their country's length that pass mod 97; national ids; phone
    numbers without a plus sign. Their scores must reach least_score; the last two only do with a word of WORDS nearby.

    One pass without a shuffle, linear in the text. Null and empty texts have no spans; repeated rows are looked at
    each by itself; null ids stay; further columns are left out; an empty table gives no rows.
    """

    def stage(batches):
        for batch in batches:
            out = [
                [{"kind": s.kind, "start": s.start, "end": s.end, "score": score, "value": t[s.start : s.end]} for s, score in spans_of(t, least_score)]
                for t in texts(batch)
            ]
            yield pa.record_batch([batch.column("id"), pa.array(out, _SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = map_batches(rows, stage, f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double,value:string>>")
    return found.withColumnRenamed("id", doc_id)


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The spans of the kinds."""
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, text) per row of docs, with each stretch of overlapping spans replaced by the first one's kind in angle brackets; null texts become empty."""

    def stage(batches):
        for batch in batches:
            out = []
            for t in texts(batch):
                parts, last = [], 0
                for s in sorted((s for s, _ in spans_of(t, least_score)), key=lambda s: (s.start, -s.end)):
                    if s.start >= last:
                        parts += [t[last : s.start], f"<{s.kind}>"]
                    last = max(last, s.end)
                out.append("".join([*parts, t[last:]]))
            yield pa.record_batch([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, stage, f"id {kind}, text string").toDF(doc_id, text)
