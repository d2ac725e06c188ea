import hashlib
import random
import re

from pagelens.llm import pii as P
from pagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _plain(text):
    """The four kinds by their patterns, as they are written."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for kind, pattern, good in (
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and _luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(3)
    signs = ["a", "@", ".", "-", "+", "1", "2", "55", " ", "(", ")", "9", "é", "b.c", "@x.y", "\n", "0", "١"]
    more = ["", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "call 555-123-4567", "+1 (743) 555-3824", "IBAN DE89 3704 0044 0532 0130 00 UND"]
    for _ in range(8000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 40))) + r.choice(more)
        assert [tuple(s) for s, _ in P.spans_of(text) if s.kind in P.BASE] == _plain(text)


def test_checksums_and_words_nearby():
    text = "IBAN DE89 3704 0044 0532 0130 00 UND GB82WEST12345698765432, DE88370400440532013000; call 555-123-4567 now. SSN 123-45-6789. Size 555-222-1234 and 123-45-6780 of parts"
    far = " plain words go on here, one after the other, until nothing is near any more. "
    found = {(s.kind, text[s.start : s.end]) for s, _ in P.spans_of(text)}
    assert found >= {("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("local_phone", "555-123-4567"), ("national_id", "123-45-6789")}
    assert not any("DE88" in v for _, v in found)
    assert P.spans_of(far + "555-222-1234 or 123-45-6780" + far) == []
    assert [(s.kind, score) for s, score in P.spans_of("4111 1111 1111 1111")] == [("card", 0.8)]
    assert [(s.kind, score) for s, score in P.spans_of("my card 4111 1111 1111 1111")] == [("card", 1.0)]
    assert all(P.luhn(d) == _luhn(d) for d in map(str, range(10**12, 10**12 + 500)))


def test_further_spans_overlap_nothing():
    text = "tel +1 555-123-4567, bank FR76 3000 6000 0112 3456 7890 189 and tel 123-45-6789-0"
    spans = sorted((s.start, s.end) for s, _ in P.spans_of(text) if s.kind != "card")
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert {s.kind for s, _ in P.spans_of(text)} >= {"phone", "iban"}


def test_long_texts_take_linear_time():
    for part in ("x", "1", "+1(", "a@", "1 ", "AB12A1 ", "12-34-", "%"):
        P.spans_of(part * (1_000_000 // len(part)))


def test_query_against_the_patterns(spark):
    got = {r.doc_id: r for r in QUERIES["op11_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    kinds = set()
    for d in docs:
        want = _plain(d.text or "")
        row = got[d.doc_id]
        counts = [sum(k == kind for k, _, _ in want) for kind in P.BASE]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.spans == listed or row.spans.startswith(listed + ",") or not listed
        kinds |= {k for k, _, _ in want}
    assert kinds >= {"email", "ip", "phone"}


def test_odd_rows(spark):
    kind = "doc_id long, text string, id string, spans int, kind string"
    texts = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "10.0.0.1 " * 3), (4, "é" * 5 + " a@b.co " + "x" * 500_000)]
    rows = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], kind)
    got = sorted((r.doc_id or 0, [(s.kind, s.start, s.end, s.value) for s in r.spans]) for r in P.find_pii(rows).collect())
    mail = ("email", 0, 6, "a@b.co")
    assert got == [(0, [("ip", k, k + 8, "10.0.0.1") for k in (0, 9, 18)]), (1, []), (2, []), (3, [mail]), (3, [mail]), (4, [("email", 6, 12, "a@b.co")])]
    assert P.find_pii(rows.limit(0)).count() == 0
    assert sorted(r.text for r in P.redact(rows).collect())[:3] == ["", "", "<email>"]
    assert P.redact(rows.limit(0)).count() == 0
