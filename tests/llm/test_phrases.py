import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pagelens.llm import phrases as P
from pagelens.llm.queries import QUERIES

KIND = "doc_id long, text string, lang string, phrase string, n long, f long, bucket int, rank int, k int"


def _pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def _counts(rows):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for words in _pieces(text):
            sizes[lang or "und"] += len(words)
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    return counts, sizes


def _plain(rows, least=10, covered=50, top=2000):
    out = []
    counts, sizes = _counts(rows)
    for lang, own in counts.items():
        several = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in several.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in several.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def _texts(seed, n):
    r = random.Random(seed)
    words = ["The", "of", "a", "É", "new", "york", "city", "x", "y", " z", "w9"] + [f"rare{k}" for k in range(400)]
    weights = [30, 25, 20, 8, 9, 9, 8, 5, 5, 3, 3] + [0.1] * 400
    out = []
    for k in range(n):
        text = ""
        for w in r.choices(words, weights, k=r.randint(0, 60)):
            text += (w if w != "new" or r.random() < 0.2 else "new York City") + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! "])
        out.append((text, [None, "en", "und", "fr"][k % 4]))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, "p", 1, 2, 3, 4, 5) for k, (t, lang) in enumerate(rows)], KIND)


def test_against_plain_counts_with_hot_pairs_and_odd_rows(spark):
    rows = _texts(4, 240) + [(None, "en"), ("", None), (" \n\t.", "fr"), ("only", "zz"), ("new york city " * 3000, "en"), ("hot pair " + " hot pair ".join(f"v{k % 40}" for k in range(900)), "en"), ("z" * 300_000 + " z", "en")]
    rows += rows[:5]
    got = sorted(tuple(r) for r in P.collocations(_frame(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == _plain(rows) and len(got) > 100
    few = sorted(tuple(r) for r in P.collocations(_frame(spark, rows), top=5, covered=101).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert few == _plain(rows, covered=101, top=5)
    assert P.collocations(_frame(spark, rows).limit(0)).count() == 0
    counts = {(r.lang, r.phrase): r.f for r in P.phrase_counts(_frame(spark, rows))[0].collect()}
    assert counts == {(lang, " ".join(p)): f for lang, own in _counts(rows)[0].items() for p, f in own.items() if f >= 10}


def test_scores_beyond_64_bits(spark):
    docs = _frame(spark, [("x y. " * 12, "en")])
    row = P.collocations(docs).first()
    assert (row.phrase, row.a, row.l, row.r, row.score) == ("x y", 12, 12, 12, 1_000_000)
    big = spark.sql("select cast(3000000000000 as decimal(19,0)) a, cast(7000000000001 as decimal(19,0)) l")
    assert big.selectExpr("(cast(1000000 as decimal(7,0)) * (a * a)) div (l * l) as s").first().s == 1_000_000 * 3000000000000**2 // 7000000000001**2


def test_quicksort_against_counts():
    r = np.random.default_rng(5)
    for small in (1, 7, 5000):
        columns = [r.zipf(1.6, 3000) % 40 + (k == 0) for k in range(3)]
        weights = r.integers(1, 4, 3000)
        for least in (1, 10):
            got = {}
            for depth, places, sizes in P.equal_partitions(columns, weights, least, small):
                for p, n in zip(places.tolist(), sizes.tolist(), strict=True):
                    key = tuple(int(columns[k][p]) for k in range(depth))
                    assert key not in got
                    got[key] = n
            want = Counter()
            for row, w in zip(zip(*(c.tolist() for c in columns), strict=True), weights.tolist(), strict=True):
                for depth in (1, 2, 3):
                    if all(row[:depth]):
                        want[row[:depth]] += w
            assert got == {p: n for p, n in want.items() if n >= least}


def test_a_long_text_is_spread_over_batches(monkeypatch):
    monkeypatch.setattr(P, "BATCH_WORDS", 50)
    text = " ".join(f"w{k % 7}" + "." * (k % 11 == 0) for k in range(1003))
    got = Counter()
    for batch in P._batches(iter([pa.record_batch([pa.array(["en"]), pa.array([text])], names=["lang", "text"])]), 3):
        names = list(batch.ids)
        assert batch.held <= 50
        for _, codes, own in batch.parts():
            for i in np.flatnonzero(own).tolist():
                suffix = codes[i : i + 3].tolist()
                suffix = suffix[: suffix.index(0)] if 0 in suffix else suffix
                got.update(tuple(names[c].decode() for c in suffix[:k]) for k in range(1, len(suffix) + 1))
    assert got == _counts([(text, "en")])[0]["en"]


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_phrases"](spark, sf).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == _plain(rows)
