import hashlib
import random
import zlib

import numpy as np

from pagelens.llm import runs as R
from pagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plain(words, least=6, times=4):
    """Every period, every stretch of equal words one period apart."""
    out = []
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.array([names[w] for w in words])
    for q in range(1, len(words) // times + 1):
        differs = np.flatnonzero(np.concatenate([[True], codes[:-q] != codes[q:], [True]]))
        for start, end in zip(differs.tolist(), (differs[1:] - 1).tolist(), strict=False):
            length = end - start + q
            if end > start and length >= max(least, times * q) and not any((codes[start : start + length - p] == codes[start + p : start + length]).all() for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_lyndon_lengths_against_smaller_suffixes():
    r = random.Random(1)
    for _ in range(400):
        c = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 40))]
        assert R.lyndon_lengths(c) == [next((j for j in range(i + 1, len(c)) if c[j:] < c[i:]), len(c)) - i for i in range(len(c))]


def test_runs_against_every_period():
    r = random.Random(2)
    for k in range(500):
        base = [r.randrange(1 + k % 4) for _ in range(r.randint(1, 7))]
        c = [r.randrange(3) for _ in range(r.randint(0, 12))] + (base * 14)[: r.randint(4, 60)] + base[:3] + [r.randrange(3) for _ in range(8)]
        for times in (3, 4, 5):
            want = _plain(c, 6, times)
            assert sorted(R.word_runs(np.array(c), 6, times), key=lambda x: (x[0], x[2])) == want
            assert R.text_runs([b"%d" % x for x in c], 6, times) == want
    nested = (([1, 2] * 5 + [3]) * 5 + [4]) * 4
    assert R.text_runs([b"%d" % x for x in nested]) == _plain(nested)


def test_long_texts_take_linear_time():
    words = [b"w%d" % (i % 5000) for i in range(200_000)]
    assert R.text_runs(words) == [(0, 200_000, 5000)]
    assert R.text_runs([b"a"] * 300_000) == [(0, 300_000, 1)]


def test_query_against_plain_python(spark):
    got = {r.doc_id: r for r in QUERIES["op13_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = _plain(words)
        row = got[d.doc_id]
        best = min(((-length, s, q) for s, length, q in found), default=None)
        assert row.n_runs == len(found)
        assert (row.start, row.length, row.period) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert row.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(_collapsed(words, found).encode()).hexdigest()
        some += bool(found)
    assert some >= 5


def test_odd_rows(spark):
    kind = "doc_id long, text string, id string, runs int, n_words int, collapsed string"
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y " * 4), (5, "é z " * 6), (6, "a " * 5), (7, "long " * 200_000)]
    rows = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in texts], kind)
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in R.find_runs(rows).collect()), key=repr)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"), (0, 8, [(0, 8, 2)], "x y"), (5, 6, [(0, 6, 1)], "é z"), (6, 5, [], "a a a a a"), (7, 200_000, [(0, 200_000, 1)], "long")]
    assert got == sorted(want, key=repr)
    assert R.find_runs(rows.limit(0)).count() == 0 and R.periodic_tails(rows.limit(0)).count() == 0
    kept = {r.doc_id: r.text for r in R.periodic_tails(rows).collect()}
    assert kept[1] is None and kept[2] == "" and kept[None] == "x y " * 4
    assert [(r.doc_id, len(r.runs)) for r in R.find_runs(spark.createDataFrame([("k", "b " * 6)], "name string, body string"), "name", "body").withColumnRenamed("name", "doc_id").collect()] == [("k", 1)]
