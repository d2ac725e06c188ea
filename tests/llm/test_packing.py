import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagelens.llm import packing as P
from pagelens.llm.queries import QUERIES
from pagelens.llm.word_bpe import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(slow, spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["Don't it's WE'LL", "a\x1cb\x85c\xa0d", "ÀÉÎ ΣΑΣ İ ǅ ŉ ﬁ ß ſ", "<|endoftext|> x", "日本語 テスト", "é x", "...!? $$$ 12345", "\x01\x02 a\x01b", "", " \n", "'s't x's", "aaaaa hhhh"]
    encode = encoder(PATH)
    for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode.encode(t) == np.array(e.ids, "<u4").tobytes()


def test_plan_is_the_best(spark):
    rng = np.random.default_rng(0)
    for _ in range(60):
        places = np.unique(rng.integers(1, 40, 9))
        cost = rng.integers(0, 9, len(places))
        window = 14
        places, cost = np.append(places, 40), np.append(cost, 0)
        if np.diff(places, prepend=0).max() > window:
            continue
        best = np.inf
        for k in range(len(places)):
            for chosen in itertools.combinations(range(len(places) - 1), k):
                ends = [*places[list(chosen)], 40]
                lengths = np.diff(ends, prepend=0)
                if lengths.max() <= window:
                    best = min(best, (window - lengths).sum() + cost[list(chosen)].sum())
        got = P.plan_windows(places, cost, window)
        assert got[-1] == 40 and np.diff(got, prepend=0).max() <= window
        assert (window - np.diff(got, prepend=0)).sum() + sum(cost[list(places).index(g)] for g in got) == best


def _check(rows, ids_of):
    spans, windows = {}, {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, pieces in spans.items():
        at = 0
        for start, length, crc in sorted(pieces):
            assert start == at and zlib.crc32(ids_of[doc][start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids_of[doc])
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= P.WINDOW
        padding += P.WINDOW - at
    return padding / (len(windows) * P.WINDOW)


def test_query(spark, slow):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs}
    rows = QUERIES["op3_packing"](spark, SF).collect()
    assert {r.doc_id for r in rows} == ids.keys() and all(r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert _check(rows, ids) < 0.03


def test_odd_rows(spark, slow):
    text = "word " * 9000  # no sentence ends
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (None, "a b.", "x"), (4, "One. Two! Three?", "x")]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1), PATH).collect()
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert len(r.ids) == 4 * r.length
    assert lengths == {1: 9001, 2: 1, 3: 1, None: 4, 4: 7}
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    twice = P.pack(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string").coalesce(1), PATH).collect()
    assert sum(r.length for r in twice) == 6


def test_blocks_are_joined(spark, slow):
    docs = [(i, " ".join(f"w{i} x{j}." for j in range(700))) for i in range(250)]
    ids = {i: np.array([*slow.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    from pyspark.sql import functions as F

    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert sum(map(len, ids.values())) > 2 * P.BLOCK
    assert _check(rows, ids) < 0.02
