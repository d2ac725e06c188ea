import random

import public_tokenizers

from pagelens.llm import token_counts as T
from pagelens.llm.queries import QUERIES
from pagelens.llm.word_bpe import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def _edited(text, edits):
    for a, b, r in edits:
        a = min(max(0, a), len(text))
        text = text[:a] + r + text[min(max(a, b), len(text)) :]
    return text


def test_any_edits_count_as_a_whole_encoding(spark):
    encode, r = encoder(PATH), random.Random(5)
    texts = [x.text or "" for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + ["", "a", "  ", " a b "]
    for text in texts:
        tree = T.SegmentTree(text, encode)
        for _ in range(8):
            a = r.randint(0, len(text) + 3)
            b, new = a + r.choice([0, 0, 1, 5, 60, 900]), r.choice(["", "x", " ", "new words here ", "\n\n", "é" * 3, "z" * 700, "w " * 1500])
            tree.edit(a, b, new)
            text = _edited(text, [(a, b, new)])
            assert tree.text == text and tree.chars == len(text)
            assert tree.tokens == len(encode.encode(text)) // 4


def test_edits_encode_little():
    tree = T.SegmentTree("some words here. " * 20000, encoder(PATH))
    before = tree.encoded
    tree.edit(100_000, 100_005, "other")
    assert tree.encoded - before < 4 * T.LEAF


def test_query_and_odd_rows(spark):
    encode = encoder(PATH)
    docs = T.derived_edits(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "text", "edits").collect()
    got = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    for d in docs:
        text = _edited(d.text or "", [(e.start, e.end, e.replacement) for e in d.edits])
        assert got[d.doc_id].tokens == len(encode.encode(d.text or "")) // 4
        assert got[d.doc_id].edited_tokens == len(encode.encode(text)) // 4 and got[d.doc_id].chars == len(text)
    kind = "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>, tokens string"
    rows = [(None, None, None, "x"), (1, "", [(0, 0, "a b")], "x"), (2, "a", [None, (None, None, None)], None), (2, "a", [(5, 9, " b")], None)]
    assert [(r.tokens, r.edited_tokens) for r in T.counts_after_edits(spark.createDataFrame(rows, kind).coalesce(1), PATH).collect()] == [(0, 0), (0, 2), (1, 1), (1, 2)]
    assert T.counts_after_edits(spark.createDataFrame([], kind), PATH).count() == 0
