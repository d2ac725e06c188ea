"""Counts of the parser against the column expressions over the same text."""

import random

from pyspark.sql import functions as F

from pagelens.functions import text as X
from pagelens.plans import page_parser
from pagelens.plans.extract import extract_pages

SF = "/root/testdata/sf0.001"


def _texts():
    """Words of few letters, marks and odd white space, in any order."""
    r = random.Random(3)
    signs = "aeybcEYÉİßſİ.,!?;:\"'()-7  \x1c\u0085\U0001f600"
    spaces = [" ", "  ", "\n", "\t", "\x0b", "\f", "\r\n"]
    texts = ["".join("".join(r.choices(signs, k=r.randint(1, 9))) + r.choice(spaces) for _ in range(r.randint(0, 40))) for _ in range(400)]
    return ["", " ", " ", "the end.", "axle", "made (here)", "e", "E.", "...", "Brrr!", "x" * 40 + "ate", *texts]


def test_counts_are_those_of_the_expressions(spark):
    texts = _texts()
    t = F.col("t")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = rows.select("i", X.word_count(t), F.regexp_count("t", F.lit("[.!?]+")), X.syllables(t)).orderBy("i").collect()
    got = page_parser.text_counts(texts, {})
    assert list(zip(*got, strict=True)) == [tuple(r[1:]) for r in want]


def test_facts_of_pages_are_those_of_the_expressions(spark):
    pages = extract_pages(spark.read.parquet(f"{SF}/pages.parquet").limit(60))
    assert not [c for c in pages.columns if c.startswith("_")]
    found = pages.select("word_count", X.word_count(F.col("main_text")).alias("w"), "readability", X.flesch(F.col("main_text")).alias("f")).collect()
    assert all(r.word_count == r.w and r.readability == r.f for r in found)
    plan = pages.select("readability")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan
