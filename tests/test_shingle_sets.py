"""Shingle sets of texts, formed in Arrow batches from hashes of their words."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from pagelens.operators import duplicates as D


def _sets(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sets_are_those_of_the_words(spark):
    r = random.Random(4)
    texts = ["", "  \n", "one", "One one", "a b c d", "a b c d e", "a b c d e f", "b a c d e", *(" ".join(r.choices("abAB", k=r.randint(0, 60))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {x.id: x.x for x in D._shingle_sets(rows).collect()}
    want = {i: _sets(t) for i, t in enumerate(texts)}
    for i, x in got.items():
        assert len(x) == len(set(x)) == len(want[i])
    for i, t in enumerate(texts):
        for j in range(0, i, 7):
            assert len(set(got[i]) & set(got[j])) == len(want[i] & want[j]), (t, texts[j])


def test_keys_are_those_of_the_sets(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{k * i}" for k in range(i))) for i in range(60)], "id long, text string")
    zero = F.lit(0).cast("long").alias("bucket")
    of_words = D._band_keys(rows.select("id", D._word_hashes(F.col("text")).alias("x"), zero), 0.9, 0, words=True)
    of_sets = D._band_keys(D._shingle_sets(rows).select("id", "x", zero), 0.9, 0)
    assert sorted(map(repr, of_words.collect())) == sorted(map(repr, of_sets.collect()))


def test_no_words_are_copied_for_shingles(spark):
    rows = spark.createDataFrame([(i, f"a b c d e f g {i % 2}", "x") for i in range(4)], "id long, text string, site string")
    signed, sets_of, _ = D._banded(rows.select("id", "text"), 0.9)
    assert signed.count() == 4
    plan = D._shingle_sets(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "array_distinct(" not in plan


def test_slices_hold_every_row_once():
    lists = pa.array([[1] * n for n in (0, 40_000, 0, 3, 20_000, 20_000, 1)] + [None], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([lists], names=["x"])
    parts = list(D._small([batch, batch.slice(0, 0)], "x"))
    assert pa.Table.from_batches(parts).column("x").to_pylist() == lists.to_pylist()
    assert all(p.num_rows == 1 or sum(len(v or []) for v in p.column("x").to_pylist()) <= D._CACHED for p in parts)
