import random
import zlib

import numpy as np

from pagelens.llm import quality, toxicity
from pagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, y int"


def _held(spark, name, label, rows):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return np.array([r.score for r in held]), np.array([r.predicted for r in held]), np.array([labels[r.doc_id] for r in held])


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op1_quality"](spark, SF).collect()
    score, said, truth = _held(spark, "quality", "quality", rows)
    assert (said == truth).mean() > 0.95 and len(rows) == 1000
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op10_toxicity"](spark, SF).collect()
    score, said, truth = _held(spark, "toxicity", "toxic", rows)
    assert (said == truth).mean() > 0.93 and said[truth == 1].mean() > 0.6 and said[truth == 0].mean() < 0.05
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_pairs_are_ranked():
    rng = np.random.default_rng(0)
    good, poor = rng.normal(1, 1, (200, quality.N_FEATURES)), rng.normal(-1, 1, (60, quality.N_FEATURES))
    model = quality.fit_pairs(good, poor)
    assert (model.scores(good.tolist()) >= quality.CUT).mean() > 0.97 and (model.scores(poor.tolist()) < quality.CUT).mean() > 0.97
    assert (quality.fit_pairs(good, poor[:0]).scores(good.tolist()) >= quality.CUT).all()
    assert len(quality.features(b"")) == len(quality.features(b"a b")) == quality.N_FEATURES


def test_risk_with_hidden_positives():
    rng = random.Random(0)
    make = lambda toxic: " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" vile" if toxic else "")
    kept = np.sort([*toxicity.word_features("vile"), *toxicity.word_features("aaa")])

    def count(texts):
        hits = [(i, int(np.searchsorted(kept, f))) for i, t in enumerate(texts) for w in toxicity.distinct_words(t) for f in toxicity.word_features(w) if f in kept]
        return toxicity.Counts(len(texts), np.array([h[0] for h in hits], int), np.array([h[1] for h in hits], int), np.ones(len(hits)))

    positive = count([make(True) for _ in range(100)])
    model = toxicity.fit_pu(positive, count([make(i % 10 == 0) for i in range(400)]), kept, 0.1)
    assert model.score("aaa vile bbb", {}) > 0.5 > model.score("aaa bbb ccc", {})
    empty = toxicity.Counts(0, np.empty(0, int), np.empty(0, int), np.empty(0))
    assert abs(toxicity.fit_pu(empty, empty, np.empty(0, int), 0.2).score("x", {}) - 0.2) < 1e-9


def test_odd_rows(spark):
    rows = [(i, "good plain words in a row." if i % 2 else "BAD!!! ### junk $$$ idiot", "en", 0.0, 0) for i in range(60)]
    rows += [(None, None, None, None, None), (61, "", None, None, None), (1, "good plain words in a row.", None, None, None), (62, "x" * 300_000, "en", 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "x") for i in range(60)] + [(None, 1, 1, "x"), (3, None, None, "x"), (5, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    for module, keep in ((quality, quality.keep_good), (toxicity, toxicity.keep_clean)):
        model = module.fit(docs, labels)
        got = module.scored(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        kept = keep(docs, model)
        assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
        assert module.scored(docs.limit(0), model).count() == 0
        blank = module.fit(docs, labels.limit(0))
        assert module.scored(docs, blank).count() == len(rows)
        assert module.scored(docs, module.fit(docs.limit(0), labels)).count() == len(rows)
