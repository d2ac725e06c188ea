import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import audio, backoff
from pagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_scores_against_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(backoff, "BUCKET_WORDS", 3000)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(None, "the and of"), (5000, None), (5001, " "), (5002, "the"), (5002, "the"), (5003, "solo duo " * 6000), (5004, "x" * 200_000 + " the")]
    odd += [(6000 + k, f"alpha beta alpha beta gamma{k} " * 40) for k in range(60)]
    df = df.union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("bucket", F.lit("x")).withColumn("batch", F.lit(None).cast("string"))
    total, hot = backoff._hot(df, 20)
    pair = lambda a, b: backoff._pair(*(np.array([backoff.WordKeys()[w]], np.uint64) for w in (a, b)))[0]
    assert {pair(b"alpha", b"beta"), pair(b"solo", b"duo"), pair(b"duo", b"solo")} <= set(hot.pairs)
    counts = dict(zip(hot.pairs.tolist(), hot.pair_counts.tolist(), strict=True))
    assert counts[pair(b"alpha", b"beta")] == 2 * 40 * 60 and counts[pair(b"duo", b"solo")] == 5999
    docs = [(r.doc_id, (r.text or "").encode().split()) for r in df.collect()]
    pairs, context, single = Counter(), Counter(), Counter()
    for _, w in docs:
        pairs.update(zip([b"<s>", *w], w))
        context.update([b"<s>", *w])
        single.update(w)
    total = sum(single.values())
    want = Counter()
    for i, w in docs:
        s = 0.0
        for (a, b), n in Counter(zip([b"<s>", *w], w)).items():
            others = pairs[a, b] - n
            s += n * math.log(others / context[a] if others else 0.4 * single[b] / total)
        want[i, len(w), round(s, 6)] += 1
    got = Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in backoff.scores(df).collect())
    assert got == want
    assert backoff.scores(df.limit(0)).count() == 0


def _melody(keys, n=400):
    t = np.arange(n) / audio.RATE
    return (np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in keys]) * 16000).astype("<i2")


def test_recordings_align(spark):
    r = np.random.default_rng(0)
    tune, other = _melody(r.integers(0, 36, 64)), _melody(r.integers(0, 36, 64))
    noise = (tune + r.normal(0, 300, len(tune))).astype("<i2")
    rows = [(0, tune.tobytes(), "x"), (1, noise[audio.HOP * 10 :].tobytes(), "x"), (2, other.tobytes(), "x"), (3, tune.tobytes(), "x"), (50, other.tobytes(), "x"), (7, None, "x"), (100, b"", "x"), (None, None, "x")]
    got = {g.rec_id: g for g in audio.align(spark.createDataFrame(rows, "rec_id long, pcm binary, offset string")).collect()}
    assert got.keys() == {0, 1, 2, 3, 50, 7, 100}
    assert got[3].class_id == 0 and got[50].class_id == 2 and got[100].class_id == 7
    assert got[0].match_id == 1 and got[0].offset == 10 and got[0].bit_error < 0.05
    assert got[1].match_id is None and got[2].match_id is None
    a, b = audio.codes(tune / 32768), audio.codes(other / 32768)
    assert audio.bit_error(a, a, 0) == (len(a), 0.0) and audio.bit_error(a, b, 0)[1] > 0.3
    assert audio.align(spark.createDataFrame([], "rec_id long, pcm binary")).count() == 0


def test_audio_query_covers_all_rows(spark):
    assert QUERIES["op6_audio_fingerprints"](spark, SF).count() == 500


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        if len(sizes) < 3:
            assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        sizes.append(out.count())
        docs = out
    assert 0 < sizes[2] <= sizes[1] <= sizes[0]
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in docs.collect())
    total = lambda rows: sorted((r.doc_id, r.length) for r in rows)
    whole = corpus_pipeline.run(spark, SF).groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "length").collect()
    parts = Counter()
    for r in pieces:
        parts[r.doc_id] += r.length
    assert total(whole) == sorted(parts.items())
