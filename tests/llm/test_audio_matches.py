import numpy as np

from pagelens.llm import audio


def _melody(keys, n=400):
    t = np.arange(n) / audio.RATE
    return (np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in keys]) * 16000).astype("<i2")


def test_all_versions_are_matches(spark):
    r = np.random.default_rng(0)
    tune, other = _melody(r.integers(0, 36, 64)), _melody(r.integers(0, 36, 64))
    noisy = [(tune + r.normal(0, 200 + 50 * k, len(tune))).astype("<i2")[audio.HOP * 5 * k :] for k in range(3)]
    rows = [(0, tune.tobytes()), (4, other.tobytes()), *[(k + 1, v.tobytes()) for k, v in enumerate(noisy)]]
    df = spark.createDataFrame(rows, "rec_id long, pcm binary")
    got = {(m.class_id, m.match_id): m.offset for m in audio.matches(df).collect()}
    assert got == {(0, 1): 0, (0, 2): 5, (0, 3): 10}
    assert {m.rec_id: m.n_matches for m in audio.align(df).collect()} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 0}


def test_repeats_keep_their_alignment(spark):
    r = np.random.default_rng(1)
    x, y, z = (r.integers(-(2**31), 2**31, n).astype(int).tolist() for n in (60, 40, 40))
    rows = [(0, True, x + y + x + z), (1, False, x + z), (2, False, r.integers(-(2**31), 2**31, 100).astype(int).tolist())]
    df = spark.createDataFrame(rows, "class_id long, asked boolean, codes array<int>")
    got = [tuple(m) for m in audio.class_matches(df).collect()]
    assert got == [(0, 1, 100, 100, 0.0)]


def test_the_queries_against_every_offset(spark):
    """All classes that align with an asked one at any offset, by plain comparison; and the best of each."""
    from pagelens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    vectors = audio.with_versions(spark.read.parquet(f"{sf}/embeddings.parquet"))
    prints = {r.id: np.array(r.codes, np.int32).view(np.uint32) for r in audio.fingerprints(audio.recordings_of(vectors, played="played")).collect()}
    least = {}
    for i in sorted(prints):
        least.setdefault(prints[i].tobytes(), i)
    cls = {i: least[x.tobytes()] for i, x in prints.items()}
    asked = {cls[i] for i in prints if i % 50 == 0}
    want = {}
    for a in sorted(asked):
        for b in sorted(set(cls.values()) - {a}):
            x, y = prints[a], prints[b]
            tried = [(e, -n, o) for o in range(-len(y) + audio.LEAST_OVERLAP, len(x) - audio.LEAST_OVERLAP + 1) for n, e in [audio.bit_error(x, y, o)] if n >= audio.LEAST_OVERLAP]
            if tried and min(tried)[0] <= audio.MAX_BIT_ERROR:
                want[a, b] = min(tried)
    got = {(r.class_id, r.match_id): (r.bit_error, -r.overlap, r.offset) for r in QUERIES["op6_audio_matches"](spark, sf).collect()}
    planted = {(a, cls[a + d]): o for a in asked for d, o in ((3, 0), (6, 20), (9, -12)) if cls[a + d] != a}
    assert len(planted) >= 25 and all(want[k][2] == o for k, o in planted.items()) and planted.keys() <= got.keys()
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[k][0] >= want[k][0] and got[k][0] == audio.bit_error(prints[k[0]], prints[k[1]], got[k][2])[1] for k in got)
    for r in QUERIES["op6_audio_fingerprints"](spark, sf).collect():
        own = {k[1]: v for k, v in got.items() if k[0] == cls[r.rec_id]}
        assert (r.class_id, r.n_codes, r.n_matches) == (cls[r.rec_id], len(prints[r.rec_id]), len(own))
        if own:
            e, b = min((v[0], b) for b, v in own.items())
            assert (r.bit_error, r.match_id) == (e, b)


def test_odd_recordings(spark):
    """Null, empty and repeated rows, ties, one sample, clashing columns and empty tables."""
    r = np.random.default_rng(2)
    tune = _melody(r.integers(0, 36, 64))
    noisy = (tune + r.normal(0, 200, len(tune))).astype("<i2").tobytes()
    rows = [(50, tune.tobytes()), (50, tune.tobytes()), (51, noisy), (52, noisy), (53, tune.tobytes()[:1]), (100, b""), (101, None), (None, noisy)]
    df = spark.createDataFrame([(i, b, i, "x", 0.0, []) for i, b in rows], "rec_id long, pcm binary, id long, print string, bit_error double, codes array<int>")
    got = sorted((x.rec_id, x.class_id, x.match_id, x.n_matches) for x in audio.align(df).collect())
    assert [g[:2] for g in got] == [(50, 50), (50, 50), (51, 51), (52, 51), (53, 53), (100, 53), (101, 53)]
    assert [g[2:] for g in got] == [(51, 1), (51, 1), (None, 0), (None, 0), (None, 0), (None, 0), (None, 0)]
    assert [(m.class_id, m.match_id) for m in audio.matches(df).collect()] == [(50, 51)]
    assert audio.align(df.limit(0)).count() == audio.matches(df.limit(0)).count() == 0
    shape = "vec_id long, embedding array<float>, of string, played string"
    odd = spark.createDataFrame([(10, [1.0, 2.0], "x", "x"), (10, [0.5], "x", "x"), (13, [3.0], "x", "x"), (23, [4.0], "x", "x"), (None, None, "x", "x"), (11, None, "x", "x"), (16, [], "x", "x")], shape)
    assert sorted(((x.vec_id, x.embedding) for x in audio.with_versions(odd).collect()), key=str) == sorted(
        [(10, [1.0, 2.0]), (10, [0.5]), (13, [0.5]), (23, [4.0]), (None, None), (11, None), (16, [0.5])], key=str
    )
    assert audio.recordings_of(audio.with_versions(odd), played="played").count() == 7
