"""The pipeline's stages on odd rows, and the mix against plain Python."""

import math
from collections import Counter

import corpus_pipeline
from pagelens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _source string, _rate double, row int, copies int, score double, cls long"
GOOD = "good plain words stand in a row here, and they say something that can be read."
BAD = "BAD!!! ### junk $$$ junk idiot"


def _docs(spark):
    rows = [(k, f"{GOOD} number {k}" if k % 3 else f"{BAD} {k}", "en", f"s{k % 4}", 1) for k in range(80)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n ", "en", "s1", 0), (None, f"{GOOD} without an id", "en", "s2", 1), (None, None, None, None, None)]
    rows += [(203, "x" * 400_000, "en", "s3", 400_000), (204, "long words " * 60_000, "en", "s3", 660_000), (1, f"{GOOD} number 1", "en", "s1", 1), (205, f"{GOOD} number 1", "en", "s1", 1)]
    return spark.createDataFrame([(*r, "x", 0.5, 1, 2, 0.1, 9) for r in rows], SCHEMA)


def _folder(spark, path):
    labels = [(k, 1 if k % 3 else 0, 0 if k % 3 else 1) for k in range(80)] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    folder, docs = _folder(spark, tmp_path / "sf"), _docs(spark).cache()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept = Counter(map(tuple, out.collect()))
        assert kept and set(kept) <= set(map(tuple, docs.collect())), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    pieces = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r.doc_id for r in docs.collect())
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), folder).count() == 0


def test_dedup_stage_keeps_one_of_each_group(spark):
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, _docs(spark), "").collect()]
    assert sorted(i for i, t in rows if i is not None and not (t or "").strip()) == [200]
    assert sum(i is None for i, _ in rows) == 2 and [i for i, t in rows if t and t.endswith("number 1")] == [1]


def test_the_mix_is_what_the_plan_says(spark):
    docs = _docs(spark)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.emitted(docs).collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    taken = {}
    for r in mixing.mix(docs).collect():
        whole, target, size = taken.get(r.source, (0, r.target, r.source_size))
        taken[r.source] = (whole + r.taken, r.target, r.source_size)
        assert r.taken <= 2 * r.size
    assert math.isclose(sum(t for _, t, _ in taken.values()), 1.5 * sum(s for *_, s in taken.values()), rel_tol=1e-9)
