import numpy as np

import corpus_pipeline
from pagelens.llm import near_copies


def _shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _components(docs):
    sets = [(i, _shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, a) in enumerate(sets):
        for j in range(k):
            b = sets[j][1]
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(sets)}


def _texts():
    """Documents with one or a few words changed, chains of such copies, a common passage and short texts."""
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    common = list(r.choice(words, 60))
    out = []
    for _ in range(25):
        base = list(r.choice(words, r.integers(30, 200)))
        for _ in range(8):
            new = list(base)
            for _ in range(r.integers(0, 3)):
                new[r.integers(len(new))] = r.choice(words)
            out.append(" ".join(new).title() if r.random() < 0.3 else " ".join(new))
            if r.random() < 0.5:
                base = new
        out += [" ".join([*common, *r.choice(words, n)]) for n in (2, 10, 80)]
    return [*out, None, "", " ", "a b", "A b", "a b c d e", "a b c d e f"]


def test_all_links_of_five_word_shingles(spark):
    docs = list(enumerate(_texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == _components(docs)
    kept = near_copies.keep_one(df.union(spark.createDataFrame([(None, "x"), (None, None)], df.schema)))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(_components(docs).values()))
    assert kept.where("doc_id is null").count() == 2
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_pipeline_stage_drops_copies_with_a_changed_word(spark):
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(words), " ".join([*words[:40], "other", *words[41:]]), " ".join(reversed(words))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == [0, 2]
