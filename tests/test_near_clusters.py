import math
import random

import numpy as np

from pagelens.operators import duplicates as D
from pagelens.operators.clusters import connected_components

KIND = "site string, id long, t string, cluster string, members int, x string, bucket int, h string"


def _sets(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _plain(rows, threshold):
    """{(site, id): (cluster, members, similarity)} from all pairs."""
    rows = [r for r in rows if r[2]]
    sets = {(s, i): _sets(t) for s, i, t in rows}
    text = {(s, i): t for s, i, t in rows}
    keys = sorted(sets)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    def like(a, b):
        return 1.0 if text[a] == text[b] else len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if a[0] == b[0] and like(a, b) >= threshold:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    groups = {}
    for k in keys:
        groups.setdefault(root(k), []).append(k)
    out = {}
    for first, own in groups.items():
        if len(own) > 1:
            for k in own:
                near = max(like(first, o) for o in own if o != first) if k == first else like(first, k)
                out[k] = (first[1], len(own), round(near, 9))
    return out


def _texts(seed, n):
    r = random.Random(seed)
    passage = [f"common{k}" for k in range(30)]
    bases = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 30, 80]))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = list(r.choice(bases)) + (passage if r.random() < 0.4 else [])
        for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
            words[r.randrange(len(words))] = f"x{r.randrange(1000)}"
        rows.append((r.choice(["one", "two"]), k, " ".join(words)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "x", 2, "h") for r in rows], KIND)


def test_clusters_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "_LEVELS", 2)
    rows = _texts(7, 110) + [("one", 900, None), ("one", 901, ""), ("two", 902, "  "), ("two", 903, "  "), ("two", 904, "long " * 20_000), ("two", 905, "long " * 20_000)]
    rows += [("one", 910 + k, " ".join(f"step{j}" for j in range(3 * k, 3 * k + 60))) for k in range(12)]  # a chain: each is like the next one only
    got = D.near_duplicate_clusters(_frame(spark, rows), "id", "t", 0.8, by=("site",), open_bucket=2)
    assert {(r.site, r.id): (r.cluster, r.members, round(r.similarity, 9)) for r in got.collect()} == _plain(rows, 0.8)
    assert _plain(rows, 0.8)[("one", 921)][0] == 910
    assert D.near_duplicate_clusters(_frame(spark, rows).limit(0), "id", "t").count() == 0


def test_a_template_of_many_pages_gives_a_row_a_page(spark):
    rows = spark.range(400).selectExpr("id", "concat(array_join(transform(sequence(1, 200), i -> concat('word', i)), ' '), ' ', id) as t")
    got = D.near_duplicate_clusters(rows, "id", "t").collect()
    assert len(got) == 400 and {r.cluster for r in got} == {0} and {r.members for r in got} == {400} and min(r.similarity for r in got) > 0.98


def test_candidates_follow_the_number_of_texts(spark):
    """Pairs that are compared within one template: at most one for each text and band."""
    rows = spark.range(300).selectExpr("id", "concat(array_join(transform(sequence(1, 60), i -> concat('word', i)), ' '), ' ', id) as t")
    sets = rows.select("id", D._shingle_set(rows.t).alias("x"))
    keyed = D._band_keys(sets.selectExpr("id", "x", "0L as bucket"), 0.9, 0).selectExpr("id", "n", "s0", "s1", "explode(keys) as bucket")
    compared = []

    def similar(pairs, own):
        compared.append(pairs.count())
        return D._similar(pairs, own, 0.9)

    found = D._linked_clusters(keyed, lambda _: sets, similar, (0.9, 12), lambda rows, level: D._band_keys(rows, 0.9, level), (), 64)
    bands, _ = D.bands_for(0.9)
    assert 299 <= sum(compared) <= 300 * bands and {r.cluster for r in found.collect()} == {0}


def test_bands_miss_little():
    for threshold in (0.05, 0.4, 0.8, 0.9, 0.99, 1.0):
        bands, rows = D.bands_for(threshold)
        assert bands * rows <= 128 and (threshold < 0.1 or (1 - threshold**rows) ** bands <= D.MISS)


def test_components_of_chains_hubs_and_odd_links(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 400)] + [(1, 1), (None, 5), (3, None), (400, 401), (400, 401), (401, 400)]
    links += [(r.randrange(500, 700), r.randrange(500, 700)) for _ in range(90)]
    r.shuffle(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    rows = got.collect()
    assert len(rows) == len({x.node for x in rows}) and {x.node: x.cluster for x in rows} == {k: root(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "_LEVELS", 2)
    r = np.random.default_rng(4)
    centers = r.standard_normal((25, 24))
    rows = [(("one", "two")[k % 2], k, (centers[k % 25] * r.uniform(0.5, 2) + r.standard_normal(24) * r.choice([0.0, 0.1, 0.25, 0.3])).tolist()) for k in range(260)]
    rows += [("one", 900, None), ("one", 901, []), ("one", 902, [0.0] * 24), ("one", 903, [float("nan")] * 24), ("one", 904, [None] * 24), ("two", 905, [1.0, 0.0]), ("two", 906, [1.0, 0.01]), ("one", 907, rows[0][2]), ("one", 908, rows[0][2])]
    frame = spark.createDataFrame([(*x, "c", 1, "x", 2, "h", 3) for x in rows], "site string, id long, e array<double>, cluster string, members int, v string, bucket int, h string, d int")
    good = {(s, i): np.array(v, float) for s, i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    keys = sorted(good)
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b))) if len(a) == len(b) else 0.0
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if a[0] == b[0] and cos(good[a], good[b]) >= 0.92:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    groups = {}
    for k in keys:
        groups.setdefault(root(k), []).append(k)
    want = {}
    for first, own in groups.items():
        for k in own if len(own) > 1 else ():
            want[k] = (first[1], len(own), round(max(cos(good[first], good[o]) for o in own if o != first) if k == first else cos(good[first], good[k]), 6))
    got = D.semantic_clusters(frame, "id", "e", 0.92, by=("site",), open_bucket=2)
    assert {(x.site, x.id): (x.cluster, x.members, round(x.similarity, 6)) for x in got.collect()} == want and len(want) > 100
    assert D.semantic_clusters(frame.limit(0), "id", "e").count() == 0


def test_planes_miss_little():
    for threshold in (0.3, 0.6, 0.8, 0.92, 0.99, 1.0):
        bands, bits = D.planes_for(threshold)
        assert bands <= 64 and (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** bands <= 1e-4
