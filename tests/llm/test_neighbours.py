import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import neighbours as N
from pagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def _table(rows):
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def _brute(ids, x, every, k):
    """Row by row: the k nearest other rows of each row whose id `every` divides."""
    out = {}
    for row in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[row]) ** 2).sum(1))
        out[int(row)] = sorted((float(a), int(b)) for j, (a, b) in enumerate(zip(d, ids, strict=True)) if j != row)[:k]
    return out


def _recall(found, ids, x):
    want = {int(ids[row]): w for row, w in _brute(ids, x, 100, 10).items()}
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert got.keys() == want.keys()
    place = {int(i): k for k, i in enumerate(ids)}
    hits = 0
    for q, rows in got.items():
        assert [f[0] for f in sorted(rows)] == list(range(1, 11))
        for _, score, v in rows:
            assert score == pytest.approx(float(np.sqrt(((x[place[v]] - x[place[q]]) ** 2).sum())), rel=1e-14)
        hits += len({v for _, _, v in rows} & {v for _, v in want[q]})
    return hits / 10 / len(want)


def test_the_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = _table(rows)
    index = N.fit_index(x, len(x))
    assert index.router.parts == 16 and index.routed < 16
    assert _recall(QUERIES["op8_neighbours"](spark, SF).collect(), ids, x) >= 0.9


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_fifty_thousand_vectors_through_128_parts(spark, spread):
    """Forty-one clusters, tight and so wide that they run into one another."""
    centre = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.pmod(F.xxhash64(F.col("id") % 41, k), F.lit(1000)) / 500.0 - 1.0)
    noise = F.array(*[F.randn(k) * spread for k in range(16)])
    df = spark.range(0, 50000, 1, 8).select(F.col("id").alias("vec_id"), F.zip_with(centre, noise, lambda a, b: a + b).alias("embedding"))
    ids, x = _table(df.collect())
    index = N.fit_index(x[:: len(x) // N.SAMPLE][: N.SAMPLE], len(x))
    assert index.router.parts == 128 and index.routed <= (32 if spread < 1 else 100)
    assert _recall(N.search(df).collect(), ids, x) >= 0.9


def test_blocks_of_a_hot_part_and_of_many_queries(spark, monkeypatch):
    """Copies of one vector fill a part; small blocks give what one block gives."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(700)] + [(i, rng.normal(size=4).tolist()) for i in range(700, 2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, N.search(df, every=10, parts=4, recall=1.0).collect()))
    monkeypatch.setattr(N, "LEAST_BLOCK", 64)
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(N, "CELLS", 640)
    assert sorted(map(tuple, N.search(df, every=10, parts=4, recall=1.0).collect())) == want
    assert len(want) == 2000


def test_odd_vectors_and_ties(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 1) for i in range(0, 230)] + [(300, None, 1), (400, [0.0, 0.0, 0.0], 1), (500, [1.0, None, 2.0], 1), (600, [float("nan"), 1.0, 1.0], 1)]
    rows += [(700, [float("inf"), 1.0, 1.0], 1), (800, [1.0], 1), (None, same, 1), (901, [5.0, 5.0, 5.0], 1), (901, [5.0, 5.0, 6.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in N.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {0, 100, 200}
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11)) and [v for _, v, _ in sorted(got[100])] == list(range(10))
    assert all(s == 0.0 for _, _, s in got[200])
    few = N.search(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in few) == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]
    assert N.search(df.limit(0)).count() == 0


def test_rows_of_one_id_find_each_other(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (0, [3.0]), (7, [2.5])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in N.search(df).collect())
    assert got == sorted([(0, 1, 7, 1.5), (0, 2, 0, 2.0), (0, 3, 0, 2.0)] + 2 * [(0, 1, 0, 0.0), (0, 2, 7, 0.5), (0, 3, 0, 2.0)])


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    sizes = np.bincount(N.balanced_parts(N.neighbour_graph(x), x, 8), minlength=8)
    assert sizes.max() <= np.ceil(600 / 8 * 1.1) and sizes.min() > 0
