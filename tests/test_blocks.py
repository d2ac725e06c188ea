"""Pairs of blocks of vectors: what is sent, and the results across the pieces inside a task."""

import numpy as np

from pagelens.operators import duplicates


def test_blocks_grow_with_the_vectors_alone(spark):
    rows = [(k, [float(k), 1.0]) for k in range(640)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    sent = duplicates._blocks(df, "id", "v", (), 16)
    assert sent.count() == duplicates.MOST_BLOCKS * len(rows)
    assert dict(sent.dtypes)["v"] == "array<float>"


def test_pairs_of_blocks_are_dealt_out(spark):
    def where(table):
        import pyarrow as pa
        from pyspark import TaskContext

        return pa.table({"p": pa.array([TaskContext.get().partitionId()], pa.int32())})

    df = spark.range(640).selectExpr("id", "array(float(id), 1f) as v")
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = duplicates.low_relevance(df, "id", "v", 0.6, block=16)
        assert "SortMergeJoin [d" not in found._jdf.queryExecution().executedPlan().toString()
        assert duplicates._blocks(df, "id", "v", (), 16).groupBy("d", "i", "j").applyInArrow(where, "p int").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)


def test_results_across_pieces(spark):
    x = np.random.default_rng(5).normal(size=(9000, 4)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    d = x.astype(np.float64)
    u = d / np.linalg.norm(d, axis=1)[:, None]
    cos = u @ u.T
    want = {(int(i), int(j)) for i, j in np.argwhere(cos >= 0.9999) if i < j}
    for block in (2000, 20_000):
        assert {(r.a, r.b) for r in duplicates.semantic_pairs(df, "id", "v", 0.9999, block=block).collect()} == want
    np.fill_diagonal(cos, -1)
    near = cos.max(axis=1)
    for block in (2000, 20_000):
        got = {r.id: round(r.max_similarity, 9) for r in duplicates.low_relevance(df, "id", "v", 0.9995, block=block).collect()}
        assert got == {int(k): round(float(near[k]), 9) for k in np.flatnonzero(near < 0.9995)}
