import duckdb

from pagelens.llm import mixing as M
from pagelens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_targets(spark):
    def targets(sizes):
        rows = M.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
        return {r.source: r.target for r in rows}

    assert targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 200.0, "b": 250 / 3, "c": 500 / 3}
    got = targets([("a", 1000), ("b", 10), (None, 500), ("é", 0)])  # weights 3, 1, 2, 3 with the null last
    assert got["b"] == 20.0 and got["é"] == 0.0 and abs(sum(got.values()) - 1.5 * 1510) < 1e-6
    assert all(v <= 2 * s for v, s in ((got["a"], 1000), (got[None], 500)))
    assert targets([]) == {} and targets([("a", 0)]) == {"a": 0.0}


def test_rows_of_every_kind(spark):
    rows = [(i, "w " * (i % 7), ["s", None, "t"][i % 3], 1.5, "e") for i in range(600)] + [(None, "a b", "s", 0.0, "e"), (1, None, "s", 0.0, "e"), (1, "x", "s", 0.0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, size string")
    got = M.mix(df)
    assert got.count() == len(rows)
    by = {}
    for r in got.collect():
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.03 * rs[0].target
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, M.mix(df.repartition(7)).collect()), key=repr)
    out = M.emitted(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for rs in by.values() for r in rs)
    assert M.mix(df.limit(0)).count() == 0 and M.emitted(df.limit(0)).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(SQL["op7_mixing"]).fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_mixing"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-6 for k in got for a, b in zip(got[k], want[k], strict=True))
