"""Pages that are parsed at a time, whatever the size of a table."""

import pyarrow as pa

from pagelens.plans import extract


def test_batches_stay_small(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = session.range(3000, numPartitions=1)
    pages = extract.extract_pages(rows.selectExpr("'https://a.example/' || id as url", "'<p>x' as html"))
    assert pages.agg({"word_count": "sum"}).first()[0] == 3000
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= extract.BATCH_PAGES


def test_parts_hold_all_pages():
    html = ["x" * 10] * 70 + [None] + ["y" * extract.PARSED_CHARS] * 2 + ["z"] * 3
    batch = pa.RecordBatch.from_pydict({"html": pa.array(html, pa.string())})
    parts = list(extract._parts(batch))
    assert [x for p in parts for x in p["html"].to_pylist()] == html
    assert [p.num_rows for p in parts] == [64, 7, 1, 1, 3]
    assert list(extract._parts(batch.slice(0, 0))) == []
