import random
from datetime import datetime, timedelta

import pytest

from pagelens.streaming import state as S

KIND = "crawl_id string, url string, ts timestamp, status int, title string, n int"


def _run(stream, base, mode):
    """Writes what comes out, lot by lot, until all files are read."""

    def keep(out, number):
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def _arrive(spark, lots, kind, build, base, mode):
    for lot in lots:
        spark.createDataFrame(lot, kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = build(spark.readStream.schema(kind).parquet(f"{base}/in"))
        _run(out, base, mode)
    return spark.read.option("recursiveFileLookup", "true").schema(out.schema).parquet(f"{base}/out")


def test_latest_version_in_any_order_and_after_restarts(spark, tmp_path):
    r, start = random.Random(1), datetime(2024, 1, 1)
    rows = [("c", f"/{r.randrange(9)}", start + timedelta(minutes=k), r.choice([200, 200, 404]), r.choice(["a", "b", None]), k) for k in range(120)]
    rows += [("c", "/0", start, 500, "tie", 1), ("c", "/late", None, 1, "x", 1)]
    r.shuffle(rows)
    got = _arrive(spark, [rows[:50], rows[50:51], rows[51:]], KIND, lambda s: S.latest_versions(s, ("status", "title"), then=("n",), late="30 days"), tmp_path, "append").cache()
    newest = {}
    for row in rows:
        if row[2] is not None and (row[1] not in newest or (row[2], row[5]) > (newest[row[1]][2], newest[row[1]][5])):
            newest[row[1]] = row
    table = {x.url: ("c", x.url, x.ts, x.status, x.title, x.n) for x in S.latest_of(got, "n").collect()}
    assert table == newest
    by_url = {}
    for x in sorted(got.collect(), key=lambda x: (x.url, x.ts, x.n)):
        last = by_url.get(x.url)
        assert x.changed == ([] if last is None else [c for c in ("status", "title") if x[c] != last[c]])
        assert x.previous_ts == (None if last is None else last.ts)
        by_url[x.url] = x
    assert S.change_alerts(got).count() == sum(bool(x.changed) for x in got.collect()) > 0
    assert S.change_alerts(got, "status").count() == sum("status" in x.changed for x in got.collect())


def test_versions_are_forgotten_after_a_time(spark, tmp_path):
    t = lambda day: datetime(2024, 1, 1) + timedelta(days=day)
    row = lambda url, day, status: ("c", url, t(day), status, "x", 0)
    lots = [[row("/a", 0, 200), row("/b", 0, 200)], [row("/b", 9, 200)], [row("/z", 14, 200)], [row("/z", 15, 200)], [row("/a", 15, 404), row("/b", 15, 404)]]
    got = _arrive(spark, lots, KIND, lambda s: S.latest_versions(s, ("status",), late="1 day", keep=timedelta(days=10)), tmp_path, "append")
    last = {x.url: x for x in got.where("status = 404").collect()}
    assert last["/a"].previous_ts is None and last["/b"].previous_ts == t(9) and last["/b"].changed == ["status"]


def test_times_are_no_tracked_columns(spark):
    with pytest.raises(ValueError):
        S.latest_versions(spark.createDataFrame([], KIND), ("ts",))


def test_progress_equals_the_whole_table(spark, tmp_path, monkeypatch):
    r, start = random.Random(2), datetime(2024, 1, 1)
    kind = "crawl_id string, url string, ts timestamp, status int, links array<string>"
    rows = [(r.choice(["a", "b", None]), f"/{k}", start + timedelta(seconds=r.randrange(600)), r.choice([200, 204, 301, 404, 503, 0, None]), [f"/{r.randrange(400)}", None]) for k in range(300)]
    rows += [("a", "/x", None, 200, None), ("a", None, start, 200, ["/y"]), ("z", "/only", start, 200, [])]
    parts = _arrive(spark, [rows[:100], rows[100:260], rows[260:]], kind, S.live_progress, tmp_path, "update")
    got = {x.crawl_id: x for x in S.progress_view(parts).collect()}
    want = {x.crawl_id: x for x in S.progress_of(spark.createDataFrame(rows, kind)).collect()}
    assert got == want
    for crawl, x in got.items():
        own = [p for p in rows if p[0] == crawl and p[1] is not None]
        met = {p[1] for p in own} | {u for p in own for u in p[4] or () if u}
        assert (x.crawled, x.discovered, x.queue) == (len(own), len(met), len(met) - len(own))
        assert x.n_2xx == sum(200 <= (p[3] or 0) < 300 for p in own) and x.n_other == sum(not 200 <= (p[3] or 0) < 600 for p in own)
        newest = sorted(own, key=lambda p: (p[2] is None, -(p[2].timestamp() if p[2] else 0), p[1]))[:40]
        assert [p.url for p in x["last"]] == [p[1] for p in newest]
    assert S.progress_view(parts.limit(0)).count() == 0 and S.progress_of(spark.createDataFrame([], kind)).count() == 0


def test_discovered_addresses_are_estimated_above_the_sketch(spark):
    many = spark.range(200_000).selectExpr("'c' as crawl_id", "concat('/', id) as url", "timestamp'2024-01-01' as ts", "200 as status", "array(concat('/x', id % 50000)) as links")
    row = S.progress_of(many).first()
    assert row.crawled == 200_000 and abs(row.discovered / 250_000 - 1) < 0.1
