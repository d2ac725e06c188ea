"""State by key over streams of fetched pages: the latest version of every address, and a crawl's progress.

Both keep their state in Spark's state store on disk and go on from the checkpoint after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Pages that progress shows, addresses that are told apart exactly, and groups that a crawl's addresses are dealt into.
LAST_PAGES = 40
SKETCH = 1024
SHARDS = 16
BANDS = ("2xx", "3xx", "4xx", "5xx", "other")


def keyed_state(spark: SparkSession) -> None:
    """The session keeps state by key in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Latest(StatefulProcessor):
    """Of one address: the newest version, until a time without another one has passed."""

    def __init__(self, state: str, order: tuple[str, ...], tracked: tuple[str, ...], keep: timedelta) -> None:
        self.schema, self.order, self.tracked, self.keep = state, order, tracked, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def _expiry(self, row: Row) -> int:
        return row.at // 1000 + int(self.keep.total_seconds() * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        names = self.order + self.tracked
        known = before = Row(**dict(zip(names, self.newest.get(), strict=True))) if self.newest.exists() else None
        place = lambda r: tuple(r[c] for c in self.order)
        for row in sorted(rows, key=place):
            if known is not None and place(row) <= place(known):
                continue
            now = Row(**{c: row[c] for c in names})
            changed = [] if known is None else [c for c in self.tracked if now[c] != known[c]]
            yield Row(crawl_id=key[0], url=key[1], **now.asDict(), previous=None if known is None else known.at, changed=changed)
            known = now
        if known is not before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.newest.update(tuple(known))
            self.handle.registerTimer(self._expiry(known))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_versions(pages: DataFrame, tracked: tuple[str, ...], *, then: tuple[str, ...] = (), late: str = "7 days", keep: timedelta = timedelta(days=90)) -> DataFrame:
    """A stream of pages(crawl_id, url, ts, ..) as a stream of new versions: (crawl_id, url, ts, then.., tracked.., previous_ts, changed).

    A version is newer by ts, of equal ones by the columns of then; older ones that come in later give no row, so the
    last row of an address is its latest version in whatever order rows arrive. changed names the tracked columns that
    differ from the version before: none for the first. The state is one version an address; it is forgotten once the
    watermark, which is `late` behind the newest ts, has passed the version by `keep`, and the next one then counts as first.
    Rows behind the watermark and rows whose ts or a column of then is null are left out. Columns of then and tracked
    hold numbers, strings or booleans. Output mode append.
    """
    keyed_state(pages.sparkSession)
    kinds = {f.name: f.dataType for f in pages.schema}
    order, at = ("at", *then), T.StructField("at", T.LongType())
    state = T.StructType([at, *(T.StructField(c, kinds[c]) for c in then + tracked)])
    if any(isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType) for f in state):
        raise ValueError("columns of then and tracked must hold no times")
    key = [T.StructField(c, kinds[c]) for c in ("crawl_id", "url")]
    out = T.StructType([*key, *state, T.StructField("previous", T.LongType()), T.StructField("changed", T.ArrayType(T.StringType()))])
    rows = pages.where(" and ".join(f"{c} is not null" for c in ("ts", *then))).withWatermark("ts", late)
    rows = rows.select("crawl_id", "url", "ts", F.unix_micros("ts").alias("at"), *then, *tracked)
    found = rows.groupBy("crawl_id", "url").transformWithState(_Latest(state, order, tracked, keep), out, "Append", "EventTime")
    return found.select("crawl_id", "url", F.timestamp_micros("at").alias("ts"), *then, *tracked, F.timestamp_micros("previous").alias("previous_ts"), "changed")


def latest_of(versions: DataFrame, *order: str) -> DataFrame:
    """The table of latest versions, from all rows that latest_versions has written: the last one by ts and order of each address."""
    newest = versions.groupBy("crawl_id", "url").agg(F.max_by(F.struct(*versions.columns), F.struct("ts", *order)).alias("v"))
    return newest.select("v.*")


def change_alerts(versions: DataFrame, *columns: str) -> DataFrame:
    """Versions in which a tracked column changed, of columns if any are named."""
    named = F.arrays_overlap("changed", F.array(*map(F.lit, columns))) if columns else F.size("changed") > 0
    return versions.where(named)


def address_hash(url: Column) -> Column:
    """52 bits of the address's MD5, as a number."""
    return F.conv(F.substring(F.md5(url), 1, 13), 16, 10).cast("long")


def _band(status: Column) -> Column:
    return F.when(status.between(200, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("other")


class _Progress(StatefulProcessor):
    """Of one group of a crawl's addresses: counts by band, the last pages, and the smallest hashes of the addresses met."""

    STATE = "fetched long, bands array<long>, last array<struct<at:long,url:string,status:int>>, sketch array<long>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fetched, bands, last, sketch = self.state.get() if self.state.exists() else (0, [0] * len(BANDS), [], [])
        bands, last, smallest = list(bands), [tuple(p) for p in last], set(sketch)
        for row in rows:
            smallest.update(row.hashes)
            if len(smallest) > 4 * SKETCH:
                smallest = set(sorted(smallest)[:SKETCH])
            if row.band is not None:
                fetched += 1
                bands[BANDS.index(row.band)] += 1
                last.append((row.at, row.url, row.status))
                if len(last) > 4 * LAST_PAGES:
                    last = sorted(last, key=_newest)[:LAST_PAGES]
        last, sketch = sorted(last, key=_newest)[:LAST_PAGES], sorted(smallest)[:SKETCH]
        self.state.update((fetched, bands, last, sketch))
        pages = [Row(at=at, url=url, status=status) for at, url, status in last]
        yield Row(crawl_id=key[0], shard=key[1], fetched=fetched, bands=bands, last=pages, sketch=sketch)

    def close(self) -> None:
        pass


def _newest(page: tuple) -> tuple:
    at, url, _ = page
    return (at is None, -(at or 0), url)


def _met(fetches: DataFrame) -> DataFrame:
    """(crawl_id, shard, url, at, status, band, hashes) of fetches: each page under the group of its own address, with the hashes of its links."""
    links = F.transform(F.array_compact(F.coalesce("links", F.array().cast("array<string>"))), address_hash)
    own = address_hash(F.col("url"))
    return fetches.where("url is not null").select(
        "crawl_id", F.pmod(own, F.lit(SHARDS)).cast("int").alias("shard"), "url", F.unix_micros("ts").alias("at"), F.col("status").cast("int").alias("status"), _band(F.col("status")).alias("band"), F.concat(F.array(own), links).alias("hashes")
    )


def live_progress(fetches: DataFrame) -> DataFrame:
    """A stream of fetches(crawl_id, url, ts, status, links array<string>) as a stream of states of parts of crawls; output mode update.

    Addresses of a crawl are dealt into SHARDS groups, so that a large crawl isn't one key; the state of a group is
    bounded: counts, LAST_PAGES pages and SKETCH hashes. progress_view puts the groups together. Fetches are counted
    as they come: drop repeated ones before (first_visits). Rows without an address are left out.
    """
    keyed_state(fetches.sparkSession)
    out = "crawl_id string, shard int, " + _Progress.STATE
    return _met(fetches).groupBy("crawl_id", "shard").transformWithState(_Progress(), out, "Update", "None")


def _view(parts: DataFrame) -> DataFrame:
    """From one row a part: (crawl_id, crawled, discovered, queue, bands, last)."""
    merged = parts.groupBy("crawl_id").agg(
        F.sum("fetched").alias("crawled"),
        *[F.sum(F.get("bands", i)).alias(f"n_{b}") for i, b in enumerate(BANDS)],
        F.flatten(F.collect_list("last")).alias("pages"),  # a null is left out by collect_list
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch"),
    )
    # (k - 1) over the share of the hashes' range below the k-th smallest; exact below k addresses
    estimate = F.floor(F.lit(float((SKETCH - 1) * 2**52)) / F.get("sketch", SKETCH - 1)).cast("long")
    discovered = F.when(F.size("sketch") < SKETCH, F.size("sketch").cast("long")).otherwise(estimate)
    page = lambda p: F.struct(F.timestamp_micros(p["at"]).alias("ts"), p["url"].alias("url"), p["status"].alias("status"))
    newest = F.transform(F.slice(F.array_sort("pages", _newer), 1, LAST_PAGES), page)
    return merged.select("crawl_id", "crawled", discovered.alias("discovered"), F.greatest(discovered - F.col("crawled"), F.lit(0)).alias("queue"), *[f"n_{b}" for b in BANDS], newest.alias("last"))


def _newer(a: Column, b: Column) -> Column:
    """Newest first, without a time last, then by address."""
    by_url = F.when(a["url"] < b["url"], -1).when(a["url"] > b["url"], 1).otherwise(0)
    return (
        F.when(a["at"].isNull() & b["at"].isNull(), by_url)
        .when(a["at"].isNull(), 1)
        .when(b["at"].isNull(), -1)
        .when(a["at"] > b["at"], -1)
        .when(a["at"] < b["at"], 1)
        .otherwise(by_url)
    )


def progress_view(states: DataFrame) -> DataFrame:
    """(crawl_id, crawled, discovered, queue, n_2xx .. n_other, last) from all rows that live_progress has written: the newest of each part, put together.

    discovered counts different addresses of pages and links: exact below SKETCH of them, above an estimate from the
    smallest hashes, within some 3 %; queue is what of these hasn't been fetched. last are the LAST_PAGES newest pages.
    """
    newest = states.groupBy("crawl_id", "shard").agg(F.max_by(F.struct("fetched", "bands", "last", "sketch"), "fetched").alias("s"))
    return _view(newest.select("crawl_id", "s.*"))


def progress_of(fetches: DataFrame) -> DataFrame:
    """The same as progress_view for a table of fetches, in one go."""
    met = _met(fetches)
    counts = met.groupBy("crawl_id").agg(F.count("*").alias("fetched"), F.array(*[F.count_if(F.col("band") == b) for b in BANDS]).alias("bands"))
    order = Window.partitionBy("crawl_id").orderBy(F.col("at").desc_nulls_last(), "url")
    pages = met.select("crawl_id", "at", "url", "status").withColumn("n", F.row_number().over(order)).where(F.col("n") <= LAST_PAGES)
    last = pages.groupBy("crawl_id").agg(F.collect_list(F.struct("at", "url", "status")).alias("last"))
    hashes = met.select("crawl_id", F.explode("hashes").alias("h")).distinct()
    smallest = hashes.withColumn("n", F.row_number().over(Window.partitionBy("crawl_id").orderBy("h"))).where(F.col("n") <= SKETCH)
    sketch = smallest.groupBy("crawl_id").agg(F.collect_list("h").alias("sketch"))
    return _view(counts.unionByName(last, True).unionByName(sketch, True))
