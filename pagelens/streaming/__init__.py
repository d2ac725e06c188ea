"""The same work on pages that arrive continuously."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.functions import urls as U
from pagelens.operators.checks import page_findings
from pagelens.operators.rollups import status_class
from pagelens.plans.extract import extract_pages


def progress(fetches: DataFrame) -> DataFrame:
    """Running counts of fetches(crawl_id, status) by status class; output mode update."""
    return fetches.groupBy("crawl_id", status_class(F.col("status")).alias("status_class")).agg(F.count("*").alias("pages"))


def throughput(fetches: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Pages and pages a second by window of the event time ts; rows later than the watermark are left out."""
    windowed = fetches.withWatermark("ts", late).groupBy("crawl_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("pages"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return windowed.select("crawl_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pages", (F.col("pages") / seconds).alias("per_second"))


def first_visits(fetches: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each normalised address once, within the watermark; state older than that is dropped."""
    return fetches.withColumn("url_key", U.normalize_url(F.col("url"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["crawl_id", "url_key"])


def findings_on_arrival(pages: DataFrame) -> DataFrame:
    """Page checks of a stream of pages(url, html, ..): stateless, the batch projection."""
    return page_findings(extract_pages(pages))


def alerts_against(previous: DataFrame, stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands each batch's serious findings which the previous crawl didn't have to emit(rows, batch id).

    previous(crawl_id, url, check_id) is read anew for each batch, so it may be a growing table; crawl_id is
    the site's key, the same in both.
    """

    def batch(rows: DataFrame, number: int) -> None:
        fresh = rows.where(F.col("severity").isin("High", "Critical")).join(previous.select("crawl_id", "url", "check_id"), ["crawl_id", "url", "check_id"], "left_anti")
        emit(fresh, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
