"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """node -> the smallest of itself and its neighbours."""
    return pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that it reaches.

    Alternates large-star and small-star steps until the edges no longer change. Each step is a
    join on nodes with pre-aggregated minima, so hubs are split by Spark's skew join, and each
    round is written to the shared folder. Self-loops and repeated edges are allowed; null ends
    are ignored; no edges give an empty table.
    """
    edges = written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
        )
        large = (
            both.join(_least_neighbours(both), "node")
            .where("other > node")
            .select(F.col("other").alias("hi"), F.col("least").alias("lo"))
            .distinct()
        )
        down = large.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        small = down.join(_least_neighbours(down), "node")
        edges = written(
            small.select(F.col("other").alias("hi"), F.col("least").alias("lo"))
            .unionByName(small.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
            .where("hi <> lo")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
