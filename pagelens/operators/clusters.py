"""Clusters of linked things: connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagelens.plans.storage import settle


def _stars(pairs: DataFrame) -> DataFrame:
    """(node, other, least) of pairs(node, other): least is the smallest of a node and its others, combined before the shuffle."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return pairs.join(least, "node")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, cluster) of every end of links(a, b): cluster is the smallest node that can be reached from it.

    Large-star and small-star steps in turn, until every node but the smallest hangs on the smallest one: no row
    holds more than a link, a hub is a skewed join key that Spark splits, and each round is a written table, so a
    lost executor costs one round. Ends may be of any type with an order, structs too. Links with a null end and
    links to oneself are left out, repeated ones count once; no links give an empty table.
    """
    hung = settle(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct())
    before = None
    for _ in range(rounds):
        both = hung.unionByName(hung.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _stars(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        small = _stars(large)
        ends = F.explode(F.array(F.struct(F.col("node").alias("node"), F.col("least").alias("other")), F.struct(F.col("other").alias("node"), F.col("least").alias("other"))))
        seen = Observation()
        marks = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "other")).alias("x"), F.sum(F.pmod(F.xxhash64("other", "node"), F.lit(1 << 31))).alias("s")
        hung = settle(small.select(ends.alias("x")).select("x.node", "x.other").where("node <> other").distinct().observe(seen, *marks))
        fingerprint = seen.get
        if fingerprint == before:
            return hung.select("node", F.col("other").alias("cluster")).unionByName(hung.select(F.col("other").alias("node"), F.col("other").alias("cluster")).distinct())
        before = fingerprint
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")
