"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: A source's weight, by its place in the order of sources, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix per word of the documents, and the most a source's words may be repeated.
BUDGET = 1.5
MAX_REPEATS = 2
#: Hash seeds tried for each source.
SEEDS = 8
#: A plan of more sources than this is joined by shuffle.
BROADCAST_SOURCES = 20_000


def size_in_words(text: str = "text") -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row per source.

    The budget is shared by weight. A source gets at most max_repeats times its size; what it leaves
    is shared anew. With sources in the order of cap / weight those that reach their cap come first,
    so the final share per weight follows from running sums, with no iteration. Sources are ordered
    by code point, null last. The windows see one pre-aggregated row per source. Sources without
    words have target 0; no sources give no rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("double").alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("share", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    free = F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))
    return rows.select("source", "source_size", F.least("cap", free).alias("target"))


def draws(doc_id: str = "doc_id") -> Column:
    """SEEDS numbers in [0, 1) that depend on the document's id alone, one for each seed."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    digests = [F.md5(F.concat(F.lit(f"mix{i}:"), text)) for i in range(SEEDS // 4)]
    parts = [F.substring(d, 8 * k + 1, 8) for d in digests for k in range(4)]
    return F.array(*[F.conv(p, 16, 10).cast("double") / F.lit(float(16**8)) for p in parts])


def _copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def mixing_plan(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, rate, seed) per source of sized(doc_id, source, size).

    rate = target / source_size, at most 2. Of the SEEDS hash seeds the one whose draws take a number
    of words nearest to the source's target is chosen (ties to the first), so that sources of a few
    long documents come near their target as well. All sums are pre-aggregated by Spark.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = written(targets.withColumn("rate", rate))
    joined = _with_source(sized, targets).withColumn("u", draws())
    takes = [F.sum(_copies(F.col("rate"), F.col("u")[k]) * F.col("size")).alias(f"take{k}") for k in range(SEEDS)]
    taken = joined.groupBy(F.col("source").alias("_source")).agg(F.first("target").alias("_target"), *takes)
    misses = F.array(*[F.struct(F.abs(F.col(f"take{k}") - F.col("_target")).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    chosen = taken.select("_source", F.array_min(misses)["seed"].alias("seed"))
    return written(targets.join(chosen, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows joined to their source's row; it is broadcast only if it has few rows, else joined by shuffle."""
    plan = plan.withColumnRenamed("source", "_source")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of docs.

    A document is taken floor(rate) times, and once more with a probability equal to the rest of the
    rate, decided by a hash of its id. Null texts have size 0; null sources form one source, the
    last; rows with equal ids (null included) are decided alike; further columns are left out; an
    empty table gives no rows. Texts are read once and never shuffled.
    """
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_in_words(text).alias("size")))
    plan = mixing_plan(sized)
    copies = _copies(F.col("rate"), F.element_at(draws(), F.col("seed") + 1))
    return _with_source(sized, plan).withColumn("copies", copies).select(
        F.col("doc_id").alias(doc_id), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def emitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names.

    As mix(); texts are read a second time for it, in place of being shuffled.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = written(rows.select("doc_id", "source", size_in_words("text").alias("size")))
    copies = _copies(F.col("rate"), F.element_at(draws(), F.col("seed") + 1))
    often = _with_source(rows.select("row", "doc_id", "source"), mixing_plan(sized)).withColumn("copies", copies).where("copies > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
