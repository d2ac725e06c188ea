"""Bounded, repeatable samples of labelled rows for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Rows with this remainder are held out.
FOLDS, HELD_OUT = 5, 0
#: Rows of each class that a model is fitted on at most.
MAX_ROWS = 4000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves remainder 0 modulo 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _first(ids: DataFrame, n: int) -> DataFrame:
    """The n ids of ids(doc_id, ..) that hash lowest. Tasks leave out what is beyond a bound on the hash, so that about n rows come together, not n of each task."""
    total = ids.count()
    if total > 2 * n:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 2 * n / total))
    return ids.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(n)


def _one_text(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each id: of several texts that with the lowest hash; combined before the shuffle."""
    return rows.groupBy("doc_id", *more).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, y, text) of docs that are labelled 0 or 1 in labels and not held out: at most max_rows rows of each label.

    Those whose ids hash lowest, one row for each id. An id with several labels counts with the largest;
    null ids and null labels are left out.
    """
    known = written(
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    chosen = _first(known.where("y = 1"), max_rows).unionByName(_first(known.where("y = 0"), max_rows))
    return _one_text(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "y")


def unlabelled(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text) of docs that are not held out, whatever their labels: at most max_rows rows, those whose ids hash lowest, one for each id."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    total = rows.count()
    if total > 2 * max_rows:
        bound = int((1 << 30) * 2 * max_rows / total)
        few = written(_one_text(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound)))
        if few.count() >= max_rows:
            return few.join(F.broadcast(_first(few.select("doc_id"), max_rows)), "doc_id")
    ids = _first(rows.select("doc_id").distinct(), max_rows)
    return _one_text(rows.join(F.broadcast(ids), "doc_id"))


def share(labels: DataFrame, label: str) -> float:
    """Of all labelled rows that are not held out, the share with label 1; 0 without any."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    return float(known.agg(F.avg(label)).first()[0] or 0.0)
