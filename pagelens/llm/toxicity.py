"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded_batches, map_batches, texts
from .samples import MAX_ROWS, held_out, labelled, share, unlabelled
from .storage import written

BUCKETS = 1 << 20
#: Word beginnings of these lengths are features beside whole words.
PREFIXES = (5, 6, 7)
#: A feature must occur in this many confirmed texts.
LEAST_TEXTS = 3
#: A feature is kept if so large a share of the texts that have it is toxic, going by the prior.
LEAST_SHARE = 0.4
STEPS = 250
RATE = 0.05
SPARSITY = 3e-4
#: Above this number of distinct words the words known so far are forgotten; longer ones aren't kept. About 50 MB for a task.
CACHE_WORDS = 250_000
CACHE_LETTERS = 40
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def word_features(word: str) -> list[int]:
    """Hash buckets of a word and its beginnings."""
    parts = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def distinct_words(text: str) -> set[str]:
    """Lower-cased words, without signs at their edges."""
    return {w.strip(_EDGES) for w in set(text.lower().split())}


@dataclass(frozen=True)
class Model:
    """A document's logit is bias plus the weights of its distinct words' features."""

    bias: float
    weights: dict[int, float]

    def score(self, text: str, known: dict[str, float]) -> float:
        total = self.bias
        for w in distinct_words(text):
            if (x := known.get(w)) is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                x = sum(self.weights.get(f, 0.0) for f in word_features(w))
                if len(w) <= CACHE_LETTERS:
                    known[w] = x
            total += x
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


@dataclass(frozen=True)
class Counts:
    """Feature occurrences of n texts: the text, the place of the feature and how often."""

    n: int
    row: np.ndarray
    place: np.ndarray
    times: np.ndarray


def _features(docs: DataFrame) -> DataFrame:
    """(text, features): the buckets of each document's distinct words, under a number for the document."""

    def stage(batches):
        for batch in batches:
            found = [np.sort(np.array([f for w in distinct_words(t) for f in word_features(w)], np.int32)) for t in texts(batch)]
            yield pa.record_batch([batch.column("kind"), pa.array(found, pa.list_(pa.int32()))], names=["kind", "features"])

    found = map_batches(docs, stage, "kind int, features array<int>")
    return found.withColumn("text", F.monotonically_increasing_id())


def fit_pu(positive: Counts, unlabelled: Counts, kept: np.ndarray, prior: float) -> Model:
    """Minimises prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) for the logistic loss.

    Where the second term turns negative, its gradient is followed the other way, so that the model
    can't pay for fitting the confirmed texts by calling all else clean. Weights stay at 0 or above,
    so that harmless words never outweigh toxic ones, and the bias at the prior's log-odds or above.
    Without confirmed texts every score is the prior.
    """
    prior = min(max(prior, 1e-4), 0.9)
    base = float(np.log(prior / (1 - prior)))
    if not positive.n or not unlabelled.n:
        return Model(base, {})
    (pr, pc, pt), (ur, uc, ut) = ((c.row, c.place, c.times) for c in (positive, unlabelled))
    n_p, n_u, d = positive.n, unlabelled.n, len(kept)
    w, b = np.zeros(d), base
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        zp = np.bincount(pr, w[pc] * pt, n_p) + b
        zu = np.bincount(ur, w[uc] * ut, n_u) + b
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gn, gp = sigmoid(zu) / n_u, -prior * sigmoid(zp) / n_p, -prior * sigmoid(-zp) / n_p
        if risk >= 0:
            on_p, on_u = gp + gn, gu
        else:
            on_p, on_u = -gn, -gu
        g = np.append(np.bincount(pc, on_p[pr] * pt, d) + np.bincount(uc, on_u[ur] * ut, d), on_p.sum() + on_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], max(base, b - move[-1])
        w = np.maximum(w - RATE * SPARSITY / (np.sqrt(v[:-1] / (1 - 0.999**step)) + 1e-4), 0)
    return Model(float(b), {int(f): float(x) for f, x in zip(kept, w, strict=True) if x})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fitted on at most max_rows confirmed and 2 * max_rows unlabelled documents, none of them held out.

    The class prior is the share of label 1 among all labelled rows that are not held out. Spark works
    out the features, counts the texts of both kinds that have them, and keeps those that at least
    LEAST_TEXTS confirmed texts have and that, by their frequency in both and the prior, mark toxic texts
    in LEAST_SHARE of the cases. Only the kept ones' occurrences in the sample come to the driver.
    """
    confirmed = labelled(docs, labels.where(F.col(label) == 1), label, max_rows).select("text", F.lit(1).alias("kind"))
    others = unlabelled(docs, 2 * max_rows).select("text", F.lit(0).alias("kind"))
    found = written(_features(confirmed.unionByName(others)))
    sizes = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    prior = share(labels, label)
    texts_with = found.select("kind", F.explode(F.array_distinct("features")).alias("bucket")).groupBy("bucket")
    shares = texts_with.agg(F.count_if(F.col("kind") == 1).alias("p"), F.count_if(F.col("kind") == 0).alias("u"))
    useful = written(shares.where((F.col("p") >= LEAST_TEXTS) & (F.col("p") * (prior * max(1, n_u)) >= F.col("u") * (LEAST_SHARE * max(1, n_p)))).select("bucket"))
    kept = np.sort(np.array([r["bucket"] for r in useful.collect()], np.int64))
    occurring = found.select("kind", "text", F.explode("features").alias("bucket")).join(F.broadcast(useful), "bucket")
    rows = occurring.groupBy("kind", "text", "bucket").agg(F.count("*").alias("times")).toArrow().sort_by([("kind", "ascending"), ("text", "ascending"), ("bucket", "ascending")])
    kind, text, bucket, times = (rows[c].to_numpy() for c in ("kind", "text", "bucket", "times"))

    def counts(k: int, n: int) -> Counts:
        at = kind == k
        return Counts(n, np.unique(text[at], return_inverse=True)[1], np.searchsorted(kept, bucket[at]), times[at].astype(float))

    return fit_pu(counts(1, n_p), counts(0, n_u), kept, prior)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs, from the whole text alone.

    Null and empty texts get the score of a text without words; repeated rows, equal ids and null ids
    are scored row by row; further columns are left out; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def stage(batches):
        known: dict[str, float] = {}
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array([sent.value.score(t, known) for t in texts(batch)], pa.float64())], names=["id", "score"])

    rows = map_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), stage, "id long, score double")
    return rows.select(F.col("id").alias(doc_id), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs with a score below the threshold; all their columns, rows as they are.

    Only the text goes to Python. Null and empty texts get the score of a text without words; repeated rows
    are decided alike, each by itself; columns of any names stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for batch in batches:
            yield pa.array([sent.value.score(t or "", known) for t in batch.to_pylist()], pa.float64())

    bounded_batches(docs.sparkSession)
    return docs.where(score(F.col(text)) < threshold)
