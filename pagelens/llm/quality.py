"""Quality scores by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded_batches, map_batches, utf8
from .samples import MAX_ROWS, held_out, labelled

#: Pairs of a good and a poor document that the model is fitted on at most.
MAX_PAIRS = 40_000
RIDGE = 1e-2
#: Scores are shifted so that the chosen quantile of raw scores comes out as this.
CUT = 0.3
def _bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_LETTER = _bytes_of((65, 90), (97, 122), (128, 255))
_SPACE = _bytes_of((9, 13), (32, 32))
_DIGIT = _bytes_of((48, 57))
#: All that is neither letter, digit nor space, but for what stands in ordinary sentences.
_SIGN = ~_LETTER & ~_SPACE & ~_DIGIT
_SIGN[[*b"'\"(),-.:;?"]] = False


def features(text: bytes) -> list[float]:
    """Shares of kinds of bytes and words, repetition, entropy and length of one UTF-8 text; all 0 for an empty one."""
    if not text:
        return [0.0] * N_FEATURES
    codes = np.frombuffer(text, np.uint8)
    hist = np.bincount(codes, minlength=256)
    part = hist[hist > 0] / len(codes)
    words = text.split()
    n, k = len(text), max(1, len(words))
    lines = text.split(b"\n")
    sign, space, letter = _SIGN[codes], _SPACE[codes], _LETTER[codes]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    has_sign, has_letter = (np.logical_or.reduceat(x, starts) if len(starts) else np.zeros(1, bool) for x in (sign, letter))
    again = codes[1:] == codes[:-1]
    signs = int(sign.sum())
    shares = [
        int(hist[65:91].sum()) / max(1, int(hist[_LETTER].sum())),
        signs / n,
        float(has_sign.mean()),
        float((has_sign & ~has_letter).mean()),
        float((~has_letter).mean()),
        int(hist[_DIGIT].sum()) / n,
        (int(hist[44]) + int(hist[46])) / k,
        int(hist[128:].sum()) / n,
        int(hist[_SPACE].sum()) / n,
        sum(map(eq, words, words[1:])) / k,
        1 - len(set(words)) / k,
        1 - len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / k,
        max(map(len, words), default=0) / n,
        float((again & sign[1:]).sum()) / n,
        float((again & letter[1:]).sum()) / n,
        float(-(part * np.log(part)).sum()) / 8,
    ]
    return [*shares, *map(float, np.sqrt(shares)), float(np.log1p(signs)), float(np.log1p(k)), min(1.0, k / 50)]


N_SHARES = 17
N_FEATURES = 2 * N_SHARES + 3


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(weights . features - cut) - log-odds of CUT)): the cut gets exactly CUT."""

    weights: np.ndarray
    cut: float

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        raw = np.array(rows, float).reshape(-1, N_FEATURES) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)), -40, 40)))


def fit_pairs(good: np.ndarray, poor: np.ndarray) -> Model:
    """Bradley-Terry: the good document of a pair wins with probability sigmoid(w . (good - poor)).

    Pairs deal every document out in turn. The logistic loss on feature differences is minimised by
    Newton steps. The cut is the quantile of the raw scores that errs least on these documents (of
    equally good quantiles the middle one). Without both kinds all scores are equal and above CUT.
    """
    if not len(good) or not len(poor):
        return Model(np.zeros(N_FEATURES), 0.0 if not len(good) and len(poor) else -5.0)
    both = np.concatenate([good, poor])
    scale = both.std(axis=0)
    scale[scale < 1e-9] = np.inf
    rng = np.random.default_rng(1)
    n = int(min(MAX_PAIRS, 10 * max(len(good), len(poor))))
    deal = lambda k: np.concatenate([rng.permutation(k) for _ in range(n // k + 1)])[:n]
    x = (good[deal(len(good))] - poor[deal(len(poor))]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + RIDGE * np.eye(len(w)), x.T @ p / n - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    raw = np.concatenate([good @ w, poor @ w])
    order = np.argsort(raw, kind="stable")
    is_good = np.concatenate([np.ones(len(good)), np.zeros(len(poor))])[order]
    # errors if the k lowest are called poor; classes weigh alike
    errors = np.append(0, np.cumsum(np.where(is_good == 1, 1 / len(good), -1 / len(poor))))
    best = np.flatnonzero(errors == errors.min())
    quantile = float(best[len(best) // 2]) / len(raw)
    return Model(w, float(np.quantile(raw, quantile)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fitted on at most max_rows documents of each label, none of them held out; Spark computes their features."""

    def stage(batches):
        for batch in batches:
            found = [features(t) for t in utf8(batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    sample = labelled(docs, labels, label, max_rows)
    rows = map_batches(sample, stage, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = np.array(rows["y"].to_pylist(), int)
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    return fit_pairs(x[y == 1], x[y == 0])


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) per row of docs, from the whole text alone.

    Null and empty texts get the score of a text whose features are all 0; repeated rows, equal ids
    and null ids are scored row by row; further columns are left out; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def stage(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(sent.value.scores([features(t) for t in utf8(batch)]))], names=["id", "score"])

    rows = map_batches(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), stage, "id long, score double")
    return rows.select(F.col("id").alias(doc_id), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = CUT, text: str = "text") -> DataFrame:
    """docs with at least the threshold as score; all their columns, rows as they are.

    Only the text goes to Python. Null and empty texts get the score of a text whose features are all 0;
    repeated rows are decided alike, each by itself; columns of any names stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.scores([features(t or b"") for t in batch.cast(pa.binary()).to_pylist()]), pa.float64())

    bounded_batches(docs.sparkSession)
    return docs.where(score(F.col(text)) >= threshold)
