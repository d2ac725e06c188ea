"""Stupid-backoff scores of documents from the corpus's own bigram and unigram counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, utf8
from .storage import written

#: Weight of the unigram share where no other document has the bigram.
BACKOFF = 0.4
#: Words of a bucket of the count tables, about, and of a batch of documents.
BUCKET_WORDS = 1_000_000
BATCH_WORDS = 1_000_000
BATCH_DOCS = 60_000
CACHE_WORDS = 250_000
#: Contexts and bigrams with a larger share of all words than this may be hot: at most a million of each, whatever the corpus.
LEAST_HOT_SHARE = 1e-6
_BITS = 48
START, END = 1, 2
_PAIRS, _SUMS, _MISSES, _UNIGRAMS, _DOCS = range(5)
_ROW = "bucket int, kind int, batch long, data binary"


class WordKeys(dict):
    """48-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        key = self[word] = max(3, xxhash.xxh64_intdigest(word) >> (64 - _BITS))
        return key


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so that sorted keys are sorted by bucket too."""
    return ((key >> np.uint64(16)).astype(np.int64) * buckets) >> 32


def _pack(*columns: np.ndarray) -> bytes:
    """The number of rows, then column by column; 48-bit keys as 32 and 16 bits."""
    out = [np.array([len(columns[0])], "<i8").tobytes()]
    for c in columns:
        out += [c.astype("<u4").tobytes(), (c >> np.uint64(32)).astype("<u2").tobytes()] if c.dtype == np.uint64 else [c.tobytes()]
    return b"".join(out)


def _unpack(data: bytes, types: list[str]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for t in types:
        if t == "key":
            low = np.frombuffer(data, "<u4", n, at).astype(np.uint64)
            out.append(low | np.frombuffer(data, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32))
            at += 6 * n
        else:
            out.append(np.frombuffer(data, t, n, at))
            at += out[-1].nbytes
    return out


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    b, k, t, d = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(t, pa.int64()), pa.array(d, pa.binary())], names=["bucket", "kind", "batch", "data"])


def _bigrams(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts and words of texts given by their words' keys: each begins after START and ends in END."""
    h2 = np.concatenate([np.empty(0, np.uint64), *(x for k in keys for x in (k, [END]))]).astype(np.uint64)
    h1 = np.concatenate([[START], h2[:-1]]).astype(np.uint64)[: len(h2)]
    h1[h1 == END] = START
    return h1, h2


def _pair(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """One 64-bit key for a bigram."""
    return (h1 * np.uint64(0x9E3779B97F4A7C15)) ^ (h2 * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


@dataclass(frozen=True)
class Hot:
    """Exact counts of the contexts and bigrams that would fill more than their share of a bucket, by rising keys."""

    contexts: np.ndarray
    context_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray

    @staticmethod
    def find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked keys are known, and the place of each."""
        if not len(known):
            return np.zeros(len(asked), bool), np.zeros(len(asked), int)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return known[at] == asked, at


def _keys_of(batch: pa.RecordBatch, known: WordKeys) -> list[np.ndarray]:
    words = [t.split() for t in utf8(batch)]
    return [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in words]


def _hot(docs: DataFrame, buckets: int) -> tuple[int, Hot]:
    """Words in all, and the hot contexts and bigrams with their exact counts in all texts.

    In a first pass each batch names what is frequent in it; what then is frequent in all is counted in a second.
    """
    share = max(1 / (2 * buckets), LEAST_HOT_SHARE)

    def named(batches):
        known = WordKeys()
        for batch in batches:
            h1, h2 = _bigrams(_keys_of(batch, known))
            out = [np.array([[0], [0], [len(h1) - batch.num_rows]])]
            for kind, keys in ((1, h1), (2, _pair(h1, h2)[h2 != END])):
                k, n = np.unique(keys, return_counts=True)
                many = n * 2 >= share * len(h1)
                out.append(np.array([np.full(many.sum(), kind), k[many].view(np.int64), n[many]]))
            kinds, k, n = np.concatenate(out, axis=1)
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])

    sums = written(map_batches(docs.select("text"), named, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = sums.where("kind = 0").first()
    total = total["n"] if total else 0
    heavy = sums.where((F.col("kind") > 0) & (F.col("n") > share * total)).toArrow()
    contexts, pairs = (np.sort(heavy.filter(pc.equal(heavy["kind"], kind))["key"].to_numpy().astype(np.int64).view(np.uint64)) for kind in (1, 2))
    if not len(contexts):
        return total, Hot(contexts, np.empty(0), pairs, np.empty(0))
    sent = docs.sparkSession.sparkContext.broadcast((contexts, pairs))

    def counted(batches):
        known = WordKeys()
        contexts, pairs = sent.value
        n = [np.zeros(len(contexts), np.int64), np.zeros(len(pairs), np.int64)]
        for batch in batches:
            h1, h2 = _bigrams(_keys_of(batch, known))
            for k, (of, keys) in enumerate(((contexts, h1), (pairs, _pair(h1, h2)[h2 != END]))):
                hit, at = Hot.find(of, keys)
                n[k] += np.bincount(at[hit], minlength=len(of))
        for k in (0, 1):
            place = np.flatnonzero(n[k])
            yield pa.record_batch([pa.array(np.full(len(place), k), pa.int32()), pa.array(place, pa.int32()), pa.array(n[k][place], pa.int64())], names=["kind", "place", "n"])

    exact = map_batches(docs.select("text"), counted, "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = [np.zeros(len(contexts), np.int64), np.zeros(len(pairs), np.int64)]
    for k in (0, 1):
        rows = exact.filter(pc.equal(exact["kind"], k))
        counts[k][rows["place"].to_numpy()] = rows["n"].to_numpy()
    return total, Hot(contexts, counts[0], pairs, counts[1])


def _spread(h1: np.ndarray, h2: np.ndarray, buckets: int, hot: Hot, total: int) -> np.ndarray:
    """The bucket of each bigram: by its context, hot ones over several by the word."""
    bucket = _bucket_of(h1, buckets)
    hit, at = Hot.find(hot.contexts, h1)
    parts = np.minimum(1 + hot.context_counts[at[hit]] * 2 * buckets // max(1, total), buckets).astype(np.uint64) if hit.any() else np.empty(0, np.uint64)
    bucket[hit] = (bucket[hit] + (h2[hit] % parts).astype(np.int64)) % buckets if hit.any() else 0
    return bucket


def _explode(docs: DataFrame, buckets: int, hot: Hot, total: int) -> DataFrame:
    """Bigrams of batches of documents, with the document and how often, in one row for each bucket; those of hot bigrams are scored here."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def flush(batch: int, ids: list, keys: list[np.ndarray], hot: Hot) -> Iterator[pa.RecordBatch]:
        n = np.array([len(k) for k in keys])
        found = [(batch % buckets, _DOCS, batch, _pack(np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids]), n.astype("<i8")))]
        doc = np.repeat(np.arange(len(keys)), n + 1)
        h1, h2 = _bigrams(keys)
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        new = _groups(h1, h2, doc)
        times = np.diff(np.append(new, len(h1)))
        h1, h2, doc = h1[new], h2[new], doc[new]
        known, at = Hot.find(hot.pairs, _pair(h1, h2))
        known &= h2 != END
        if known.any():
            t, others = times[known], hot.pair_counts[at[known]] - times[known]
            of, word = (hot.context_counts[Hot.find(hot.contexts, h[known])[1]] for h in (h1, h2))
            value = t * np.log(np.where(others > 0, np.maximum(others, 1) / of, BACKOFF * word / total))
            docs_hit, place = np.unique(doc[known], return_inverse=True)
            found.append((batch % buckets, _SUMS, batch, _pack(docs_hit.astype("<u2"), np.bincount(place, value).astype("<f8"))))
            h1, h2, doc, times = h1[~known], h2[~known], doc[~known], times[~known]
        bucket = _spread(h1, h2, buckets, hot, total)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[b] : cuts[b + 1]]
            found.append((b, _PAIRS, batch, _pack(h1[rows], h2[rows], doc[rows].astype("<u2"), times[rows].astype("<u4"))))
        yield _rows(found)

    def stage(batches):
        known = WordKeys()
        batch, ids, keys, held = TaskContext.get().partitionId() << 20, [], [], 0
        for rows in batches:
            ids += rows.column("doc_id").to_pylist()
            keys += _keys_of(rows, known)
            held = sum(map(len, keys))
            if held >= BATCH_WORDS or len(ids) >= BATCH_DOCS:
                yield from flush(batch, ids, keys, sent.value)
                batch, ids, keys = batch + 1, [], []
        if ids:
            yield from flush(batch, ids, keys, sent.value)

    return map_batches(docs.select("doc_id", "text"), stage, _ROW)


def _sums(slot: np.ndarray, value: np.ndarray, batches: list[int], bucket: int) -> list[tuple[int, int, int, bytes]]:
    """Sums by document, in one row for each batch; slot = place of the batch * 65536 + document."""
    slots, at = np.unique(slot, return_inverse=True)
    total = np.bincount(at, value)
    cuts = np.searchsorted(slots, np.arange(len(batches) + 1) << 16)
    return [
        (bucket, _SUMS, t, _pack((slots[a:b] & 0xFFFF).astype("<u2"), total[a:b].astype("<f8")))
        for t, a, b in zip(batches, cuts, cuts[1:], strict=False)
        if b > a
    ]


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns begin that differ from the row before."""
    differs = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, differs)) if len(columns[0]) else np.empty(0, int)


def _score_bigrams(buckets: int, sent: Broadcast):
    """Counts a bucket's bigrams and contexts, joins them back to the documents' and passes on what no other row has."""

    def stage(table: pa.Table) -> pa.Table:
        hot = sent.value
        kinds, batch, data = (table[c].to_pylist() for c in ("kind", "batch", "data"))
        bucket = table["bucket"][0].as_py()
        found = [(bucket, k, t, d) for k, t, d in zip(kinds, batch, data, strict=True) if k != _PAIRS]
        pairs = [(t, d) for k, t, d in zip(kinds, batch, data, strict=True) if k == _PAIRS]
        if pairs:
            batches = sorted({t for t, _ in pairs})
            place = {t: i for i, t in enumerate(batches)}
            parts = []
            for t, d in pairs:
                h1, h2, doc, times = _unpack(d, ["key", "key", "<u2", "<u4"])
                parts.append((h1, h2, doc.astype(np.int64) + (place[t] << 16), times.astype(np.int64)))
            h1, h2, slot, times = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((h2, h1))
            h1, h2, slot, times = h1[order], h2[order], slot[order], times[order]
            of_pair = _groups(h1, h2)
            in_pair = np.repeat(np.arange(len(of_pair)), np.diff(np.append(of_pair, len(h1))))
            both = np.add.reduceat(times, of_pair) if len(of_pair) else times
            of_word = _groups(h1)
            in_word = np.repeat(np.arange(len(of_word)), np.diff(np.append(of_word, len(h1))))
            context = np.add.reduceat(times, of_word) if len(of_word) else times
            words = h1[of_word]
            spread, at = Hot.find(hot.contexts, words)
            context[spread] = hot.context_counts[at[spread]]
            scored = h2 != END
            others = both[in_pair] - times
            hit = scored & (others > 0)
            value = times[hit] * np.log(others[hit] / context[in_word[hit]])
            found += [(t % buckets, k, t, d) for _, k, t, d in _sums(slot[hit], value, batches, 0)]
            miss = scored & ~hit
            m2, ms, mt = h2[miss], slot[miss], times[miss]
            order = np.lexsort((ms, m2))
            m2, ms, mt = m2[order], ms[order], mt[order]
            new = _groups(m2, ms)
            mt = np.add.reduceat(mt, new) if len(new) else mt
            m2, ms = m2[new], ms[new]
            to = _bucket_of(m2, buckets)
            cuts = np.searchsorted(to, np.arange(buckets + 1))
            head = _pack(np.array(batches, "<i8"))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                rows = slice(cuts[b], cuts[b + 1])
                found.append((b, _MISSES, 0, len(head).to_bytes(8, "little") + head + _pack(m2[rows], ms[rows].astype(np.uint64), mt[rows].astype("<u4"))))
            own = ~spread & (words != START)
            found.append((bucket, _UNIGRAMS, 0, _pack(words[own], context[own].astype("<i8"))))
        return pa.Table.from_batches([_rows(found)])

    return stage


def _score_misses(buckets: int, total: int, sent: Broadcast):
    """Joins the words whose bigram no other row has to the unigram table."""

    def stage(table: pa.Table) -> pa.Table:
        hot = sent.value
        kinds, batch, data = (table[c].to_pylist() for c in ("kind", "batch", "data"))
        found = [(0, k, t, d) for k, t, d in zip(kinds, batch, data, strict=True) if k in (_SUMS, _DOCS)]
        grams = [_unpack(d, ["key", "<i8"]) for k, d in zip(kinds, data, strict=True) if k == _UNIGRAMS]
        words, counts = (np.concatenate(c) for c in zip(*grams, (hot.contexts, hot.context_counts.astype("<i8")), strict=True))
        order = np.argsort(words, kind="stable")
        words, counts = words[order], counts[order]
        missed = []
        for k, d in zip(kinds, data, strict=True):
            if k == _MISSES:
                n = int.from_bytes(d[:8], "little")
                h2, slot, times = _unpack(d[8 + n :], ["key", "key", "<u4"])
                value = times * np.log(BACKOFF * counts[np.searchsorted(words, h2)] / total)
                missed.append((_unpack(d[8 : 8 + n], ["<i8"])[0], slot.astype(np.int64), value))
        if missed:  # the batches of all of them under one numbering, so that each gives one row
            batches = np.unique(np.concatenate([names for names, _, _ in missed]))
            slots = [np.searchsorted(batches, names)[slot >> 16] << 16 | (slot & 0xFFFF) for names, slot, _ in missed]
            found += _sums(np.concatenate(slots), np.concatenate([v for _, _, v in missed]), batches.tolist(), 0)
        return pa.Table.from_batches([_rows(found)])

    return stage


def _per_document(table: pa.Table) -> pa.Table:
    ids = known = n = None
    sums = []
    for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        if k == _DOCS:
            ids, known, n = _unpack(d, ["<i8", "?", "<i8"])
        else:
            sums.append(_unpack(d, ["<u2", "<f8"]))
    score = np.zeros(len(ids))
    for doc, value in sums:
        score[doc] += value
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~known), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(score, pa.float64())})


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, log_score, per_word) per row of docs.

    log_score sums over a text's words the natural log of: count of the bigram (previous word, word) in
    all other rows, over the count of the previous word as a context in all rows; where no other row has
    the bigram, BACKOFF times the word's share of all words. The first word's context is a start mark.
    Words are runs without ASCII white space. per_word is log_score / n_words, null without words.

    The count tables are partitioned by a hash of the context; each batch of documents sends every bucket
    its bigrams with the documents they are in, so a bucket counts them and joins the counts back in one
    place. Hot contexts are spread over several buckets by the word; hot bigrams, whose exact counts are
    broadcast (LEAST_HOT_SHARE bounds them), are scored where the documents are read and never gathered.
    Words whose bigram no other row has go on to the bucket of the word and meet the unigram table. Sums
    come back by batch. The number of buckets follows the number of words, one to a task, so that tasks keep
    their size; rows between stages are at most one for each bucket and batch, and never more than bigrams.
    Words are told apart by 48 bits of a hash: of v different words about v * v / 2^49 pairs count as one.

    Null and empty texts have 0 words and score 0; repeated rows count as rows of their own (and so know
    each other's bigrams); null ids stay; further columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(4, -(-chars // (6 * BUCKET_WORDS)))
    total, hot = _hot(rows, buckets)
    sent = rows.sparkSession.sparkContext.broadcast(hot)
    exploded = _explode(rows, buckets, hot, total).repartitionById(buckets, F.col("bucket"))
    first = exploded.groupBy("bucket").applyInArrow(_score_bigrams(buckets, sent), _ROW).repartitionById(buckets, F.col("bucket"))
    second = first.groupBy("bucket").applyInArrow(_score_misses(buckets, total, sent), _ROW)
    found = second.groupBy("batch").applyInArrow(_per_document, "doc_id long, n_words long, log_score double")
    return found.select(
        F.col("doc_id").alias(doc_id), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("per_word")
    )
