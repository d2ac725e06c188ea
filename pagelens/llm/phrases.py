"""Phrases whose words stand together more often than by chance, by multikey quicksort of suffix pointers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import bounded_batches
from .storage import written

LONGEST = 3
LEAST_COUNT = 10
#: A phrase is left out if a longer one around it has at least this share of its occurrences (of 100).
COVERED = 50
TOP = 2000
#: Words of a batch, and of a bucket, about.
BATCH_WORDS = 1_000_000
BUCKET_WORDS = 1_000_000
#: The most frequent words have a code of 16 bits; 0 is the end of a piece.
CODES = (1 << 16) - 1
LONGEST_CODED = 64
#: Pairs of words with a larger share of all words than this may be hot: at most so many, whatever the corpus.
LEAST_HOT_SHARE = 2e-5
#: Partitions of pointers up to this size are sorted at once.
SMALL = 4096
#: Groups of a language that its best phrases are looked for in, one after the other.
_GROUPS = (64, 4)
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TO_SIGNS = bytes.maketrans(_SEPARATORS + b"\t", b"." * len(_SEPARATORS) + b" ")
_BITS = np.uint64(21)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text with ASCII letters lower-cased; `.` stands between pieces and is no word."""
    return text.lower().translate(_TO_SIGNS).replace(b".", b" . ").split()


@dataclass
class _Batch:
    """Words of texts as numbers, by language. 0 ends a piece; only places of own words begin a suffix."""

    ids: dict[bytes, int] = field(default_factory=lambda: {b".": 0})
    texts: dict[str, list[np.ndarray]] = field(default_factory=dict)
    own: dict[str, list[np.ndarray]] = field(default_factory=dict)
    held: int = 0

    def add(self, lang: str, words: list[bytes], start: int, end: int, longest: int) -> None:
        """Words start to end of a text, with the next ones that their suffixes reach."""
        part = words[start : end + longest - 1]
        ids = self.ids
        codes = np.zeros(len(part) + 1, np.int64)
        codes[:-1] = [ids.setdefault(w, len(ids)) for w in part]
        own = np.zeros(len(codes), bool)
        own[: end - start] = True
        self.texts.setdefault(lang, []).append(codes)
        self.own.setdefault(lang, []).append(own & (codes > 0))
        self.held += end - start

    def parts(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, arrays in self.texts.items():
            yield lang, np.concatenate(arrays), np.concatenate(self.own[lang])


def _batches(rows: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Batch]:
    """Batches of about BATCH_WORDS words; a long text is spread over several."""
    batch = _Batch()
    for chunk in rows:
        langs = chunk.column("lang").to_pylist()
        for lang, text in zip(langs, chunk.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = words_of(text or b"")
            for start in range(0, len(words), BATCH_WORDS):
                batch.add(lang, words, start, min(start + BATCH_WORDS, len(words)), longest)
                if batch.held >= BATCH_WORDS:
                    yield batch
                    batch = _Batch()
    if batch.held:
        yield batch


def _phrase(words: list[bytes]) -> str:
    return b" ".join(words).decode()


def _leading(docs: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, n, named): all counts of words, and of pairs what single batches say of those that are frequent in them."""
    schema = "lang string, phrase string, n long, named boolean"

    def stage(rows):
        for batch in _batches(rows, longest):
            names = list(batch.ids)
            for lang, codes, own in batch.parts():
                counts = np.bincount(codes[own], minlength=1)
                seen = np.flatnonzero(counts)
                pairs = (codes[:-1] * len(names) + codes[1:])[own[:-1] & (codes[1:] > 0)]
                pair, times = np.unique(pairs, return_counts=True)
                many = 2 * times >= LEAST_HOT_SHARE * batch.held
                named = [[names[p // len(names)], names[p % len(names)]] for p in pair[many].tolist()]
                phrases = [names[i].decode() for i in seen.tolist()] + [_phrase(p) for p in named]
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(phrases), pa.string()),
                        pa.array(phrases, pa.string()),
                        pa.array(np.concatenate([counts[seen], times[many]]), pa.int64()),
                        pa.array(np.arange(len(phrases)) >= len(seen)),
                    ],
                    names=["lang", "phrase", "n", "named"],
                )

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(stage, schema).groupBy("lang", "phrase", "named").agg(F.sum("n").alias("n"))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _mixed(lang: str, *words: np.ndarray) -> np.ndarray:
    """A hash of the words' hashes."""
    out = np.full(len(words[0]), _hash(lang.encode()), np.uint64)
    for w in words:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class _Known:
    """What every task knows: the most frequent words, whose places are their codes, and the hashes of hot pairs, by rising hash."""

    words: list[bytes]
    hot: np.ndarray
    buckets: int

    def is_hot(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, key), max(0, len(self.hot) - 1))
        return self.hot[at] == key if len(self.hot) else np.zeros(len(key), bool)


_ROUTED = "bucket int, lang string, hot boolean, kind int, data binary"
_RECORD = np.dtype([("words", "<u2", LONGEST), ("n", "<u4")])


def _slices(bucket: np.ndarray, lang: str, hot: bool, kind: int, data: list[bytes]) -> pa.RecordBatch:
    n = len(bucket)
    return pa.record_batch(
        [pa.array(bucket, pa.int32()), pa.array([lang] * n, pa.string()), pa.array([hot] * n, pa.bool_()), pa.array([kind] * n, pa.int32()), pa.array(data, pa.binary())],
        names=["bucket", "lang", "hot", "kind", "data"],
    )


def _routed(docs: DataFrame, known: Broadcast) -> DataFrame:
    """Suffix pointers, cut to LONGEST words, sent to the bucket of their two leading words; equal ones of a batch as one with their number.

    Those of hot pairs go to the bucket of all their words. kind 0: records of codes; kind 1: a line of text for each
    pointer with a word that has no code.
    """

    def stage(rows):
        common = {w: k for k, w in enumerate(known.value.words, 1)}
        common_hash = np.array([0, *map(_hash, known.value.words)], np.uint64)
        n_common, buckets = len(common_hash), known.value.buckets
        for batch in _batches(rows, LONGEST):
            names = list(batch.ids)
            code = np.zeros(len(names), np.int64)
            code[1:] = [common.get(w, 0) for w in names[1:]]
            rare = np.flatnonzero(code == 0)[1:]
            code[rare] = n_common + np.arange(len(rare))
            text = [names[i] for i in rare.tolist()]
            hashes = np.concatenate([common_hash, np.array([_hash(w) for w in text], np.uint64)])
            for lang, codes, own in batch.parts():
                codes = code[codes]
                at = np.flatnonzero(own[:-1] & (codes[1:] > 0))
                third = np.where(at + 2 < len(codes), codes[np.minimum(at + 2, len(codes) - 1)], 0)
                keys, times = np.unique(
                    codes[at].astype(np.uint64) << _BITS * np.uint64(2) | codes[at + 1].astype(np.uint64) << _BITS | third.astype(np.uint64), return_counts=True
                )
                mask = np.uint64((1 << 21) - 1)
                columns = [(keys >> _BITS * np.uint64(2)).astype(np.int64), ((keys >> _BITS) & mask).astype(np.int64), (keys & mask).astype(np.int64)]
                key = _mixed(lang, hashes[columns[0]], hashes[columns[1]])
                is_hot = known.value.is_hot(key)
                key[is_hot] = _mixed(lang, *(hashes[c[is_hot]] for c in columns))
                bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                coded = (columns[0] < n_common) & (columns[1] < n_common) & (columns[2] < n_common)
                for hot in (False, True):
                    for kind in (0, 1):
                        chosen = np.flatnonzero((is_hot == hot) & (coded == (kind == 0)))
                        if not len(chosen):
                            continue
                        chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
                        cuts = np.flatnonzero(np.diff(bucket[chosen], prepend=-1, append=-1))
                        if kind == 0:
                            record = np.empty(len(chosen), _RECORD)
                            for k, c in enumerate(columns):
                                record["words"][:, k] = c[chosen]
                            record["n"] = times[chosen]
                            whole = record.tobytes()
                            data = [whole[a * _RECORD.itemsize : b * _RECORD.itemsize] for a, b in zip(cuts, cuts[1:], strict=False)]
                        else:
                            shown = [b"", *known.value.words, *text]
                            lines = [
                                b"%d %b %b %b" % (n, shown[x], shown[y], shown[z])
                                for x, y, z, n in zip(*(c[chosen].tolist() for c in columns), times[chosen].tolist(), strict=True)
                            ]
                            data = [b"\n".join(lines[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                        yield _slices(bucket[chosen][cuts[:-1]], lang, hot, kind, data)

    return docs.mapInArrow(stage, _ROUTED)


def equal_partitions(columns: list[np.ndarray], weights: np.ndarray, least: int, small: int = SMALL) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, places, sizes): multikey three-way quicksort of the rows of columns, to the depth of all columns.

    Rows are parted by a pivot's word at one depth into lower, equal and higher ones; equal ones go on with the next
    word. What is equal to a depth is a phrase of so many words, and the weights of the partition add up to its count.
    A partition lighter than least is abandoned, as nothing in it can be as heavy. Up to `small` rows are sorted at
    once. Word 0 ends a phrase. places hold one row of each partition.
    """
    deepest = len(columns)
    todo = [(np.arange(len(weights)), 0)]
    while todo:
        rows, depth = todo.pop()
        if weights[rows].sum() < least:
            continue
        if len(rows) <= small:
            rows = rows[np.lexsort([columns[k][rows] for k in range(deepest - 1, depth - 1, -1)])]
            new = np.zeros(len(rows), bool)
            new[0] = True
            shown = np.ones(len(rows), bool)
            for k in range(depth, deepest):
                c = columns[k][rows]
                new[1:] |= c[1:] != c[:-1]
                shown &= c > 0
                first = np.flatnonzero(new)
                sizes = np.add.reduceat(weights[rows], first)
                keep = (sizes >= least) & shown[first]
                yield k + 1, rows[first[keep]], sizes[keep]
            continue
        word = columns[depth][rows]
        pivot = sorted((word[0], word[len(word) // 2], word[-1]))[1]
        equal = rows[word == pivot]
        todo += [(rows[word < pivot], depth), (rows[word > pivot], depth)]
        size = int(weights[equal].sum())
        if pivot > 0 and size >= least:
            yield depth + 1, equal[:1], np.array([size])
            if depth + 1 < deepest:
                todo.append((equal, depth + 1))


def _counted(known: Broadcast, least: int):
    """Counts of the phrases of one bucket: all of at least `least`, and those of hot pairs, which other buckets have a part of, whatever they are."""

    def columns_of(rows: list[tuple[int, bytes]], common: dict[bytes, int], extra: dict[bytes, int]) -> tuple[list[np.ndarray], np.ndarray]:
        parts, weights = [np.empty((0, LONGEST), np.int64)], [np.empty(0, np.int64)]
        for kind, data in rows:
            if kind == 0:
                record = np.frombuffer(data, _RECORD)
                parts.append(record["words"].astype(np.int64))
                weights.append(record["n"].astype(np.int64))
            else:
                fields = [w for line in data.split(b"\n") for w in line.split(b" ")]
                width = LONGEST + 1
                weights.append(np.array(fields[::width], np.int64))
                found = [[common.get(w) or extra.setdefault(w, len(common) + 1 + len(extra)) if w else 0 for w in fields[k::width]] for k in range(1, width)]
                parts.append(np.array(found, np.int64).T)
        whole = np.concatenate(parts)
        return [np.ascontiguousarray(whole[:, k]) for k in range(LONGEST)], np.concatenate(weights)

    def stage(table: pa.Table) -> pa.Table:
        words = known.value.words
        common = {w: k for k, w in enumerate(words, 1)}
        sets: dict[tuple[str, bool], list[tuple[int, bytes]]] = {}
        for lang, hot, kind, data in zip(*(table[c].to_pylist() for c in ("lang", "hot", "kind", "data")), strict=True):
            sets.setdefault((lang, hot), []).append((kind, data))
        out: tuple[list[str], list[str], list[int]] = ([], [], [])
        for (lang, hot), rows in sets.items():
            extra: dict[bytes, int] = {}
            columns, weights = columns_of(rows, common, extra)
            shown = [b"", *words, *extra]
            for depth, places, sizes in equal_partitions(columns, weights, 1 if hot else least):
                if depth > 1:
                    out[0].extend([lang] * len(places))
                    out[1].extend(_phrase([shown[columns[k][p]] for k in range(depth)]) for p in places.tolist())
                    out[2].extend(sizes.tolist())
        return pa.table({"lang": pa.array(out[0], pa.string()), "phrase": pa.array(out[1], pa.string()), "n": pa.array(out[2], pa.int64())})

    return stage


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of one to LONGEST words with f >= least, (lang, n) with the number of words).

    A first pass counts words, and names pairs that are frequent in a batch; what of these is frequent in all is hot.
    A second sends each suffix pointer to the bucket of its two leading words (of hot pairs: of all words), where the
    pointers are sorted. The number of buckets follows the number of words, so that a task keeps its size.
    """
    docs = docs.select(F.coalesce(lang, F.lit("und")).cast("string").alias("lang"), F.col(text).alias("text"))
    spark = docs.sparkSession
    lead = written(_leading(docs, LONGEST))
    sizes = lead.where("not named").groupBy("lang").agg(F.sum("n").alias("n"))
    total = lead.where("not named").agg(F.sum("n")).first()[0] or 0
    buckets = max(4, -(-total // BUCKET_WORDS))
    top = lead.where(~F.col("named") & (F.octet_length("phrase") <= LONGEST_CODED)).orderBy(F.col("n").desc(), "phrase", "lang").limit(CODES).select("phrase").toArrow()
    words = list(dict.fromkeys(w.encode() for w in top["phrase"].to_pylist()))
    share = max(1 / (4 * buckets), LEAST_HOT_SHARE)
    pairs = lead.where(F.col("named") & (F.col("n") * 2 >= share * total)).select("lang", "phrase").collect()
    hot = [_mixed(r.lang, *(np.array([_hash(w)], np.uint64) for w in r.phrase.encode().split(b" ")))[0] for r in pairs]
    known = spark.sparkContext.broadcast(_Known(words, np.unique(np.array(hot, np.uint64)), buckets))
    routed = _routed(docs, known).repartitionById(buckets, F.col("bucket"))
    found = routed.groupBy("bucket").applyInArrow(_counted(known, least), "lang string, phrase string, n long")
    longer = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    single = lead.where("not named").select("lang", "phrase", F.col("n").alias("f"))
    return single.unionByName(longer).where(F.col("f") >= least), sizes


def _cut(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases of 2 to LONGEST words with the highest scores.

    Texts are cut at .,;:!? and line ends into pieces, and these at spaces and tabs into words, with ASCII letters
    lower-cased. a is how often a phrase stands in pieces, at least `least`. Cut after its first k words, its parts
    stand there l and r times, and the score is floor(1000000 * a * a / (l * r)), exactly; the cut with the lowest
    score counts, of equal ones that with the smallest k. Phrases inside a longer one with at least covered / 100 of
    their occurrences are left out. n is the number of words of the language. Ranks go by score, a (both falling) and
    phrase (bytes, rising).

    Counts are of all texts. A null language is `und`; null, empty and blank texts have no words; repeated rows count
    each; further columns are left out; an empty table gives no rows. Words and phrases of any length are kept whole.
    """
    counts, sizes = phrase_counts(docs, lang, text, least)
    counts = written(counts)
    several = counts.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ", -1)
    n_words = F.size(words)
    inside = (
        several.withColumn("size", F.explode(F.sequence(F.lit(2), n_words)))
        .where(F.col("size") < n_words)
        .withColumn("start", F.explode(F.sequence(F.lit(1), n_words - F.col("size") + 1)))
        .select("lang", _cut(words, F.col("start"), F.col("size")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = several.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1))).select(
        "*", _cut(words, F.lit(1), F.col("k")).alias("first"), _cut(words, F.col("k") + 1, n_words).alias("rest")
    )
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    scored = (
        cuts.join(of("first", "l"), ["lang", "first"])
        .join(of("rest", "r"), ["lang", "rest"])
        .withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")))
        .withColumn("down", wide("l") * wide("r"))
        .withColumn("score", F.expr("up div down"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = scored
    for groups in _GROUPS:
        few = few.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
        few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
