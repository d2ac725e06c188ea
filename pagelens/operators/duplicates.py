"""Exact, near and semantic duplicates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions import text as X
from pagelens.functions import vectors as V
from pagelens.functions.filters import possible
from pagelens.plans.storage import settle

from .clusters import connected_components

PERMUTATIONS = 128
#: Fixed value: addresses of later pages of a series.
PAGINATED = r"(?i)(?:[?&](?:page|paged|pg)=\d+|/page/\d+/?$)"


def is_paginated(url: Column, prev_url: Column | None = None, next_url: Column | None = None) -> Column:
    out = url.rlike(PAGINATED)
    for c in (prev_url, next_url):
        out = out if c is None else out | (F.coalesce(c, F.lit("")) != "")
    return out


def exact_duplicates(pages: DataFrame, key: Column, *by: str, page: str = "url") -> DataFrame:
    """(by.., key_value, url, members) of pages whose key another page of the group has too.

    page is the column that tells pages apart; with another one than the address, several pages of an address count each. The groups are counted first, pre-aggregated; only keys with several pages are joined back.
    """
    rows = pages.select(*by, "url", F.col(page).alias("_page"), key.alias("key_value")).where("key_value is not null and key_value <> ''")
    groups = rows.groupBy(*by, "key_value").agg(F.count_distinct("_page").alias("members")).where("members > 1")
    return rows.drop("_page").join(groups, [*by, "key_value"])


def minhash_signature(shingles: Column, permutations: int = PERMUTATIONS) -> Column:
    """Minima of seeded 64-bit hashes of the shingles; empty for none."""
    minima = [F.array_min(F.transform(shingles, lambda s, k=k: F.xxhash64(s, F.lit(k)))) for k in range(permutations)]
    return F.when(F.size(shingles) > 0, F.array(*minima))


def minhash_rows(rows: DataFrame, id_col: str, text_col: str, n: int = 5, permutations: int = PERMUTATIONS) -> DataFrame:
    """(id, signature): minima per seed over exploded shingles, combined before the shuffle."""
    shingled = rows.select(F.col(id_col).alias("id"), F.explode(X.shingles(F.col(text_col), n)).alias("s"))
    minima = shingled.groupBy("id").agg(*[F.min(F.xxhash64("s", F.lit(k))).alias(f"m{k}") for k in range(permutations)])
    return minima.select("id", F.array(*[f"m{k}" for k in range(permutations)]).alias("signature"))


def _shingle_set(text: Column, n: int = 5) -> Column:
    """The text's shingles (X.shingles) as distinct 64-bit hashes of their words, in one expression; _shingle_sets gives other hashes, with less work."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(many))

    return X.let(X.words(F.lower(text)), runs)


#: Words of a shingle.
_SHINGLE = 5


def _word_hashes(text: Column) -> Column:
    """The words of a text in lower case (X.words), hashed one by one, in their order."""
    return F.transform(X.words(F.lower(text)), lambda w: F.xxhash64(w))


def _shingled(lists: pa.Array, n: int = _SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values): of each list of word hashes the distinct runs of n words as 64-bit hashes, those of one list after those of the other.

    All words are one run where there are fewer than n; a list without words has none.
    """
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    runs = np.where(counts > 0, np.maximum(counts - (n - 1), 1), 0)
    row = np.repeat(np.arange(len(counts)), runs)
    first = np.cumsum(counts) - counts
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + first[row]
    end = (first + counts)[row]
    x = np.full(len(row), 42, np.uint64)
    for k in range(n):
        inside = at + k < end
        x[inside] = (x[inside] ^ words[at[inside] + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(counts)), x[new]


#: Elements that are hashed together: arrays of so many stay in a core's cache, through all permutations.
_CACHED = 1 << 15


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices that end where the lists of the column have _CACHED elements together; a longer list is one by itself."""
    for batch in batches:
        total = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + _CACHED, "right")))
            yield batch.slice(start, end - start)
            start = end


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, x) of texts(id, text): the distinct shingles of a text as hashes."""
    hashed = texts.select("id", _word_hashes(F.col("text")).alias("w"))

    def stage(batches):
        for batch in _small(batches, "w"):
            sizes, values = _shingled(batch.column("w"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))], names=["id", "x"])

    return hashed.mapInArrow(stage, T.StructType([*hashed.select("id").schema, T.StructField("x", T.ArrayType(T.LongType()))]))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float | None) -> DataFrame:
    """pairs(a, b) with the Jaccard similarity of their sets(id, x); with a threshold only those that reach it."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("x").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
    if threshold is not None:
        both = both.where(F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * F.lit(threshold - 1e-9))
    shared = X.let(F.size(F.array_intersect("x", "y")), lambda n: n / (F.size("x") + F.size("y") - n))
    found = both.select("a", "b", F.coalesce(shared, F.lit(0.0)).alias("similarity"))
    return found if threshold is None else found.where(F.col("similarity") >= threshold)


#: Of pairs right at the threshold, so many at most share no band.
MISS = 1e-5
#: Buckets of texts that aren't linked yet are compared pair by pair up to this size; larger ones are banded again by further permutations.
OPEN_BUCKET = 512
_LEVELS = 4


def bands_for(threshold: float, permutations: int = PERMUTATIONS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands under which two sets at the threshold share one with a probability of 1 - miss."""
    for rows in range(permutations, 0, -1):
        if (1 - threshold**rows) ** (permutations // rows) <= miss:
            return permutations // rows, rows
    return permutations, 1


def _band_keys(sets: DataFrame, threshold: float, level: int, words: bool = False) -> DataFrame:
    """sets(.., x, bucket) with keys, n, s0 and s1 in place of x and bucket, from minima of seeded hashes of x, in Arrow batches.

    With words, x holds the hashes of a text's words in their order, and its shingles are the set.

    keys are the buckets of the bands; a row's bucket goes into them, so that what was apart stays apart. n is the size of x,
    s0 and s1 hold one bit of each minimum. A row without elements has no keys.
    """
    bands, rows = bands_for(threshold)
    r = np.random.default_rng(level)
    odd, salt = (r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    kept = [c for c in sets.columns if c not in ("x", "bucket")]

    def stage(batches):
        for batch in _small(batches, "x"):
            lists = batch.column("x")
            if words:
                sizes, values = _shingled(lists)
            else:
                sizes, values = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            some = sizes > 0
            first = np.cumsum(sizes)[some] - sizes[some]
            old = batch.column("bucket").to_numpy(zero_copy_only=False)[some].view(np.uint64)
            new = np.empty((int(some.sum()), bands), np.uint64)
            bits = np.zeros((2, batch.num_rows), np.uint64)
            for band in range(bands):
                key = old + np.uint64(band)
                for k in range(band * rows, (band + 1) * rows):
                    low = np.minimum.reduceat((values ^ salt[k]) * odd[k], first) if len(first) else key
                    bits[k >> 6, some] |= (low * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)) << np.uint64(k & 63)
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (low ^ (low >> np.uint64(32)))
                new[:, band] = key
            ends = np.concatenate([[0], np.cumsum(some) * bands])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(new.reshape(-1).view(np.int64)))
            yield _keyed_batch(batch, kept, keys, sizes, bits)

    return sets.mapInArrow(stage, _keyed_schema(sets, kept))


def _keyed_schema(rows: DataFrame, kept: list[str]) -> T.StructType:
    more = T.StructType().add("keys", T.ArrayType(T.LongType())).add("n", T.IntegerType()).add("s0", T.LongType()).add("s1", T.LongType())
    return T.StructType([*rows.select(*kept).schema, *more])


def _keyed_batch(batch: pa.RecordBatch, kept: list[str], keys: pa.Array, sizes: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    columns = [*(batch.column(c) for c in kept), keys, pa.array(sizes, pa.int32()), *(pa.array(b.view(np.int64)) for b in bits)]
    return pa.RecordBatch.from_arrays(columns, names=[*kept, "keys", "n", "s0", "s1"])


def _bits_apart(bits: int, same: float, sigmas: float = 5.0) -> int:
    """In how many of so many bits, each equal with a probability of same, a pair differs at most, but for one in some millions."""
    return min(bits, math.ceil(bits * (1 - same) + sigmas * math.sqrt(bits * same * (1 - same))))


def _linked_clusters(
    keyed: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    similar: Callable[[DataFrame, DataFrame], DataFrame],
    likely: tuple[float, int],
    band: Callable[[DataFrame, int], DataFrame],
    by: tuple[str, ...],
    open_bucket: int,
) -> DataFrame:
    """(node, cluster) of keyed(by.., id, bucket, n, s0, s1): connected components by so many similar pairs that all which similar pairs connect are connected.

    Of each bucket of a band first the smallest id is held against all others, so a bucket of one template costs a pair
    a member. What these pairs connect needs no further look. In buckets that hold several clusters then, pairs of members
    of different clusters are compared; where that are many, the bucket is banded again first. Pairs whose sizes n have a
    ratio below likely[0], or whose bits s0, s1 differ in more than likely[1], are left out inside the joins. sets_of gives
    the contents of the ends of pairs, all other is never gathered; similar keeps pairs(a, b) that are similar by their
    contents, and band gives contents with a bucket the keys of a level.
    """
    key = [*by, "bucket"]
    links = None
    for level in range(_LEVELS):
        least = F.min(F.struct("id", "n", "s0", "s1")).alias("x")
        center = keyed.groupBy(*key).agg(least, F.count("*").alias("members")).where("members > 1").select(*key, "x.*")
        stars = settle(_met(center, keyed, key, F.col("a.id") < F.col("b.id"), likely))
        if links is None and stars.isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("cluster"))
        found = settle(similar(stars, sets_of(stars)).select("a", "b"))
        links = found if links is None else settle(links.unionByName(found))
        clusters = settle(connected_components(links))
        tagged = keyed.join(clusters.select(F.col("node").alias("id"), "cluster"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
        several = tagged.groupBy(*key).agg(F.count("*").alias("members"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo <> hi").select(*key, "members")
        unsettled = settle(tagged.join(several, key))
        if unsettled.isEmpty():
            return clusters
        last = level == _LEVELS - 1
        few = unsettled if last else unsettled.where(F.col("members") <= open_bucket)
        crossing = settle(_met(few, few, key, F.col("a.cluster") < F.col("b.cluster"), likely))
        links = links.unionByName(similar(crossing, sets_of(crossing)).select("a", "b"))
        many = unsettled.where(F.col("members") > open_bucket).select(*key, "id")
        if last or many.isEmpty():
            break
        own = sets_of(many.select(F.col("id").alias("a"), F.col("id").alias("b")))
        keyed = settle(band(many.join(own, "id"), level + 1).select(*by, "id", "n", "s0", "s1", F.explode("keys").alias("bucket")))
    return settle(connected_components(settle(links)))


def near_duplicate_clusters(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.9, by: tuple[str, ...] = (), open_bucket: int = OPEN_BUCKET) -> DataFrame:
    """(by.., id, cluster, members, similarity) of rows whose text is like another one's: a row a text, whatever the size of a group.

    Texts are linked if their shingle sets reach the threshold, which the sets decide; cluster is the smallest id that
    links reach, members how many rows that are. similarity is that with the text of the cluster's smallest id (which a chain
    of links may bring below the threshold), and for that row itself the largest of the others. Candidates come from
    bands of MinHash values (bands_for: a pair at the threshold shares none with a probability of 1e-5). Equal texts are
    one class and compared once. With by, only rows equal in these columns are linked. ids must be unique within by; null and
    empty texts are left out; an empty table gives no rows.

    Texts are read twice, once for their bands, once for the sets of those that share a bucket, and never shuffled.
    """
    node = F.struct(*by, F.col(id_col).alias("id")) if by else F.col(id_col)
    signed, sets_of, likely = _banded(rows.select(*by, node.alias("id"), F.col(text_col).alias("text")), threshold)
    classes, keyed = _classes(signed, by)
    found = _linked_clusters(keyed, sets_of, lambda pairs, sets: _similar(pairs, sets, threshold), likely, lambda rows, level: _band_keys(rows, threshold, level), by, open_bucket)
    return _members(signed.select(*by, "id", "h"), classes, found, lambda pairs: _similar(pairs, sets_of(pairs), None), by)


def near_duplicate_pairs(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.9, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, similarity) with a < b: texts whose shingle similarity reaches the threshold.

    Equal texts are tied to the smallest id with similarity 1, so copies cost a pair each. Of distinct texts those that share a
    bucket of MinHash bands are candidates (bands_for: a pair at the threshold shares none with a probability of 1e-5), and
    their sets decide. With by, only rows equal in these columns are paired. Texts are read twice and never shuffled. All
    pairs of a group of n similar texts come out, n (n - 1) / 2 of them; near_duplicate_clusters gives a row a text instead.
    """
    signed, sets_of, likely = _banded(rows.select(*by, F.col(id_col).alias("id"), F.col(text_col).alias("text")), threshold)
    classes, keyed = _classes(signed, by)
    candidates = settle(_met(keyed, keyed, [*by, "bucket"], F.col("a.id") < F.col("b.id"), likely))
    near = _similar(candidates, sets_of(candidates), threshold)
    copies = signed.select(*by, "id", "h").join(classes.select(*by, "h", F.col("id").alias("a")), [*by, "h"]).where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.unionByName(copies)


def _banded(texts: DataFrame, threshold: float) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], tuple[float, int]]:
    """(texts(by.., id, text) with their class h and band keys in place of the text; what gives the sets of the ends of pairs; what pairs at the threshold have in common)."""
    base = texts.where("text is not null and text <> ''")
    own = [c for c in base.columns if c != "text"]
    signed = settle(_band_keys(base.select(*own, F.md5("text").alias("h"), F.lit(0).cast("long").alias("bucket"), _word_hashes(F.col("text")).alias("x")), threshold, 0, words=True))

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = _ends(pairs)
        return settle(_shingle_sets(possible(base, wanted, "id").join(wanted, "id", "left_semi").select("id", "text")))

    bands, rows_of = bands_for(threshold)
    return signed, sets_of, (threshold, _bits_apart(bands * rows_of, (1 + threshold) / 2))


def _met(left: DataFrame, right: DataFrame, key: list[str], further: Column, likely: tuple[float, int]) -> DataFrame:
    """(a, b), each once, of left and right(key.., id, n, s0, s1) under equal keys, but for pairs whose sizes n have a ratio below likely[0] or whose bits s0, s1 differ in more than likely[1]."""
    on = further & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(likely[0] - 1e-9))
    on = on & (F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) <= likely[1])
    for c in key:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return left.alias("a").join(right.alias("b"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _classes(signed: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """((by.., h, id) of classes of equal contents with their smallest id, (by.., id, n, s0, s1, bucket) of these for each band)."""
    alike = F.first(F.struct("keys", "n", "s0", "s1")).alias("x")
    classes = settle(signed.groupBy(*by, "h").agg(F.min("id").alias("id"), alike).select(*by, "h", "id", "x.*"))
    return classes.select(*by, "h", "id"), classes.select(*by, "id", "n", "s0", "s1", F.explode("keys").alias("bucket"))


def _members(rows: DataFrame, classes: DataFrame, found: DataFrame, like: Callable[[DataFrame], DataFrame], by: tuple[str, ...]) -> DataFrame:
    """(by.., id, cluster, members, similarity) of rows(by.., id, h) whose class in classes(by.., h, id) is in a cluster of found(node, cluster), or that share it; like gives pairs(a, b) their similarity."""
    labelled = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    apart = labelled.where("id <> cluster").select(F.col("cluster").alias("a"), F.col("id").alias("b"))
    labelled = labelled.join(like(apart).select(F.col("b").alias("id"), "similarity"), "id", "left").select(*by, "h", F.col("id").alias("rep"), "cluster", "similarity")
    members = settle(rows.join(labelled, [*by, "h"]).drop("h"))
    sizes = members.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.max(F.when(F.col("id") != F.col("cluster"), F.when(F.col("rep") == F.col("cluster"), 1.0).otherwise(F.col("similarity")))).alias("largest"),
    )
    own = F.when(F.col("id") == F.col("cluster"), F.col("largest")).when(F.col("rep") == F.col("cluster"), 1.0).otherwise(F.col("similarity"))
    out = members.join(sizes.where("members > 1"), "cluster")
    plain = (lambda c: F.col(c)["id"]) if by else F.col
    return out.select(*by, plain("id").alias("id"), plain("cluster").alias("cluster"), "members", own.alias("similarity"))


def near_dup_label(signature: Column) -> Column:
    """The first four minima as hexadecimal digits."""
    return F.array_join(F.transform(F.slice(signature, 1, 4), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


#: Vectors of one block at least; a task compares one block with another.
BLOCK_VECTORS = 4096
#: A group has no more blocks than this, so what is sent grows with the vectors alone, until a block would be larger than BLOCK_BYTES.
MOST_BLOCKS = 8
BLOCK_BYTES = 64 << 20
#: Inside a task so many rows are held against so many others at a time.
_SLICE = 256
_PIECE = 4096


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, by: tuple[str, ...], block: int) -> DataFrame:
    """Vectors under every pair of blocks (i, j), i <= j, that their own belongs to; side says as which of them. A vector is sent once for each block of its group."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(*by, F.col(id_col).alias("id"), vector.alias("v")).where(F.size("v") > 0)
    needed = F.ceil(F.count("*") * F.size("v") * 8 / BLOCK_BYTES)
    sizes = rows.groupBy(*by, F.size("v").alias("d")).agg(F.least(F.ceil(F.count("*") / block), F.greatest(F.lit(MOST_BLOCKS), needed)).cast("int").alias("n"))
    # sizes has a row a group; a join that shuffles would bring a whole group, and all its blocks after it, into one task
    rows = rows.withColumn("d", F.size("v")).join(F.broadcast(sizes), [*by, "d"]).withColumn("own", F.pmod(F.xxhash64("id"), "n").cast("int"))
    other = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keyed = other.select(*by, "d", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "id", "v", F.when(F.col("own") <= F.col("k"), 0).otherwise(1).alias("side"))
    # by number, as pairs of blocks are little data and much work, which mustn't be put together
    return keyed.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "d", "i", "j")


def _sides(table: pa.Table) -> tuple:
    """Ids and unit vectors of both sides, with the vectors themselves and their lengths; of a block with itself it is one side twice."""
    out = []
    for side in (0,) if table["i"][0].as_py() == table["j"][0].as_py() else (0, 1):
        part = table.filter(pc.equal(table["side"], side))
        ids = part["id"].to_numpy()
        x = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1) if len(part) else np.empty((0, 1))
        order = np.argsort(ids, kind="stable")
        x = x[order]
        length = np.empty(len(x))
        for k in range(0, len(x), _PIECE):
            length[k : k + _PIECE] = np.sqrt(np.add.accumulate(x[k : k + _PIECE] ** 2, axis=1)[:, -1])
        out.append((ids[order], x, length, x / np.where(length > 0, length, 1)[:, None]))
    return out[0], out[-1]


def _pieces(u: np.ndarray, v: np.ndarray, above: bool = False):
    """(k, l, product): the cosines of unit vectors u and v, a piece at a time, from row k and column l; with above, none that are wholly below the diagonal."""
    for k in range(0, len(u), _SLICE):
        for l in range(k // _PIECE * _PIECE if above else 0, len(v), _PIECE):  # noqa: E741
            yield k, l, u[k : k + _SLICE] @ v[l : l + _PIECE].T


def _cosines(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Row by row, summed from left to right as the column expression does; 0 for vectors of length 0."""
    norm = nx * ny
    return np.where(norm > 0, np.add.accumulate(x * y, axis=1)[:, -1] / np.where(norm > 0, norm, 1), 0.0)


def semantic_pairs(vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.92, by: tuple[str, ...] = (), block: int = BLOCK_VECTORS) -> DataFrame:
    """(by.., a, b, similarity) with a < b and a cosine of at least the threshold, all of them.

    Exact: the vectors of a group (a crawl) are dealt into blocks, and each pair of blocks is one matrix
    product in a task, piece by piece, of which only the pairs that reach the threshold come out. A vector is sent once
    for each block of its own group, which are MOST_BLOCKS at most as long as these stay below BLOCK_BYTES. Vectors of different sizes have cosine 0 and are not compared; empty
    and null ones are left out; equal ids are not compared with each other.
    """
    schema = vectors.select(*by, F.col(id_col).alias("a"), F.col(id_col).alias("b"), F.lit(0.0).alias("similarity")).schema

    def task(table: pa.Table) -> pa.Table:
        (ids, x, nx, ux), (others, y, ny, uy) = _sides(table)
        same = table["i"][0].as_py() == table["j"][0].as_py()
        found = []
        for k, l, product in _pieces(ux, uy, same):  # noqa: E741
            row, col = np.nonzero(product >= threshold - 1e-9)
            row, col = row + k, col + l
            keep = ids[row] < others[col] if same else ids[row] != others[col]
            row, col = row[keep], col[keep]
            cos = _cosines(x[row], nx[row], y[col], ny[col])
            found.append((ids[row][cos >= threshold], others[col][cos >= threshold], cos[cos >= threshold]))
        a, b, cos = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (ids[:0], others[:0], np.empty(0))
        group = {c: pa.array([table[c][0].as_py()] * len(a), table.schema.field(c).type) for c in by}
        return pa.table({**group, "a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": cos})

    return _blocks(vectors, id_col, vector_col, by, block).groupBy(*by, "d", "i", "j").applyInArrow(task, schema)


#: Bands of hyperplanes a vector has at most, and how many pairs right at the threshold share none at most.
_MOST_BANDS = 64
_MISS_PLANES = 1e-4


def planes_for(threshold: float, miss: float = _MISS_PLANES) -> tuple[int, int]:
    """(bands, bits): the most bits of a band under which vectors at the threshold share one of at most 64 bands with a probability of 1 - miss."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    for bits in range(30, 0, -1):
        share = same**bits
        bands = 1 if share >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - share)) if share > 0 else _MOST_BANDS + 1
        if bands <= _MOST_BANDS:
            return bands, bits
    return _MOST_BANDS, 1


def _plane_keys(vectors: DataFrame, threshold: float, level: int) -> DataFrame:
    """vectors(.., v, bucket) with keys, n, s0 and s1 in place of v and bucket, in Arrow batches: on which sides of random hyperplanes v lies, by band, and for the first 128 of them as bits."""
    bands, bits = planes_for(threshold)
    kept = [c for c in vectors.columns if c not in ("v", "bucket")]
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def stage(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            old = batch.column("bucket").to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.empty((batch.num_rows, bands), np.uint64)
            first = np.zeros((2, batch.num_rows), np.uint64)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([level, d]).standard_normal((d, bands * bits))
                x = flat[starts[rows][:, None] + np.arange(d)]
                side = x @ planes[d] >= 0
                for k in range(min(128, bands * bits)):
                    first[k >> 6, rows] |= side[:, k].astype(np.uint64) << np.uint64(k & 63)
                side = side.reshape(len(rows), bands, bits)
                key = (side * weights).sum(axis=2, dtype=np.uint64) << np.uint64(8) | np.arange(bands, dtype=np.uint64)
                key = (key ^ old[rows][:, None]) * np.uint64(0x9E3779B97F4A7C15)
                new[rows] = key ^ (key >> np.uint64(31))
            ends = np.arange(batch.num_rows + 1) * bands
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(new.reshape(-1).view(np.int64)))
            yield _keyed_batch(batch, kept, keys, sizes, first)

    return vectors.mapInArrow(stage, _keyed_schema(vectors, kept))


def semantic_clusters(vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.92, by: tuple[str, ...] = (), open_bucket: int = OPEN_BUCKET) -> DataFrame:
    """(by.., id, cluster, members, similarity) of vectors that are like another one: a row a vector, whatever the size of a group.

    Vectors are linked if their cosine reaches the threshold, which the vectors decide; cluster, members and similarity
    are those of near_duplicate_clusters. Candidates share a bucket of random hyperplanes (planes_for: a pair at the
    threshold shares none with a probability of 1e-4, a nearer one with less). A vector goes under its keys, at most 64 of
    them, however many vectors there are; only vectors that share a bucket are gathered. Equal vectors are one class. Vectors of
    different sizes are not compared; null and empty ones, those of length 0 and those with null or non-finite components
    are left out; ids must be unique within by; an empty table gives no rows. semantic_pairs gives all pairs instead.
    """
    node = F.struct(*by, F.col(id_col).alias("id")) if by else F.col(id_col)
    base = vectors.select(*by, node.alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    signed = settle(_plane_keys(base.select(*by, "id", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), " ")).alias("h"), "v", F.lit(0).cast("long").alias("bucket")), threshold, 0))
    classes, keyed = _classes(signed, by)

    def vectors_of(pairs: DataFrame) -> DataFrame:
        wanted = _ends(pairs)
        return settle(possible(base, wanted, "id").join(wanted, "id", "left_semi").select("id", "v"))

    def like(pairs: DataFrame, found: DataFrame) -> DataFrame:
        both = pairs.join(found.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
        return both.where(F.size("x") == F.size("y")).select("a", "b", V.cosine(F.col("x"), F.col("y")).alias("similarity"))

    bands, bits = planes_for(threshold)
    likely = (1.0, _bits_apart(min(128, bands * bits), 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi))
    similar = lambda pairs, found: like(pairs, found).where(F.col("similarity") >= threshold)
    found = _linked_clusters(keyed, vectors_of, similar, likely, lambda rows, level: _plane_keys(rows, threshold, level), by, open_bucket)
    return _members(signed.select(*by, "id", "h"), classes, found, lambda pairs: like(pairs, vectors_of(pairs)), by)


def low_relevance(vectors: DataFrame, id_col: str, vector_col: str, threshold: float = 0.6, by: tuple[str, ...] = (), block: int = BLOCK_VECTORS) -> DataFrame:
    """(by.., id, max_similarity) of vectors whose nearest other one of the group is below the threshold; 0 where there is no other.

    By the same products of blocks; each gives a row's largest cosine, and the largest of all counts.
    """
    schema = vectors.select(*by, F.col(id_col).alias("id"), F.lit(0.0).alias("near")).schema

    def task(table: pa.Table) -> pa.Table:
        (ids, x, nx, ux), (others, y, ny, uy) = _sides(table)
        same = table["i"][0].as_py() == table["j"][0].as_py()
        best, best_other = np.full(len(ids), -np.inf), np.full(len(others), -np.inf)
        for k, l, rough in _pieces(ux, uy):  # noqa: E741
            rough[ids[k : k + _SLICE, None] == others[None, l : l + _PIECE]] = -np.inf
            near = rough >= rough.max(axis=1)[:, None] - 1e-9
            if not same:
                near |= rough >= rough.max(axis=0) - 1e-9
            row, col = np.nonzero(near & (rough > -np.inf))
            row, col = row + k, col + l
            cos = _cosines(x[row], nx[row], y[col], ny[col])
            np.maximum.at(best, row, cos)
            if not same:
                np.maximum.at(best_other, col, cos)
        sides = [(ids, best)] if same else [(ids, best), (others, best_other)]
        found, near = (np.concatenate([s[n] for s in sides]) for n in (0, 1))
        found, near = found[near > -np.inf], near[near > -np.inf]
        group = {c: pa.array([table[c][0].as_py()] * len(found), table.schema.field(c).type) for c in by}
        return pa.table({**group, "id": found, "near": near})

    nearest = _blocks(vectors, id_col, vector_col, by, block).groupBy(*by, "d", "i", "j").applyInArrow(task, schema).groupBy(*by, "id").agg(F.max("near").alias("near"))
    all_ids = vectors.where(F.size(vector_col) > 0).select(*by, F.col(id_col).alias("id")).distinct()
    return all_ids.join(nearest, [*by, "id"], "left").select(*by, "id", F.coalesce("near", F.lit(0.0)).alias("max_similarity")).where(F.col("max_similarity") < threshold)


def similar_report(pairs: DataFrame, n: int = 200) -> DataFrame:
    """The n most similar pairs, rounded as shown."""
    return pairs.orderBy(F.col("similarity").desc(), "a", "b").limit(n).withColumn("similarity", F.bround("similarity", 4))


def low_relevance_report(rows: DataFrame, n: int = 200) -> DataFrame:
    """The n pages that are furthest from all others, rounded as shown."""
    return rows.orderBy("max_similarity", "id").limit(n).withColumn("max_similarity", F.bround("max_similarity", 4))


def duplicate_members(pages: DataFrame, key: Column, *by: str) -> DataFrame:
    """(by.., key_value, url, representative): the classes of pages that share a key and who is in them, a row for each page; the others of a page are the rows of its class."""
    rows = pages.select(*by, "url", key.alias("key_value")).where("key_value is not null and key_value <> ''").distinct()
    groups = rows.groupBy(*by, "key_value").agg(F.count("*").alias("n"), F.min("url").alias("representative")).where("n > 1").drop("n")
    return rows.join(groups, [*by, "key_value"])
