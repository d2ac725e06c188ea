"""Near copies by the exact Jaccard similarity of word shingles; candidates from SimHash fingerprints and min-hash bands."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, utf8
from .components import connected_components
from .near_dedup import links
from .simhash_kernel import fingerprint_of, shingle_hashes
from .storage import written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Two sets of similarity s agree in one of the bands with probability 1 - (1 - s^BAND_ROWS)^BANDS: 0.9993 at 0.8.
BANDS, BAND_ROWS = 24, 6
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 2048
_WORDS = 8
_BITS = [f"b{k}" for k in range(_WORDS)]


def lowered(text: bytes) -> bytes:
    return text.decode(errors="replace").lower().encode()


def shingle_set(text: bytes, n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in lower case; none for a blank one."""
    return np.unique(shingle_hashes(lowered(text), n_words))


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys, each of BAND_ROWS minima over the set; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[i : i + _CHUNK, None] * _FACTORS).min(axis=0))
    bands = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bands)]


def _class_id(hashes: np.ndarray) -> int:
    return int.from_bytes(blake2b(hashes.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 512 remainders, set if an odd number of hashes has it: sets that differ in d hashes differ in d bits at most."""
    odd = np.bincount((hashes & np.uint64(64 * _WORDS - 1)).astype(np.int64), minlength=64 * _WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _rows(rows: DataFrame, n_words: int) -> DataFrame:
    """(id, cls, n, fp, keys, b0..b7): the class of equal shingle sets, its size, SimHash, band keys and parities."""

    def stage(batches):
        for batch in batches:
            all_hashes = [shingle_hashes(lowered(t), n_words) for t in utf8(batch)]
            sets = [np.unique(h) for h in all_hashes]
            bits = np.array([_parity(h) for h in sets]).reshape(-1, _WORDS)
            columns = [
                batch.column("id"), pa.array(map(_class_id, sets), pa.int64()), pa.array(map(len, sets), pa.int32()),
                pa.array(map(fingerprint_of, all_hashes), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns + [pa.array(bits[:, k], pa.int64()) for k in range(_WORDS)], names=["id", "cls", "n", "fp", "keys", *_BITS])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, stage, f"id {kind}, cls long, n int, fp long, keys array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _near(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether the sizes and parities of two sets, with columns named after x and y, allow the similarity."""
    differ = sum((F.bit_count(F.col(f"{x}_{b}").bitwiseXOR(F.col(f"{y}_{b}"))) for b in _BITS), F.lit(0))
    most = (F.col(f"n_{x}") + F.col(f"n_{y}")) * F.lit((1 - similarity) / (1 + similarity) + 1e-9)
    return (differ <= most) & _near(F.col(f"n_{x}"), F.col(f"n_{y}"), similarity)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _checked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, similarity: float, n_words: int) -> DataFrame:
    """The pairs(a, b) that reach the similarity: those whose sizes and parities allow it are compared shingle by shingle."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("rep").alias(f"rep_{x}"), *[F.col(b).alias(f"{x}_{b}") for b in _BITS])
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(_possible("a", "b", similarity))
    left = written(likely.select("a", "b", "rep_a", "rep_b"))
    wanted = left.select(F.col("rep_a").alias("id"), F.col("a").alias("cls")).unionByName(left.select(F.col("rep_b").alias("id"), F.col("b").alias("cls"))).distinct()

    def named(batches):
        for batch in batches:
            found = [_class_id(shingle_set(t, n_words)) for t in utf8(batch)]
            yield pa.record_batch([pa.array(found, pa.int64()), batch.column("text")], names=["cls", "text"])

    known = map_batches(texts.join(wanted.select("id").distinct(), "id", "left_semi").select("text"), named, "cls long, text string")
    known = written(known.join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]))
    both = left.join(known.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").join(known.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")

    def compared(batches):
        sets = lru_cache(64)(lambda t: shingle_set(t, n_words))
        for batch in batches:
            good = []
            for x, y in zip(utf8(batch, "x"), utf8(batch, "y"), strict=True):
                p, q = sets(x), sets(y)
                same = len(np.intersect1d(p, q, assume_unique=True))
                good.append(same >= (similarity - 1e-9) * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written(map_batches(both.select("a", "b", "x", "y"), compared, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, component_id) per row of docs with an id: component_id is the smallest id that links reach.

    Texts are linked if the Jaccard similarity of their sets of n_words-word shingles reaches the
    threshold. Equal sets form a class (null and blank texts one of their own), so copies aren't paired.
    Classes are compared if their SimHash fingerprints differ in three bits or fewer (near_dedup.links), or
    if a min-hash band key is the same. Of the classes under one key the one that shares most keys with
    others is the centre, and each is compared with it; then those that are not yet connected are held
    against the others under the key by sizes and parities of 512 bits (an exact bound), and what these let
    pass is compared, so a large group of near copies costs a comparison for each member.
    Every compared pair is decided by the sets themselves; a pair of similarity 0.8 is compared with
    probability 0.9993 (BANDS), one of 0.85 with 0.99999. Rows with a null id are left out; repeated rows
    and ties fall into one class; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    rows = written(_rows(base, n_words))
    first = [F.first(c).alias(c) for c in ("n", "fp", "keys", *_BITS)]
    classes = written(rows.groupBy("cls").agg(F.min("id").alias("rep"), *first))
    keyed = classes.select("cls", "n", F.explode("keys").alias("k"))
    shared = written(keyed.join(keyed.groupBy("k").agg(F.count("*").alias("m")).where("m > 1"), "k"))
    weights = shared.groupBy("cls").agg(F.sum("m").alias("w"))
    centre = shared.join(weights, "cls").groupBy("k").agg(F.max(F.struct("w", F.col("cls").alias("a"), F.col("n").alias("n_a"))).alias("c")).select("k", "c.a", "c.n_a")
    stars = shared.join(centre, "k").where((F.col("a") != F.col("cls")) & _near(F.col("n_a"), F.col("n"), similarity)).select("a", F.col("cls").alias("b"))
    of_fp = classes.groupBy("fp").agg(F.min("cls").alias("c"))
    same_fp = classes.join(of_fp, "fp").select(F.col("c").alias("a"), F.col("cls").alias("b"))
    close = links(of_fp.select("fp")).join(of_fp.select(F.col("fp").alias("a"), F.col("c").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("c").alias("y")), "b")
    tried = written(_pairs(stars.unionByName(same_fp).unionByName(close.select(F.col("x").alias("a"), F.col("y").alias("b")))))
    found = _checked(tried, classes, base, similarity, n_words)
    parts = written(connected_components(found))
    labelled = written(shared.join(parts.select(F.col("node").alias("cls"), "component"), "cls", "left").select("k", "cls", "n", F.coalesce("component", "cls").alias("part")))
    sizes = labelled.groupBy("k", "part").agg(F.count("*").alias("m"))
    main = sizes.groupBy("k").agg(F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("k", F.col("top.part").alias("main"))
    open_keys = written(labelled.join(main, "k").join(classes.select("cls", *_BITS), "cls"))
    side = lambda x: [F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("part").alias(f"p_{x}"), *[F.col(b).alias(f"{x}_{b}") for b in _BITS]]
    rest = open_keys.where("part <> main").select("k", *side("x"))
    other = open_keys.select("k", *side("y"), (F.col("part") == F.col("main")).alias("in_main"))
    met = rest.join(other, "k").where((F.col("p_x") != F.col("p_y")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & _possible("x", "y", similarity))
    more = _pairs(met.select(F.col("x").alias("a"), F.col("y").alias("b"))).join(tried, ["a", "b"], "left_anti")
    extra = _checked(written(more), classes, base, similarity, n_words)
    part_of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"p_{x}"))
    between = extra.join(part_of("a"), "a", "left").join(part_of("b"), "b", "left").select(F.coalesce("p_a", "a").alias("a"), F.coalesce("p_b", "b").alias("b"))
    joined = connected_components(between).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    named = classes.select("cls", "rep").join(part_of("cls"), "cls", "left").withColumn("part", F.coalesce("p_cls", "cls"))
    named = written(named.join(joined, "part", "left").select("cls", "rep", F.coalesce("whole", "part").alias("root")))
    labels = written(named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("cls", "component_id"))
    return rows.select("id", "cls").join(labels, "cls").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n_words: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest id.

    Rows with a null id are kept and link nothing; of rows that share the kept id, one stays.
    """
    groups = near_copies(docs, id_col, text_col, similarity, n_words)
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    one = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
