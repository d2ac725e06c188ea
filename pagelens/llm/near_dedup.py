"""SimHash near-duplicates, found through deletion-variant signatures."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, utf8
from .components import connected_components
from .simhash_kernel import SHINGLE_WORDS, fingerprint
from .storage import written

MAX_DISTANCE = 3
#: Signature buckets with more fingerprints than this are split by pieces of the other half instead of compared pair by pair.
HOT_BUCKET = 512
_HALF = 32


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long) per row. Null and blank texts get fingerprint zero; null ids stay as they are."""

    def stage(batches):
        for batch in batches:
            yield pa.record_batch(
                [batch.column("id"), pa.array([fingerprint(t, n_words) for t in utf8(batch)], pa.int64())], names=["id", "fp"]
            )

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), stage, "id long, fp long")


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, _HALF * segment).bitwiseAND(F.lit(0xFFFFFFFF))


def _signatures(fps: DataFrame) -> DataFrame:
    """Each fingerprint under 2 x 33 keys: each half as it is (wild 32), and with one bit wild.

    Three differing bits leave one half with at most one of them, so two linked fingerprints share
    the key of an equal half, or that of a half with the differing bit wild. side is that bit.
    """
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("segment")).withColumn(
        "half", F.when(F.col("segment") == 0, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1))
    )
    wild = halves.select("fp", "segment", "half", F.explode(F.sequence(F.lit(0), F.lit(_HALF))).alias("wild"))
    bit = F.when(F.col("wild") < _HALF, F.expr("shiftleft(1L, wild)")).otherwise(F.lit(0))
    return wild.select(
        "fp",
        F.expr("shiftleft(cast(segment * 64 + wild as bigint), 32)").bitwiseOR(F.col("half").bitwiseAND(F.bitwise_not(bit))).alias("key"),
        F.col("half").bitwiseAND(bit).alias("side"),
    )


#: What is equal in the other half: of four pieces one if three bits differ there, of three pieces one if two do.
_PIECES = {True: (0, 8, 16, 24, 32), False: (0, 11, 22, 32)}


def _pieces(hot: DataFrame) -> DataFrame:
    """The members of large buckets under (key, piece), by the pieces of their other half of which one must be equal; rest is what the piece leaves of it."""

    def of(equal: bool) -> Column:
        cuts = list(zip(_PIECES[equal], _PIECES[equal][1:], strict=False))
        masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in cuts]
        return F.array(*[F.struct(F.lit(k).alias("at"), F.col("other").bitwiseAND(F.lit(m)).alias("value"), F.col("other").bitwiseAND(F.lit(0xFFFFFFFF ^ m)).alias("rest")) for k, m in enumerate(masks)])

    other = F.when(F.expr("shiftrightunsigned(key, 38) = 1"), _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1))
    rows = hot.withColumn("other", other).select("key", "fp", "side", "equal", F.inline(F.when(F.col("equal"), of(True)).otherwise(of(False))))
    return rows.withColumn("piece", F.col("at") * F.lit(1 << 32) + F.col("value"))


def _sized(rows: DataFrame, *by: str) -> DataFrame:
    """rows under keys that others have too, with the number of members; counted before the shuffle, and a hot key's rows can be split by the join."""
    return written(rows.join(rows.groupBy(*by).agg(F.count("*").alias("members")).where("members > 1"), [*by]))


def _compared(rows: DataFrame, *by: str) -> DataFrame:
    """Pairs under one key whose fingerprints are near; of a key with a wild bit only those that differ in it, as the others share the key of the equal half."""
    left = rows.select(*by, F.col("fp").alias("a"), F.col("side").alias("a_side"), "equal")
    right = rows.select(*by, F.col("fp").alias("b"), F.col("side").alias("b_side"))
    once = (F.col("equal") & (F.col("a") < F.col("b"))) | (~F.col("equal") & (F.col("a_side") < F.col("b_side")))
    return left.join(right, [*by]).where(once & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)).select("a", "b")


def _stars(hot: DataFrame) -> DataFrame:
    """Links under large (key, piece), as many as there are members: with three bits wild in all, those under one key are linked, so each is tied to the smallest."""
    bits = lambda equal, k: [x for x in range(32) if not _PIECES[equal][k] <= x < _PIECES[equal][k + 1]]
    threes = [(True, k, 1 << x | 1 << y | 1 << z) for k in range(4) for x in bits(True, k) for y in bits(True, k) if y < x for z in bits(True, k) if z < y]
    twos = [(False, k, 1 << x | 1 << y) for k in range(3) for x in bits(False, k) for y in bits(False, k) if y < x]
    masks = hot.sparkSession.createDataFrame(threes + twos, "equal boolean, at int, mask long")
    keyed = hot.join(F.broadcast(masks), ["equal", "at"]).select("key", "piece", "fp", "mask", F.col("rest").bitwiseAND(F.bitwise_not(F.col("mask"))).alias("left"))
    by = ["key", "piece", "mask", "left"]
    least = keyed.groupBy(*by).agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(least, by).where("fp <> a").select("a", F.col("fp").alias("b"))


def _bucket_links(rows: DataFrame, hot_bucket: int) -> DataFrame:
    """Links under each key of rows(key, fp, side, equal): small buckets pair by pair, large ones by pieces, and what is large even then by stars."""
    sized = _sized(rows, "key")
    large = sized.where(F.col("members") > hot_bucket).drop("members")
    pieces = _sized(_pieces(large), "key", "piece")
    return (
        _compared(sized.where(F.col("members") <= hot_bucket), "key")
        .unionByName(_compared(pieces.where(F.col("members") <= hot_bucket), "key", "piece"))
        .unionByName(_stars(pieces.where(F.col("members") > hot_bucket)))
        .distinct()
    )


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b) pairs of distinct fingerprints of fps(fp) at three or fewer differing bits.

    Equality joins on signatures, then a check of all 64 bits. First the pairs with an equal half; then,
    with one bit of a half wild, the rest, where buckets whose members those have already connected are
    left out. So not every pair comes back, but enough that connected fingerprints stay connected.
    """
    rows = _signatures(fps).withColumn("equal", F.expr("shiftrightunsigned(key, 32) & 63 = 32"))
    first = written(_bucket_links(rows.where("equal"), hot_bucket))
    parts = written(connected_components(first).select(F.col("node").alias("fp"), "component"))
    wild = rows.where("not equal").join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    open_keys = wild.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    return first.unionByName(_bucket_links(wild.join(open_keys, "key", "left_semi").drop("component"), hot_bucket))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) per row of docs.

    Texts are cut into n_words-word shingles (ASCII letters lower-cased); fingerprints with three
    or fewer differing bits are linked; component_id is the smallest id reachable. Copies share a
    fingerprint and are not paired with each other. Null, empty and blank texts have fingerprint
    zero and are linked like any other; repeated rows and ties keep one row each; a null id has
    component null unless another row of its component has an id. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, n_words))
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    found = links(classes.select("fp"), hot_bucket)
    members = connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    least = members.join(classes, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    moved = members.join(least, "root").select("fp", "least")
    labelled = written(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return fps.join(labelled, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest id.

    Rows with a null id are kept; of rows that share the kept id, one with the smallest text hash stays.
    """
    groups = near_duplicates(docs, id_col, text_col, n_words)
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    ids = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi")
    one = ids.dropDuplicates([id_col]).select(docs.columns)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
