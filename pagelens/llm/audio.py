"""Chroma fingerprints of recordings, and their alignment by offset histograms and bit errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .storage import written

RATE = 4000
FRAME = 1024
HOP = 256
LOWEST, HIGHEST = 55.0, 1760.0
#: A filter sees so many frames.
SPAN = 16
#: Offsets are right if at most this share of the bits differs over the overlap.
MAX_BIT_ERROR = 0.2
LEAST_OVERLAP = 24


def filters() -> list[tuple[int, int, int, int]]:
    """16 filters (kind, first pitch class, pitch classes, frames): halves, thirds and quarters of areas compared."""
    out = []
    for i in range(16):
        height = 2 + (i * 5) % 10
        out.append((i % 5, (i * 7) % (13 - height), height, (4, 8, 16)[i % 3]))
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Energy per frame and pitch class (A first), each frame scaled to length 1; silence stays 0."""
    if len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)))
    starts = np.arange(0, len(samples) - FRAME + 1, HOP)
    frames = samples[starts[:, None] + np.arange(FRAME)] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (hz >= LOWEST) & (hz <= HIGHEST)
    pitch = np.round(12 * np.log2(hz[used] / LOWEST)).astype(int) % 12
    table = np.zeros((used.sum(), 12))
    table[np.arange(used.sum()), pitch] = 1
    energy = power[:, used] @ table
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0.0)


def codes(samples: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each position of a window of SPAN frames: 16 filters of two bits each.

    The integral image makes every area a sum of four corners. A filter's value is the log of the
    ratio of two areas; where it lies (below, slightly below, above, far above 0) gives two Gray-coded bits.
    """
    image = chroma(samples)
    if len(image) < SPAN:
        image = np.pad(image, ((0, SPAN - len(image)), (0, 0)))
    total = np.pad(image.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    x = np.arange(len(image) - SPAN + 1)

    def area(x0, x1, y0, y1):
        return total[x1, y1] - total[x0, y1] - total[x1, y0] + total[x0, y0]

    out = np.zeros(len(x), np.uint32)
    for kind, y, height, width in filters():
        whole = area(x, x + width, y, y + height)
        half, mid = width // 2, y + height // 2
        if kind == 0:
            a = area(x, x + width, y, mid)
        elif kind == 1:
            a = area(x, x + half, y, y + height)
        elif kind == 2:
            a = area(x, x + half, y, mid) + area(x + half, x + width, mid, y + height)
        elif kind == 3:
            third = max(1, height // 3)
            a = area(x, x + width, y + third, y + height - third)
        else:
            third = max(1, width // 4)
            a = area(x + third, x + width - third, y, y + height)
        value = np.log((1 + a) / (1 + whole - a))
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Positions that overlap if b is moved by offset, and the share of bits that differ there."""
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(x), len(y))
    return n, float(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)) if n else 1.0


def fingerprints(recordings: DataFrame, rec_id: str = "rec_id", pcm: str = "pcm") -> DataFrame:
    """(id, codes array<int>) per row; pcm holds little-endian signed 16-bit samples at RATE. Null or short recordings are padded with silence."""

    def stage(batches):
        for batch in batches:
            found = []
            for b in batch.column("pcm").to_pylist():
                b = b or b""
                found.append(codes(np.frombuffer(b[: len(b) // 2 * 2], "<i2").astype(float) / 32768).view(np.int32))
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.list_(pa.int32()))], names=["id", "codes"])

    return map_batches(recordings.select(F.col(rec_id).alias("id"), F.col(pcm).alias("pcm")), stage, "id long, codes array<int>")


def classes_of(recordings: DataFrame, every: int = 50, rec_id: str = "rec_id", pcm: str = "pcm") -> tuple[DataFrame, DataFrame]:
    """(id, print) per recording with an id, and (print, class_id, asked, codes) per class of equal fingerprints."""
    prints = written(fingerprints(recordings, rec_id, pcm).where("id is not null").withColumn("print", F.xxhash64("codes")))
    classes = written(
        prints.groupBy("print").agg(F.min("id").alias("class_id"), F.bool_or(F.col("id") % every == 0).alias("asked"), F.first("codes").alias("codes"))
    )
    return prints.select("id", "print"), classes


def class_matches(classes: DataFrame) -> DataFrame:
    """(class_id, match_id, offset, overlap, bit_error): every class that aligns with an asked one, by their smallest ids.

    An equality join on codes, at the first position of every run of the same code, names the offsets
    of a pair of classes; each of them that leaves enough overlap is checked by bit errors over the whole
    overlap, and the one with the least (then the longer overlap, then the smaller offset) counts. A run
    is one position, so silence doesn't multiply.
    """
    at = classes.select("class_id", "asked", F.size("codes").alias("n"), "codes", F.posexplode("codes").alias("pos", "code"))
    at = at.where((F.col("pos") == 0) | (F.get("codes", F.col("pos") - 1) != F.col("code"))).drop("codes")
    at = written(at)
    left = at.where("asked").select(F.col("class_id").alias("a"), "code", F.col("pos").alias("a_pos"), F.col("n").alias("n_a"))
    right = at.select(F.col("class_id").alias("b"), "code", F.col("pos").alias("b_pos"), F.col("n").alias("n_b"))
    offset = (F.col("a_pos") - F.col("b_pos")).alias("offset")
    overlap = F.least(F.col("n_a") - F.greatest("offset", F.lit(0)), F.col("n_b") - F.greatest(-F.col("offset"), F.lit(0)))
    voted = left.join(right, "code").where("a <> b").select("a", "b", "n_a", "n_b", offset).where(overlap >= LEAST_OVERLAP)
    pairs = voted.groupBy("a", "b").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    both = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("codes").alias("x")), "a").join(
        classes.select(F.col("class_id").alias("b"), F.col("codes").alias("y")), "b"
    )

    def stage(batches):
        for batch in batches:
            found = []
            for a, b, offsets, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "offsets", "x", "y")), strict=True):
                x, y = np.array(x, np.int32).view(np.uint32), np.array(y, np.int32).view(np.uint32)
                wrong, n, at = min((e, -n, o) for o in offsets for n, e in [bit_error(x, y, o)])
                if wrong <= MAX_BIT_ERROR:
                    found.append((a, b, at, -n, wrong))
            cols = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["class_id", "match_id", "offset", "overlap", "bit_error"])

    return map_batches(both.select("a", "b", "offsets", "x", "y"), stage, "class_id long, match_id long, offset int, overlap int, bit_error double")


def matches(recordings: DataFrame, every: int = 50, rec_id: str = "rec_id", pcm: str = "pcm") -> DataFrame:
    """All matches of every asked class as pairs of classes; align gives the class of each recording."""
    return class_matches(classes_of(recordings, every, rec_id, pcm)[1])


def align(recordings: DataFrame, every: int = 50, rec_id: str = "rec_id", pcm: str = "pcm") -> DataFrame:
    """(id, class_id, n_codes, match_id, offset, overlap, bit_error, n_matches) per row of recordings.

    Recordings with equal fingerprints form a class, named by its smallest id. Classes with an id that
    `every` divides are asked for. Of the class_matches of each the one with the least bit error (then
    the smallest id) is given, and how many there are; matches() has them all. Classes not asked for,
    and those without a match, have nulls there and no matches. Codes are joined by class, so copies
    don't multiply. Null ids are left out; null recordings are silence; repeated rows are alike; further
    columns are left out; an empty table gives no rows.
    """
    prints, classes = classes_of(recordings, every, rec_id, pcm)
    best = F.min(F.struct("bit_error", "match_id", "offset", "overlap")).alias("best")
    found = class_matches(classes).groupBy("class_id").agg(best, F.count("*").alias("n_matches"))
    info = classes.select("print", "class_id", F.size("codes").alias("n_codes")).join(found, "class_id", "left")
    return prints.join(info, "print").select(
        F.col("id").alias(rec_id), "class_id", "n_codes", "best.match_id", "best.offset", "best.overlap", "best.bit_error", F.coalesce("n_matches", F.lit(0)).alias("n_matches")
    )


#: Versions of a melody: (last digit of the id, samples of silence before it, samples cut from its start, noise).
VERSIONS = ((3, 0, 0, 400), (6, 0, 20 * HOP + 32, 250), (9, 12 * HOP, 0, 250))


def with_versions(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector, played) per row: rows whose id ends in 3, 6 or 9 play the vector whose id ends in 0 instead, with noise, cut or after a silence.

    A row whose original is missing plays its own vector; of repeated originals the smallest vector counts;
    null ids stay; further columns are left out.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    digit = F.pmod("id", F.lit(10))
    played = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("cut"), F.lit(0).alias("noise"))
    for d, lead, cut, noise in VERSIONS:
        played = F.when(digit == d, F.struct(F.lit(lead).alias("lead"), F.lit(cut).alias("cut"), F.lit(noise).alias("noise"))).otherwise(played)
    is_version = F.coalesce(digit.isin(*(d for d, *_ in VERSIONS)), F.lit(False))
    originals = rows.where(digit == 0).groupBy(F.col("id").alias("of")).agg(F.min("v").alias("other"))
    versions = rows.where(is_version).withColumn("of", F.col("id") - digit).join(originals, "of", "left").select("id", F.coalesce("other", "v").alias("v"))
    # the others, ids of null among them, stay where they were read
    both = rows.where(~is_version).unionByName(versions)
    return both.select(F.col("id").alias(vec_id), F.col("v").alias(vector), played.alias("played"))


def recordings_of(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", note: int = 400, played: str | None = None) -> DataFrame:
    """(rec_id, pcm): each vector played as a melody, one note per component, a tone and its octave.

    played names a struct (lead, cut, noise): samples of silence before it, samples left out at its start, and
    the deviation of the noise, which the id seeds.
    """

    def stage(batches):
        t = np.arange(note) / RATE
        envelope = np.minimum(1, np.minimum(np.arange(note), np.arange(note)[::-1]) / 40)
        tones = np.array([np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) + 0.4 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in range(36)]) * envelope
        tones = np.round(tones * 20000).astype("<i2")
        for batch in batches:
            found = []
            for i, v, how in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "v", "played")), strict=True):
                z = np.nan_to_num(np.array([x or 0.0 for x in v or ()], float), posinf=0, neginf=0)
                scale = float(np.abs(z).max(initial=0)) or 1.0
                tune = tones[np.clip(np.round((z / scale + 1) * 17.5), 0, 35).astype(int)].ravel()
                if how and any(how.values()):
                    tune = np.concatenate([np.zeros(how["lead"], "<i2"), tune[how["cut"] :]])
                    noise = np.random.default_rng(abs(i or 0)).normal(0, how["noise"], len(tune))
                    tune = np.clip(tune + np.round(noise), -32768, 32767).astype("<i2")
                found.append(tune.tobytes())
            yield pa.record_batch([batch.column("rec_id"), pa.array(found, pa.binary())], names=["rec_id", "pcm"])

    how = F.col(played) if played else F.lit(None).cast("struct<lead: int, cut: int, noise: int>")
    rows = vectors.select(F.col(vec_id).alias("rec_id"), F.col(vector).alias("v"), how.alias("played"))
    return map_batches(rows, stage, "rec_id long, pcm binary")
