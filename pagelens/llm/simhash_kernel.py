"""64-bit SimHash of one text over its three-word shingles."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

SHINGLE_WORDS = 3
SEED = 42
_CHUNK = 1 << 15


def shingle_hashes(text: bytes, n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle, repeats included; shorter texts give one shingle, blank ones none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n_words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n_words + 1]
    cuts = map(slice, starts.tolist(), ends[n_words - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, len(starts))


def fingerprint(text: bytes, n_words: int = SHINGLE_WORDS) -> int:
    """Of the shingles of one text."""
    return fingerprint_of(shingle_hashes(text, n_words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; signed, as Spark keeps a long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])
