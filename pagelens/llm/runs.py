"""Periodic runs of words: Lyndon arrays from Baier's grouping of suffixes, Lyndon roots extended to runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, utf8

LEAST_WORDS = 6
LEAST_TIMES = 4
#: Words that are compared at once when a root is extended, at first; doubled as long as they agree.
_STEP = 16
_FAR = np.int64(1) << 40


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Of each place, the length of the longest Lyndon word that begins there.

    Phase one of Baier's suffix sorter: suffixes are grouped by their first letter, and groups are taken from
    the highest to the lowest. Each place of a group points to the nearest place on its left that is in a lower
    group. Places with equally many pointers leave their group for a new one just above it, and their context
    grows by that many contexts of the group. The context of a place, when its turn comes, is its longest Lyndon
    word. Linear but for the sorting of letters: each place is taken once, and gives one pointer.
    """
    n = len(codes)
    letters = sorted(set(codes))
    at = {c: k for k, c in enumerate(letters)}
    group = [at[c] for c in codes]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    context = [1] * len(letters)
    below = list(range(-1, len(letters) - 1))
    above = list(range(1, len(letters) + 1))
    left, right = list(range(-1, n)), list(range(1, n + 2))  # of the places not taken yet; the last entry stands for both ends
    found = [0] * n
    g = len(letters) - 1
    while g >= 0:
        length, count, target = context[g], 0, -1
        pointed: list[tuple[int, int]] = []
        for i in members[g]:
            if group[i] != g:
                continue
            found[i] = length
            lo, hi = left[i], right[i]
            right[lo] = hi
            left[hi] = lo
            if lo == target:
                count += 1
            else:
                if target >= 0:
                    pointed.append((target, count))
                target, count = lo, 1
        if target >= 0:
            pointed.append((target, count))
        if len(pointed) == 1:
            moves = [(count, group[target], [target])]
        else:
            sets: dict[tuple[int, int], list[int]] = {}
            for i, times in pointed:
                sets.setdefault((times, group[i]), []).append(i)
            moves = sorted(((times, old, places) for (times, old), places in sets.items()), reverse=True)
        for times, old, places in moves:
            if size[old] == len(places):  # all that is left of the group: it grows where it stands
                context[old] += times * length
                continue
            new = len(members)
            members.append(places)
            size[old] -= len(places)
            size.append(len(places))
            context.append(context[old] + times * length)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
            for i in places:
                group[i] = new
        g = below[g]
    return found


def _forward(codes: np.ndarray, end: int, period: int) -> int:
    """The place up to which codes go on with the period."""
    step = _STEP
    while end < len(codes):
        same = codes[end : end + step] == codes[end - period : end - period + step][: len(codes) - end]
        if not same.all():
            return end + int(np.argmin(same))
        end, step = end + len(same), step * 2
    return end


def word_runs(codes: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of codes with at least `least` places and `times` (3 or more) periods.

    A run's Lyndon roots, under one of the two orders of letters, are longest Lyndon words, and `times` periods hold
    times - 1 of them in a row. The first of such a row is extended to both sides as far as places one period apart
    agree. Each row belongs to one run, and runs of two periods or more with roots in a row are short or few: their
    lengths add up to n log n at most, and so does this work.
    """
    if times < 3:
        raise ValueError("runs of less than three periods are not looked for")
    found: set[tuple[int, int, int]] = set()
    n = len(codes)
    if n < max(least, times):
        return found
    back = codes[::-1]
    power = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    for order in (codes, codes.max() - codes):
        root = np.array(lyndon_lengths(order.tolist()))
        at = np.flatnonzero(np.arange(n) + 2 * root <= n)
        p = root[at]
        # whether the root comes again right behind itself: as long, and (but for collisions, which cost time only) the same words
        again = np.zeros(n, bool)
        again[at] = (root[at + p] == p) & ((sums[at + p] - sums[at]) * power[p] == sums[at + 2 * p] - sums[at + p])
        first = np.flatnonzero(again)
        p = root[first]
        for k in range(1, times - 2):
            keep = again[first + k * p]
            first, p = first[keep], p[keep]
        before = np.maximum(first - p, 0)
        head = (first < p) | ~again[before] | (root[before] != p)
        for i, q in zip(first[head].tolist(), p[head].tolist(), strict=True):
            end = _forward(codes, i + q, q)
            start = n - _forward(back, n - i, q)
            if end - start >= max(least, times * q):
                found.add((start, end - start, q))
    return found


def _stretches(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _suspects(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches of words outside which no run can be; all others are left out.

    Within a run of four periods or more each four words in a row come again at most a period further on or back,
    and a period is at most a quarter of the stretch around it.
    """
    width = min(4, times)
    n = len(codes) - width + 1
    key = codes[:n].astype(np.uint64)
    for k in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    near = np.full(n, _FAR)
    gap = order[same + 1] - order[same]
    near[order[same + 1]] = gap
    near[order[same]] = np.minimum(near[order[same]], gap)
    alive = near < _FAR
    a, b = _stretches(alive)
    for _ in range(3):
        long = b - a + width - 1 >= least
        a, b = a[long], b[long]
        if not len(a):
            return []
        bound = np.zeros(n, np.int64)
        for s, e in zip(a.tolist(), b.tolist(), strict=True):
            bound[s:e] = (e - s + width - 1) // times
        a, b = _stretches(near <= bound)
    return [(s, e + width - 1) for s, e in zip(a.tolist(), b.tolist(), strict=True) if e - s + width - 1 >= least]


def text_runs(words: list[bytes], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start, then period."""
    if len(words) < max(least, times):
        return []
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return []
    found = [(s + a, length, q) for a, b in _suspects(codes, least, times) for s, length, q in word_runs(codes[a:b], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, q in runs:
            kept[start + q : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """(id, n_words, runs, collapsed) per row of docs.

    Words are runs without ASCII white space, numbered from 0. runs is an array of structs (start, length, period),
    by start, then period: the stretches that no neighbouring word extends, of smallest period `period`, at least
    `least` words and `times` periods long. collapsed is the text of the words that no run holds after its first
    period, joined by one space.

    One pass without a shuffle; a text is looked at whole, in memory in proportion to its words. Stretches where no
    four words come again nearby are left out before suffixes are grouped; that loses no run. Null, empty and blank
    texts have 0 words, no runs and an empty text; repeated rows are looked at each by itself; null ids stay;
    further columns are left out; an empty table gives no rows.
    """

    def stage(batches):
        for batch in batches:
            counts, runs, texts = [], [], []
            for t in utf8(batch):
                words = t.split()
                own = text_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(collapsed(words, own))
            columns = [pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.record_batch([batch.column("id"), *columns], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = map_batches(rows, stage, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", doc_id)


def periodic_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): every tenth document, by the crc32 of its id, ends in repetitions of its own words; the others stay as they are.

    With g = crc32 / 10 and n words, the words from a = g % n on are those from a to a + p over and over,
    p = 1 + (n - a) / (3 + g % 8). Texts without words and rows without an id stay as they are.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(doc_id).cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycles = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    tailed = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), cycles), F.lit(1), n), " ")
    return docs.select(F.col(doc_id), F.when((h % 10 == 0) & (n > 0), tailed).otherwise(F.col(text)).alias(text))
