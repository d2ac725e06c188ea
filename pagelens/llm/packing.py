"""Packing documents into fixed windows by dynamic programming, in the order of the rows."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, texts
from .word_bpe import encoder

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: What a cut at a sentence's end, and one inside a sentence, costs in tokens of padding.
SENTENCE_CUT = 8
HARD_CUT = 32
#: Tokens between the places inside documents that are considered for a cut.
CUT_STEP = 8
#: Tokens that are planned at once, and those of them whose windows stay open for what follows.
BLOCK = 1 << 18
OPEN = 8 * WINDOW

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_places(ends: np.ndarray, stops: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, rising, and what a cut there costs.

    ends: places after each document, the last one being the end. stops: places after sentences.
    """
    total = int(ends[-1])
    near = stops[np.append(np.diff(stops // CUT_STEP) > 0, True)] if len(stops) else stops
    known = np.union1d(ends, near)
    gaps = np.diff(known, prepend=0)
    far, step = gaps > 4 * CUT_STEP, 2 * CUT_STEP
    hard = [np.arange(b - g + step, b, step) for b, g in zip(known[far].tolist(), gaps[far].tolist(), strict=True)]
    places = np.union1d(known, np.concatenate(hard)) if hard else known
    cost = np.full(len(places), HARD_CUT)
    cost[np.searchsorted(places, near)] = SENTENCE_CUT
    cost[np.searchsorted(places, ends)] = 0
    return places[places <= total], cost


def plan_windows(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The places among them that end windows, with the least padding plus cost of cuts.

    best[j] = cost[j] + window - place[j] + min(best[i] + place[i]) over the i at most a window
    before j; a queue of rising values gives each minimum in constant time on average.
    """
    at = [0, *places.tolist()]
    came = [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # value, place, index
    extra = [0, *cost.tolist()]
    for j in range(1, len(at)):
        p = at[j]
        while queue[0][1] < p - window:
            queue.popleft()
        least, _, i = queue[0]
        came[j] = i
        value = least + extra[j] + window  # best[j] + place[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    chosen = []
    j = len(at) - 1
    while j:
        chosen.append(at[j])
        j = came[j]
    return chosen[::-1]


class _Packer:
    """Rows of one partition in, pieces out; holds about one block of tokens."""

    def __init__(self, first_sequence: int, stop: np.ndarray, window: int) -> None:
        self.sequence, self.stop, self.window = first_sequence, stop, window
        self.docs: list[list] = []  # doc_id, ids not yet placed, start, tokens of the document
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.held += len(ids)

    def pieces(self, last: bool):
        """The windows that are settled; all of them at the end."""
        if not self.docs:
            return
        flow = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        stops = np.flatnonzero(self.stop[flow]) + 1
        windows = plan_windows(*cut_places(ends, stops, self.window), self.window)
        if not last:
            windows = [w for w in windows if w <= self.held - OPEN]
        k, begin = 0, 0
        for end in windows:
            offset = 0
            while begin < end:
                doc = self.docs[k]
                n = min(end - begin, len(doc[1]))
                yield doc[0], doc[2], n, doc[1][:n].tobytes(), doc[3], self.sequence, offset
                offset += n
                begin += n
                if n == len(doc[1]):
                    k += 1
                else:
                    doc[1], doc[2] = doc[1][n:], doc[2] + n
            self.sequence += 1
        self.docs = self.docs[k:]
        self.held -= begin


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of documents, laid into windows of at most `window` tokens.

    A document's ids are those of the tokenizer file, then END_ID; a null or empty text is END_ID
    alone. Each partition of docs is packed by itself, in its row order and without a shuffle, so at
    most one half-filled window a partition is added by splitting the work; block by block, so
    memory is bounded by the longest text. Windows are cut where padding plus the cost of cuts is
    least; windows whose length is a power of two need no padding, which the plan doesn't seek.
    Rows with equal ids are packed each by itself; a null id stays null; further columns are left
    out; an empty table gives no rows. ids holds a piece's ids as little-endian unsigned 32 bits;
    start counts the document's ids before it; offset counts those before it in the window.
    """
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def rows(found):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def stage(batches):
        encode = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 40, encode.stop, window)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), texts(batch), strict=True):
                packer.add(i, np.frombuffer(encode.encode(t) + end, "<u4"))
                if packer.held >= BLOCK + OPEN and (found := list(packer.pieces(False))):
                    yield rows(found)
        if found := list(packer.pieces(True)):
            yield rows(found)
        encode.forget()

    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return map_batches(source, stage, PIECES).withColumnRenamed("doc_id", doc_id)
