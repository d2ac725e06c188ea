"""Token counts that follow edits: only what an edit touches is encoded again."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .word_bpe import WordEncoder, encoder

#: Characters of a leaf, about; a leaf that edits have made four times as long is split.
LEAF = 512
#: Fixed value: white space at which the tokenizer surely starts anew.
_SPACE = " \t\n\r\x0b\x0c"
_BOUNDARY = re.compile(f"[{_SPACE}]+")


def leaves_of(text: str) -> list[str]:
    """The text in pieces of about LEAF characters, each ending after white space (but the last)."""
    out, a = [], 0
    while len(text) - a > LEAF:
        m = _BOUNDARY.search(text, a + LEAF)
        if not m or m.end() == len(text):
            break
        out.append(text[a : m.end()])
        a = m.end()
    return [*out, text[a:]]


class SegmentTree:
    """A text as leaves of whole pre-tokens, with sums of characters and tokens over subtrees."""

    def __init__(self, text: str, encode: WordEncoder) -> None:
        self.encode = encode
        #: Characters that were encoded, at first and by edits.
        self.encoded = 0
        self._build([(leaf, self._count(leaf)) for leaf in leaves_of(text)])

    def _count(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return len(self.encode.encode(leaf)) // 4

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaf = [t for t, _ in leaves] + [""] * (self.width - len(leaves))
        self.sums = [(0, 0)] * self.width + [(len(t), n) for t, n in leaves] + [(0, 0)] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    @property
    def text(self) -> str:
        return "".join(self.leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf of character `at`, and where in it; the end belongs to the last leaf with text."""
        at = min(at, max(0, self.chars - 1))
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.sums[i][0]:
                at -= self.sums[i][0]
                i += 1
        return i - self.width, at

    def _set(self, k: int, text: str, tokens: int) -> None:
        self.leaf[k] = text
        i = k + self.width
        self.sums[i] = (len(text), tokens)
        while i > 1:
            i //= 2
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Characters start to end (clipped to the text) become the replacement.

        The leaves touched are encoded again, with the following leaf where they no longer end in
        white space: the tokens on both sides of such a boundary don't depend on each other.
        """
        start = min(max(0, start), self.chars)
        end = min(max(start, end), self.chars)
        if start == end and not replacement:
            return
        before = self.chars
        first, at = self._find(start)
        if start == before and before:
            at += 1
        last, upto = self._find(max(start, end - 1))
        upto = at if start == end else upto + 1
        text = self.leaf[first][:at] + replacement + self.leaf[last][upto:]
        while text and text[-1] not in _SPACE or not text:
            last = next((k for k in range(last + 1, self.width) if self.leaf[k]), None)
            if last is None:
                last = self.width - 1
                break
            text += self.leaf[last]
        for k in range(first + 1, last + 1):
            if self.leaf[k]:
                self._set(k, "", 0)
        self._set(first, text, self._count(text))
        if len(text) > 4 * LEAF:
            kept = [(t, self.sums[self.width + k][1]) for k, t in enumerate(self.leaf) if t and k != first]
            place = sum(1 for k in range(first) if self.leaf[k])
            self._build([*kept[:place], *((t, self._count(t)) for t in leaves_of(text)), *kept[place:]])


def counts_after_edits(docs: DataFrame, tokenizer: str, edits: str = "edits", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens, edited_tokens, chars, encoded_chars) per row of docs.

    edits is an array of structs (start, end, replacement) in code points of the text as the edits
    before have left it; ends are clipped to the text, a null bound counts as 0, a null replacement
    or edit as nothing. tokens counts the whole text once; each edit then encodes only the leaves it
    touches; encoded_chars counts what edits have encoded. Null and empty texts have 0 tokens and may
    be edited; repeated rows are counted each by itself; null ids stay; further columns are left out;
    an empty table gives no rows. One pass without a shuffle: a document's edits come with it.
    """

    def stage(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for t, todo in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = SegmentTree(t or "", encode)
                tokens, whole = tree.tokens, tree.encoded
                for e in todo or ():
                    if e:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                out.append((tokens, tree.tokens, tree.chars, tree.encoded - whole))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.record_batch(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "tokens", "edited_tokens", "chars", "encoded_chars"]
            )

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(edits).alias("edits"))
    found = map_batches(rows, stage, "id long, tokens long, edited_tokens long, chars long, encoded_chars long")
    return found.withColumnRenamed("id", doc_id)


def derived_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the column edits, made from each row's own values: words cut out, words moved, letters inside a word."""
    n = F.coalesce(F.length(text), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), n + 1).cast("int")
    edit = lambda a, b, r: F.struct(a.alias("start"), b.alias("end"), r.alias("replacement"))
    some = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 48)
    return docs.withColumn(
        "edits",
        F.array(
            edit(place(1), place(1) + 40, F.lit("")),
            edit(place(2), place(2), some),
            edit(place(3), place(3) + 3, F.lit("ed.\n")),
            edit(F.lit(0), F.lit(0), F.lit("Note: ")),
        ),
    )
