"""Token ids of the word-end BPE vocabulary, as its tokenizer gives them, with a cache of words.

The tokenizer normalises (NFC, lower case), splits and merges each white-space-delimited word by
itself, so a text's ids are its words' ids in a row. Words of Latin letters are merged by tiktoken
from the same vocabulary, all others by the tokenizer itself; tests compare both on whole tables.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Words of one generation of the cache, and the longest that are kept: about 130 MB for a Python worker's two generations.
CACHE_WORDS = 160_000
CACHE_LETTERS = 40
_END = "\x01"
_UNUSED = 60_000
#: The tokenizer's own split, for letters below U+0250, as the standard re module writes it.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\s\\w]|_)+")
_OTHER = re.compile("[\x00-\x1f\x80-\x9f\xa0İɐ-\U0010ffff]|<\\|")
_ODD_SPACES = "\x1c\x1d\x1e\x1f"


def _byte_of_char() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Packed ids (little-endian unsigned 32-bit) of each word, worked out at its first use."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab: dict[str, int] = json.load(f)["model"]["vocab"]
        byte = _byte_of_char()
        ranks: dict[bytes, int] = {}
        stops = []
        for token, number in vocab.items():
            body = token.removesuffix("</w>")
            if not all(c in byte for c in body):
                continue  # the special tokens
            ranks[bytes(byte[c] for c in body) + _END.encode() * (body != token)] = number
            if body != token and body[-1:] in ".!?":
                stops.append(number)
        ranks[_END.encode()] = _UNUSED
        for b in range(256):
            ranks.setdefault(bytes([b]), _UNUSED + 1 + b)
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: Whether a token ends a sentence.
        self.stop = np.zeros(max(vocab.values()) + 1, bool)
        self.stop[stops] = True

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            if _OTHER.search(word):
                ids = self.slow.encode(word, add_special_tokens=False).ids
            else:
                ids = self.fast(_END.join(_PIECE.findall(word.lower())) + _END)
            packed = array("I", ids).tobytes()
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def forget(self) -> None:
        """At the end of a task, so that later stages of a reused worker have the memory."""
        self.clear()
        self.old = {}

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if any(c in text for c in _ODD_SPACES):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@cache
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)
