"""Text expressions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of a character in a result title, in pixels; others have 10.
CHAR_WIDTHS = {
    3: "'",
    4: "ilj.,:;!|",
    5: "ft I/",
    6: "r-()",
    8: "csz",
    9: "aevxyJ",
    10: "bdghknopqu0123456789_L",
    11: "FTZ",
    12: "ABEKPSVXY",
    13: "wCDHNRU",
    14: "GOQ",
    15: "mM",
    17: "W",
}
DEFAULT_WIDTH = 10


def strip_ws(c: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def has_text(c: Column) -> Column:
    """Whether something is left after strip_ws; found at the first such character."""
    return c.rlike(r"[^\s  ]")


def words(c: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def word_regex_count(c: Column) -> Column:
    """Words that may hold apostrophes and hyphens."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\b\w[\w'-]*\b")), F.lit(0))


def pixel_width(c: Column) -> Column:
    """Width in a result list: one replace per width class, no per-character work in Python."""
    extra = [
        (F.length(c) - F.length(F.translate(c, chars, ""))) * F.lit(width - DEFAULT_WIDTH) for width, chars in CHAR_WIDTHS.items() if width != DEFAULT_WIDTH
    ]
    total = F.length(c) * F.lit(DEFAULT_WIDTH)
    for e in extra:
        total = total + e
    return F.coalesce(total, F.lit(0)).cast("int")


def description_pixel_width(c: Column) -> Column:
    return F.floor(pixel_width(c) * F.lit(0.8)).cast("int")


EDGE = ".,!?;:\"'()"
#: A word whose last letter is an e after a consonant and an earlier vowel; one without vowels; one of marks alone. All start at a word's start, so a long word is looked at once.
_SILENT_E = rf"(?<!\S)[^aeiouy\s]*+[aeiouy]++[^aeiouy\s]\S*e[{EDGE}]*(?!\S)"
_NO_VOWEL = r"(?<!\S)[^aeiouy\s]++(?!\S)"
_MARKS = rf"(?<!\S)[{EDGE}]++(?!\S)"


def syllables(c: Column) -> Column:
    """Of all words of a text: runs of vowels, less silent e's, and one for each word without vowels."""
    n = lambda pattern: F.regexp_count(F.lower(c), F.lit(pattern))
    return n("[aeiouy]+") - n(_SILENT_E) + n(_NO_VOWEL) - n(_MARKS)


def flesch(c: Column) -> Column:
    """Flesch reading ease to one decimal; null for a text without words. A few counts over the whole text, none word by word."""
    return flesch_of(F.regexp_count(c, F.lit(r"\S+")), F.regexp_count(c, F.lit("[.!?]+")), syllables(c))


def flesch_of(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch reading ease of counts."""
    score = F.lit(206.835) - F.lit(1.015) * (words / F.greatest(sentences, F.lit(1))) - F.lit(84.6) * (syllables / words)
    return F.when(words > 0, F.bround(score, 1))


def strip_tags(html: Column) -> Column:
    """Scripts, styles and tags as blanks."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), "(?s)<[^>]+>", " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct runs of n words of the lower-cased text; the whole text if it has fewer, none if it has no words."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return let(words(F.lower(c)), runs)


def serp_row(title: Column, description: Column) -> list[Column]:
    """Width, length and flags of a result row."""
    tpx, dpx = pixel_width(title), description_pixel_width(description)
    return [
        tpx.alias("title_px"),
        F.coalesce(F.length(title), F.lit(0)).alias("title_chars"),
        (tpx > 580).alias("title_truncated"),
        dpx.alias("desc_px"),
        F.coalesce(F.length(description), F.lit(0)).alias("desc_chars"),
        (dpx > 990).alias("desc_truncated"),
        F.coalesce(F.length(strip_ws(description)) < 120, F.lit(True)).alias("desc_thin"),
    ]


#: Locale names to the dictionary's codes.
LOCALES = {"en": "en-US", "de": "de-DE", "pt": "pt-PT", "zh-hans": "zh-CN", "zh-hant": "zh-TW", "zh": "zh-CN", "ca": "ca-ES"}


def language_code(c: Column) -> Column:
    """Language tags in one spelling: en_us -> en-US, listed bare languages with their usual region."""
    tag = F.lower(F.regexp_replace(strip_ws(c), "_", "-"))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LOCALES.items())])[tag]
    parts = F.split(tag, "-")
    return F.coalesce(known, F.when(F.size(parts) >= 2, F.concat(parts[0], F.lit("-"), F.upper(parts[1]))).otherwise(tag))
