"""One consistent form for text that looks the same but is written with other characters.

The fold maps, character by character:

* default-ignorable and format characters (zero-width, soft hyphen, direction marks) to nothing;
* every space other than U+0020 to a space; the look-alike hyphens to ``-``;
* characters with a compatibility decomposition (full width, ligatures, squared units, ohm and
  kelvin signs) to that decomposition, save those that look different from ordinary writing:
  superscripts, subscripts, circled characters, fractions and stand-alone Hangul jamo;
* Cyrillic and Greek twins of Latin letters to Latin, inside a word that also holds a Latin letter or
  a digit and no letter without a Latin twin; a word wholly in another alphabet stays;
* letters taken apart (combining accents, conjoining jamo) to composed letters.

Line ends and tabs are content. ``None`` folds to ``None``, the empty string to itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other alphabets that print like a Latin letter.
CYRILLIC_TWINS = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "а": "a", "с": "c", "ԁ": "d", "е": "e",
    "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w",
    "х": "x", "у": "y",
}
GREEK_TWINS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
}
TWINS = CYRILLIC_TWINS | GREEK_TWINS
# Hyphens, minus signs, quotes that stand in for the ASCII sign.
SIGN_TWINS = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2212": "-"}
# Decompositions that look different from the plain characters and are content.
CONTENT_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>")

_LINE = "\n\r\t\x0b\x0c\x85\u2028\u2029"


def _default_ignorable(ch: str) -> bool:
    cp = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= cp <= 0x180F
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0000 <= cp <= 0xE0FFF
    )


@lru_cache(maxsize=65536)
def plain(ch: str) -> str | None:
    """The ordinary writing for one character, or ``None`` when it is ordinary itself.

    Alphabet twins and combining marks depend on their neighbours and are not decided here.
    """
    if ch in _LINE or ch == " ":
        return None
    if _default_ignorable(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in SIGN_TWINS:
        return SIGN_TWINS[ch]
    tag = unicodedata.decomposition(ch)
    if not tag or tag.startswith(CONTENT_TAGS) or 0x3131 <= ord(ch) <= 0x318E:
        return None
    flat = unicodedata.normalize("NFKC", ch)
    return None if flat == ch else "".join(plain(c) or c if c != ch else c for c in flat)


# Anything beyond ASCII that is neither a composed Hangul syllable nor a frequent content sign.
_SUSPECT = re.compile("[^\x00-\x7e가-힣°-²×ΦΩμ₩€≤★]")
_WORD = re.compile(r"\w+")
_TWIN = re.compile("[" + "".join(TWINS) + "]")
_TWIN_TABLE = {ord(a): b for a, b in TWINS.items()}


def _latin_or_digit(ch: str) -> bool:
    return ch.isascii() and ch.isalnum() or ("À" <= ch <= "ɏ" and ch.isalpha())


def _untwin(match: re.Match) -> str:
    word = match.group()
    if not _TWIN.search(word):
        return word
    mixed = False
    for ch in word:
        if _latin_or_digit(ch):
            mixed = True
        elif ch not in TWINS and ("Ͱ" <= ch <= "ԯ"):
            return word
    return word.translate(_TWIN_TABLE) if mixed else word


def fold(text: str | None) -> str | None:
    """The consistent form of one text, case kept."""
    if text is None or text.isascii() and "\x7f" not in text or not _SUSPECT.search(text):
        return text
    out = "".join(ch if (p := plain(ch)) is None else p for ch in text)
    out = unicodedata.normalize("NFC", out)
    return _WORD.sub(_untwin, out) if _TWIN.search(out) else out


def fold_key(text: str | None) -> str | None:
    """A comparison key: folded, fully case-folded, white space collapsed and trimmed."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFC", fold(text).casefold()).split())


def _per_distinct(values: pd.Series, fn) -> pd.Series:
    codes, uniques = pd.factorize(values, use_na_sentinel=True)
    mapped = [fn(u) for u in uniques]
    return pd.Series([None if c < 0 else mapped[c] for c in codes], dtype=object)


def folded(col: Column | str) -> Column:
    """``fold`` as a column, each distinct value of a batch computed once."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return _per_distinct(values, fold)

    return run(F.col(col) if isinstance(col, str) else col)


def fold_keys(col: Column | str) -> Column:
    """``fold_key`` as a column, each distinct value of a batch computed once."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return _per_distinct(values, fold_key)

    return run(F.col(col) if isinstance(col, str) else col)
