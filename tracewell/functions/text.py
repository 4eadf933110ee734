"""Text expressions that stay inside whole-stage codegen.

Fixed values in this module are word lists and patterns that search results depend on.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\p{Nd}+(?:\.\p{Nd}+)?|\p{L}+"
WORD = r"[\p{L}\p{N}]+"
# Words without meaning of their own in a lexical query.
OPERATOR_WORDS = ["and", "near", "not", "or"]
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


# Texts of these characters only are composed and compatible already.
_PLAIN = r"^[\x00-\x7f\uac00-\ud7a3]*$"


def nfkc(text: Column) -> Column:
    """Unicode form NFKC; only texts beyond ASCII and Hangul syllables leave the JVM, each distinct value of a batch once."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(texts)
        forms = [unicodedata.normalize("NFKC", u) for u in uniques]
        return pd.Series([None if c < 0 else forms[c] for c in codes], dtype=object)

    plain = text.rlike(_PLAIN)
    return F.when(plain, text).otherwise(form(F.when(~plain, text)))


def lexical_tokens(text: Column) -> Column:
    """Numbers and letter runs of the lower-case NFKC form, without operator words; null for null."""
    return F.filter(F.regexp_extract_all(F.lower(nfkc(text)), F.lit(f"({TOKEN})"), 1), lambda t: ~t.isin(*OPERATOR_WORDS))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def contains_sequence(tokens: Column, part: Column) -> Column:
    """``part`` stands contiguously in ``tokens``; never for an empty part."""
    fits = (F.size(tokens) >= F.size(part)) & (F.size(part) > 0)
    starts = F.sequence(F.lit(1), F.when(fits, F.size(tokens) - F.size(part) + 1).otherwise(F.lit(1)))
    return F.when(fits, F.exists(starts, lambda i: F.slice(tokens, i, F.size(part)) == part)).otherwise(F.lit(False))


def round_half_up(value: Column, digits: int = 6) -> Column:
    """Half towards plus infinity, negative zero removed."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale) + F.lit(0.0)


def lexical_score(query: list[str], text_tokens: Column, clause_tokens: Column) -> Column:
    """0.55 coverage + 0.25 phrase + 0.10 frequency + 0.10 whole clause; null if nothing is covered."""
    q = F.array(*[F.lit(t) for t in query]) if query else F.array().cast("array<string>")
    n = float(max(1, len(query)))
    covered = F.size(F.array_intersect(q, F.concat(text_tokens, clause_tokens)))
    phrase = contains_sequence(text_tokens, q) | contains_sequence(clause_tokens, q)
    hits = F.aggregate(q, F.lit(0), lambda s, t: s + F.least(F.size(F.filter(text_tokens, lambda x: x == t)), F.lit(3)))
    score = covered / n * 0.55 + F.when(phrase, 0.25).otherwise(0.0) + hits / (3 * n) * 0.10 + F.when(clause_tokens == q, 0.10).otherwise(0.0)
    return F.when(covered > 0, round_half_up(score))


def split_paragraphs(text: Column) -> Column:
    """Blank-line paragraphs; a text of one paragraph falls apart at sentence ends and lines."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    tidy = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, f"{SPACE}+", " "))), lambda p: p != "")
    blank = tidy(F.split(unix, r"\n{2,}"))
    fine = tidy(F.split(unix, rf"(?<=[.!?。]){SPACE}+|\n+"))
    return F.when(F.size(blank) > 1, blank).otherwise(fine)


def fixed_windows(text: Column, size: int, step: int | None = None) -> Column:
    """Windows of ``size`` characters every ``step`` (0.55 of the size), the last one reaching the end."""
    step = step or int(size * 0.55)
    n = F.length(text)
    last = F.when(n > size, F.ceil((n - size) / step) * step).otherwise(0).cast("int")
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.rtrim(F.substring(text, i + 1, F.lit(size))))


def clause_of(text: Column) -> Column:
    """The first code clause named: 'KEC 1.2', '제 3 조', then a bare dotted number; null if none."""
    code = F.regexp_extract(text, r"(?i)(?<![A-Za-z0-9_])KEC\s*(\d+(?:\.\d+)*)", 1)
    article = F.regexp_extract(text, r"제\s*(\d+)\s*조", 1)
    bare = F.regexp_extract(text, r"(?<![A-Za-z0-9_])(\d{2,4}(?:\.\d+)+)(?![A-Za-z0-9_])", 1)
    return F.coalesce(
        F.when(code != "", F.concat(F.lit("KEC "), code)), F.when(article != "", F.concat(F.lit("제"), article, F.lit("조"))), F.when(bare != "", bare)
    )


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))).otherwise(
        F.array().cast("array<string>")
    )


def title_similarity(a: Column, b: Column) -> Column:
    """1 for equal, the ratio of lengths for containment, else shared bigrams over the larger bigram set."""
    la, lb = F.length(a), F.length(b)
    most = F.greatest(F.size(bigrams(a)), F.size(bigrams(b)))
    inside = F.contains(a, b) | F.contains(b, a)
    return (
        F.when((la == 0) | (lb == 0), 0.0).when(a == b, 1.0).when(inside, F.least(la, lb) / F.greatest(la, lb))
        .when(most == 0, 0.0).otherwise(F.size(F.array_intersect(bigrams(a), bigrams(b))) / F.greatest(most, F.lit(1)))
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII text, as a number."""
    codes = F.transform(F.split(text, ""), F.ascii)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.shiftright(F.shiftleft((h.bitwiseXOR(c.cast("long")) * 16777619), 32), 32).bitwiseAND(4294967295))


def url_component(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() as they are."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%2A", "*")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def drawing_number(text: Column) -> Column:
    """AA-999X from any spelling with spaces, underscores or none; null if there is none."""
    flat = F.upper(F.regexp_replace(text, r"[\s_]+", "-"))
    hit = lambda g: F.regexp_extract(flat, r"(?:^|[^A-Z0-9])([A-Z]{1,4})-?(\d{2,4})-?([A-Z]?)(?=$|[^A-Z0-9])", g)
    return F.when(hit(1) != "", F.concat(hit(1), F.lit("-"), hit(2), hit(3)))


def collapsed(text: Column) -> Column:
    """White space of any kind collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def excerpt(text: Column, keyword: Column, before: int = 60, after: int = 80) -> Column:
    """The text around the first occurrence of a lower-case keyword, case ignored."""
    at = F.locate(keyword, F.lower(text)) if isinstance(keyword, str) else F.position(keyword, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.trim(F.substring(text, start, at - start + F.length(keyword) + after))
