"""Splitting oversized items at natural boundaries.

Sizes are counted in units, characters (code points) or tokens of a public tokenizer. A text is held as its
prefix sums: ``edges[i]`` is the offset at which unit i begins, the last one is the end of the text. Every text
of more than ``limit`` units becomes numbered pieces of at most ``limit``, each after the first opening with
the last ``overlap`` units of the one before. Candidate cuts are the ends of paragraphs, lines, sentences
and words, one sorted array of offsets per rank. A binary search in the prefix sums turns them into units,
another takes the last boundary at or under the limit, the highest rank first as long as it does not leave
the piece less than half full, and a hard cut between two units is the fallback. A text of any length costs
one pass and two searches a piece.

Defined cases: null text gives no pieces; a text within the limit, empty included, is one piece; the
pieces without their overlaps concatenate to the text exactly; repeated rows are dropped; columns named
like the results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.encode import load, vocabulary

LIMIT, OVERLAP = 1200, 150

# Ends of paragraphs, of lines, of sentences, of words: a cut falls behind the match.
_BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*",
        r"\r\n|\r|\n",
        r"""[.!?]["')\]]*\s+|[。！？]\s*""",
        r"[\s,;|]+",
    )
)


def boundary_arrays(text: str) -> list[np.ndarray]:
    """Sorted cut offsets by rank; a lower rank's array also holds the higher ranks' cuts."""
    found, merged = [], np.empty(0, np.int64)
    for pattern in _BOUNDARIES:
        merged = np.union1d(merged, np.fromiter((m.end() for m in pattern.finditer(text)), np.int64))
        found.append(merged)
    return found


def unit_cuts(edges: np.ndarray, boundaries: list[np.ndarray]) -> list[np.ndarray]:
    """The boundaries in units: the last unit that begins at or before each boundary, so a unit is never cut."""
    return [np.unique(np.searchsorted(edges, edges[np.searchsorted(edges, cuts, side="right") - 1])) for cuts in boundaries]


def cut_points(edges: np.ndarray, boundaries: list[np.ndarray], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, fresh start, end) in units of each piece of a text with the prefix sums ``edges``.

    Units that begin at one offset belong to one character and stay together.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    n, out, fresh = len(edges) - 1, [], 0
    while True:
        start = max(0, fresh - overlap)
        if start and edges[start] == edges[start - 1]:
            start = int(np.searchsorted(edges, edges[start], side="right"))
        if n - start <= limit:
            out.append((start, fresh, n))
            return out
        end = int(np.searchsorted(edges, edges[start + limit]))
        if end <= fresh:
            # A single character of more units than there is room for.
            end = int(np.searchsorted(edges, edges[fresh], side="right"))
        # A natural cut may shorten the piece, but keeps half of its fresh room in use.
        least = fresh + max(1, (end - fresh) // 2)
        for cuts in boundaries:
            at = int(np.searchsorted(cuts, end, side="right")) - 1
            if at >= 0 and cuts[at] >= least:
                end = int(cuts[at])
                break
        out.append((start, fresh, end))
        fresh = end


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, edges: np.ndarray | None = None) -> list[dict]:
    """Pieces of a text; ``edges`` are the prefix sums of its units, those of its characters if none are given."""
    edges = np.arange(len(text) + 1) if edges is None else edges
    n = len(edges) - 1
    spans = [(0, 0, n)] if n <= limit else cut_points(edges, unit_cuts(edges, boundary_arrays(text)), limit, overlap)
    at = lambda unit: int(edges[unit])
    return [{"piece_index": i, "start": at(s), "fresh": at(f), "end": at(e), "units": e - s, "piece": text[at(s) : at(e)]} for i, (s, f, e) in enumerate(spans)]


def token_edges(text: str, path: str) -> np.ndarray:
    """Prefix sums of a text's tokens; a character of several tokens counts with the last of them."""
    starts = [a for a, _ in load(path).encode(text, add_special_tokens=False).offsets]
    return np.array([*starts, len(text)]) if starts else np.array([0, len(text)])[: 1 + bool(text)]


_PIECES = "array<struct<piece_index:int,start:int,fresh:int,end:int,units:int,piece:string>>"


def split_items(df: DataFrame, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """keep.., piece_index, n_pieces, start, fresh, end, units, piece, in characters.

    Only oversized texts reach Python; the others become their one piece in the JVM.
    """

    @F.pandas_udf(_PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit, overlap))

    rows = df.where(F.col(text).isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in keep], F.col(text).alias("_item"))
    long = rows.where(F.length("_item") > limit).dropDuplicates().withColumn("_all", pieces("_item"))
    out = long.select(*[f"_{c}" for c in keep], F.size("_all").alias("n_pieces"), F.explode("_all").alias("p"))
    out = out.select(*[F.col(f"_{c}").alias(c) for c in keep], "p.piece_index", "n_pieces", "p.start", "p.fresh", "p.end", "p.units", "p.piece")
    if oversized_only:
        return out
    short = rows.where(F.length("_item") <= limit).dropDuplicates()
    whole = short.select(
        *[F.col(f"_{c}").alias(c) for c in keep], F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"),
        F.lit(0).alias("fresh"), F.length("_item").alias("end"), F.length("_item").alias("units"), F.col("_item").alias("piece"),
    )
    return out.unionByName(whole)


def split_by_tokens(df: DataFrame, text: str, keep: list[str], limit: int, overlap: int, path: str | None = None) -> DataFrame:
    """As ``split_items``, with sizes in tokens of a public tokenizer; start, fresh and end are characters."""
    path = path or vocabulary()

    @F.pandas_udf(_PIECES)
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, limit, overlap, token_edges(t, path)))

    rows = df.where(F.col(text).isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in keep], F.col(text).alias("_item")).dropDuplicates()
    out = rows.withColumn("_all", pieces("_item"))
    out = out.select(*[F.col(f"_{c}").alias(c) for c in keep], F.size("_all").alias("n_pieces"), F.explode("_all").alias("p"))
    return out.select(*keep, "p.piece_index", "n_pieces", "p.start", "p.fresh", "p.end", "p.units", "p.piece")
