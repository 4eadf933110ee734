"""Page text to chunks: paragraph packing with overlap, and packing with fixed windows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import clause_of

SIZE, OVERLAP, LEAST, LONG_STEP = 1200, 150, 15, 0.55
_BLANK = re.compile(r"\n{2,}")
_FINE = re.compile(r"(?<=[.!?。])\s+|\n+")


def _paragraphs(text: str) -> list[str]:
    text = re.sub(r"\r\n?", "\n", text)
    tidy = lambda parts: [p for p in (" ".join(x.split()) for x in parts) if p]
    blank = tidy(_BLANK.split(text))
    return blank if len(blank) > 1 else tidy(_FINE.split(text))


def _windows(text: str, size: int) -> list[str]:
    out, at, step = [], 0, int(size * LONG_STEP)
    while True:
        out.append(text[at : at + size].rstrip())
        if at + size >= len(text):
            return out
        at += step


def pack_paragraphs(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Greedy chunks of whole paragraphs; a flushed chunk hands its last characters to the next one."""
    done: list[str] = []
    held = ""
    pieces = [w for p in _paragraphs(text or "") if len(p) >= least for w in (_windows(p, size) if len(p) > size else [p])]
    for p in pieces:
        joined = f"{held}\n\n{p}" if held else p
        if len(joined) <= size:
            held = joined
            continue
        if len(held) >= least:
            done.append(held)
        held = (held[-overlap:] if overlap else "") + p
        if len(held) > size:
            *early, held = _windows(held, size)
            done += early
    done.append(held)
    return [c.rstrip() for c in done if len(c.strip()) >= least]


def pack_with_windows(text: str | None, size: int = 1000, overlap: int = 100) -> list[str]:
    """Paragraphs packed without overlap; one that exceeds the size becomes fixed overlapping windows."""
    done: list[str] = []
    held = ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", (text or "").strip())):
        if not p:
            continue
        if len(p) > size:
            done += [held] if held else []
            held = ""
            at = 0
            while True:
                done.append(p[at : at + size])
                if at + size >= len(p):
                    break
                at += size - overlap
            continue
        joined = f"{held}\n\n{p}" if held else p
        if len(joined) > size:
            done.append(held)
            held = p
        else:
            held = joined
    return done + ([held] if held else [])


def page_chunks(pages: DataFrame, source: str, page: str, text: str, packer=pack_paragraphs) -> DataFrame:
    """source, page, chunk_index, chunk_id, clause (carried on within the page), text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(packer)

    rows = pages.select(F.col(source).alias("source_path"), F.col(page).alias("page"), F.posexplode(run(text)).alias("chunk_index", "text"))
    rows = rows.withColumn("clause", clause_of(F.col("text")))
    name = F.concat_ws("", "source_path", F.lit("#page="), F.col("page").cast("string"), F.lit("#chunk="), F.col("chunk_index").cast("string"))
    return carry_forward(rows.withColumn("chunk_id", name), ["source_path", "page"], "chunk_index", "clause")


def carry_forward(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """The last known value goes on until the next one, within the group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def char_budget(pages: DataFrame, group: list[str], order: list[str], text: str, limit: int) -> DataFrame:
    """Texts in order until ``limit`` characters are used (one separator between two), the last one cut."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))
    rows = pages.withColumn("used", used).where(F.col("used") < limit)
    return rows.withColumn("kept", F.substring(text, F.lit(1), (F.lit(limit) - F.col("used")).cast("int"))).withColumn(
        "truncated", F.length(text) > F.lit(limit) - F.col("used")
    )
