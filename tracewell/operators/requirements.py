"""Requirement statements from positioned text items of pages.

Items become lines page by page (the order of items decides, so this step is a grouped pandas function);
table regions, paragraphs and the context of normative sentences are windows over the lines.
"""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import collapsed

COLUMN_GAP, LEAST_LEADING, MOST_LEADING, CONTEXT_GAP = 72.0, 8.0, 36.0, 36.0
# Endings of normative sentences, and leads that introduce their context.
NORMATIVE = r"(?:하여야\s*한다|할\s*수\s*있다|하여서는\s*아니\s*된다|권장한다|이하이어야\s*한다)[.!?。]?$"
CONTEXT_LEAD = r"^(?:다만|다음(?:의)?\s*경우에는|다음\s+조건에서는|경우에는|조건\s+.+에서는)$"
NOT_A_HEADING = ["참고", "예시"]
_LINES = "source string, page int, line_no int, y double, x double, height double, first_item int, last_item int, separated boolean, text string"


def is_normative(text):
    return text.rlike(NORMATIVE)


def _reading_order(a, b) -> int:
    if abs(b.y - a.y) > 2:
        return 1 if b.y > a.y else -1
    return (a.x > b.x) - (a.x < b.x) or a.source_order - b.source_order


def text_lines(items: DataFrame) -> DataFrame:
    """items: source, page, source_order, str, x, y, width, height. A line is measured against its first item."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(pdf.itertuples(), key=cmp_to_key(_reading_order))
        lines: list[dict] = []
        for n, it in enumerate(ordered):
            line = lines[-1] if lines else None
            if line is None or abs(line["y"] - it.y) > max(2.0, it.height * 0.2):
                line = {"y": it.y, "x": it.x, "height": it.height, "first": n, "items": []}
                lines.append(line)
            line["height"] = max(line["height"], it.height)
            line["items"].append(it)
        rows = []
        for n, line in enumerate(lines):
            shown = [i for i in line["items"] if (i.str or "").strip()]
            apart = any(b.x - (a.x + max(a.width, 0)) >= COLUMN_GAP for a, b in zip(shown, shown[1:]))
            text = " ".join(" ".join((i.str or "") for i in line["items"]).split())
            rows.append((pdf.source.iloc[0], pdf.page.iloc[0], n, line["y"], line["x"], line["height"], line["first"], line["first"] + len(line["items"]), apart, text))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _LINES.split(", ")])

    return items.groupBy("source", "page").applyInPandas(run, _LINES)


def mark_tables(lines: DataFrame) -> DataFrame:
    """in_table: at least two lines in a row with a column gap and an even leading. Gaps and islands."""
    w = Window.partitionBy("source", "page").orderBy("line_no")
    leading = F.lag("y").over(w) - F.col("y")
    joins = F.coalesce(F.col("separated") & F.lag("separated").over(w) & leading.between(LEAST_LEADING, MOST_LEADING), F.lit(False))
    rows = lines.withColumn("_run", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    n = F.count("*").over(Window.partitionBy("source", "page", "_run"))
    return rows.withColumn("in_table", F.col("separated") & (n >= 2)).drop("_run")


def paragraphs(lines: DataFrame) -> DataFrame:
    """source, page, paragraph, region, first and last line's place and the statement, tables left out."""
    w = Window.partitionBy("source", "page").orderBy("line_no")
    rows = mark_tables(lines)
    enters = F.col("in_table") & ~F.coalesce(F.lag("in_table").over(w), F.lit(False))
    rows = rows.withColumn("region", F.sum(F.when(enters, 1).otherwise(0)).over(w)).withColumn("_after_table", F.coalesce(F.lag("in_table").over(w), F.lit(True)))
    rows = rows.where(~F.col("in_table"))
    gap = F.lag("y").over(w) - F.col("y")
    starts = F.col("_after_table") | F.coalesce(gap > F.greatest(F.lag("height").over(w), F.col("height")) * 1.5, F.lit(True))
    rows = rows.withColumn("paragraph", F.sum(F.when(starts, 1).otherwise(0)).over(w) - 1)
    one = F.sort_array(F.collect_list(F.struct("line_no", "y", "x", "height", "text")))
    out = rows.groupBy("source", "page", "paragraph", "region").agg(one.alias("l"), F.min("first_item").alias("first_item"), F.max("last_item").alias("last_item"))
    head, tail = F.col("l")[0], F.element_at("l", -1)
    return out.select(
        "source", "page", "paragraph", "region", "first_item", "last_item", F.size("l").alias("n_lines"), head["y"].alias("top"), head["x"].alias("x"), head["height"].alias("height"),
        tail["y"].alias("bottom"), collapsed(F.array_join(F.col("l.text"), " ")).alias("statement"),
    )


def requirements(lines: DataFrame) -> DataFrame:
    """source, page, paragraph, statement, n_fragments, first_item, last_item of every normative paragraph.

    The preceding context paragraphs are attached; a context that does not stand close above suppresses
    the requirement. Walking back means: everything after the last paragraph that breaks the walk.
    """
    w = Window.partitionBy("source", "page").orderBy("paragraph")
    rows = paragraphs(lines).withColumn("normative", is_normative(F.col("statement")))
    child = lambda c: F.lead(c).over(w)
    text = F.col("statement")
    heading = (
        (F.col("n_lines") == 1) & F.length(text).between(1, 12) & ~text.isin(*NOT_A_HEADING) & ~text.rlike(r"\s") & ~text.rlike(r"[.!?。:：]$")
        & (F.col("height") >= child("height")) & (F.abs(F.col("x") - child("x")) <= 12)
    )
    candidate = F.coalesce((F.col("region") == child("region")) & ~F.col("normative") & (text.rlike(CONTEXT_LEAD) | heading), F.lit(False))
    gap = F.col("bottom") - child("top")
    rows = rows.withColumn("_candidate", candidate).withColumn("_near", F.coalesce((gap > 0) & (gap <= CONTEXT_GAP), F.lit(False)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_break", F.max(F.when(~(F.col("_candidate") & F.col("_near")), F.struct("paragraph", "_candidate"))).over(before))
    found = rows.where(F.col("normative") & ~F.coalesce(F.col("_break._candidate"), F.lit(False)))
    found = found.select("source", "page", F.col("paragraph").alias("at"), F.coalesce(F.col("_break.paragraph") + 1, F.lit(0)).alias("from"))
    parts = found.join(rows.select("source", "page", "paragraph", "statement", "first_item", "last_item"), ["source", "page"]).where(F.col("paragraph").between(F.col("from"), F.col("at")))
    whole = parts.groupBy("source", "page", "at").agg(
        F.sort_array(F.collect_list(F.struct("paragraph", "statement"))).alias("f"), F.min("first_item").alias("first_item"), F.max("last_item").alias("last_item")
    )
    return whole.select("source", "page", F.col("at").alias("paragraph"), collapsed(F.array_join(F.col("f.statement"), " ")).alias("statement"), F.size("f").alias("n_fragments"), "first_item", "last_item")
