"""Drawing lists and title blocks from positioned text items.

Blocks, bounds, tokens, matches and confidences are windows and joins within a page. Only the grouping of
items into rows by a running mean depends on the order of items; it is a grouped pandas function over the
items of one page, block and role.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import collapsed, nfkc
from tracewell.operators.drawings import map_pages, title_category
from tracewell.session import cut

# Forms of tokens, words of headers, reaches in points, zones in shares of the page.
NUMBER, PREFIX, SUFFIX, SCALE = r"^[A-Z]{1,4}-\d{2,4}[A-Z]?$", r"^[A-Z]{1,4}-$", r"^\d{2,4}[A-Z]?$", r"^\d+/\d+$"
HEADERS = {"도면번호": "number", "도면명": "title", "A1": "scale_a1", "A3": "scale_a3"}
FLOORS = [r"지하\d+층", r"기준\([^)]*\)층", "기준층", "옥탑지붕층", "옥탑층", "지붕층", "(?i)PIT층", r"\d+층"]
ROW, SAME_ROW, LEAST_CONFIDENCE = 6.0, 0.75, 0.75
NUMBER_ZONE, TITLE_ZONE = (0.095, 0.125, 0.07, 0.17), (0.13, 0.21, 0.075, 0.18)
NUMBER_COLUMN, SAME_COLUMN = 65.9 / 595, 0.0035


def group_rows(items: DataFrame, scope: list[str], along: str, across: str, tolerance: float, rising: bool = False) -> DataFrame:
    """Adds row_at: the mean place of the row an item belongs to.

    Items are taken in the order of ``along``, then falling ``across``; each joins the first row whose mean so
    far lies within the tolerance, or begins one. A scope is one page or part of a page.
    """
    schema = items.withColumn("row_at", F.lit(0.0)).schema

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole scopes, one after the other in order."""
        fresh = (pdf[scope].ne(pdf[scope].shift())).any(axis=1).tolist()
        totals, counts, first, at = [], [], 0, []
        for new, x in zip(fresh, pdf[along].tolist()):
            first = len(totals) if new else first
            for n in range(first, len(totals)):
                if abs(totals[n] / counts[n] - x) <= tolerance:
                    break
            else:
                n = len(totals)
                totals.append(0.0), counts.append(0)
            totals[n] += x
            counts[n] += 1
            at.append(n)
        return pdf.assign(row_at=[totals[n] / counts[n] for n in at])

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            # The last scope may go on in the next batch.
            last = pdf[scope].eq(pdf[scope].iloc[-1]).all(axis=1)
            yield rows_of(pdf[~last])
            held = pdf[last]
        if held is not None:
            yield rows_of(held)

    order = [F.asc(along) if rising else F.desc(along), F.desc(across)]
    return items.repartition(*scope).sortWithinPartitions(*scope, *order).mapInPandas(run, schema)


def _first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def list_blocks(items: DataFrame) -> DataFrame:
    """page, block, the x and y of each header, upper and lower: headers of a kind zipped by their rank from the top.

    items: page, token, x, y. As many blocks as every kind has headers; a block ends half way to the next one.
    """
    kind = F.coalesce(*[F.when(F.upper("token") == word, F.lit(k)) for word, k in HEADERS.items()])
    heads = items.withColumn("kind", kind).where("kind is not null")
    heads = heads.withColumn("block", F.row_number().over(Window.partitionBy("page", "kind").orderBy(F.desc("y"), "x")) - 1)
    wide = heads.groupBy("page", "block").pivot("kind", list(HEADERS.values())).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    wide = wide.where(" and ".join(f"{k}_y is not null" for k in HEADERS.values()))
    w = Window.partitionBy("page").orderBy("block")
    return wide.withColumn("upper", F.coalesce((F.lag("scale_a3_y").over(w) + F.col("number_y")) / 2, F.lit(float("inf")))).withColumn(
        "lower", F.coalesce((F.col("scale_a3_y") + F.lead("number_y").over(w)) / 2, F.col("scale_a3_y") - 100)
    )


def parse_drawing_list(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drawings, warnings) of the list pages. items: page, str, x, y, width.

    drawings: page, block, row, drawing_no, title, category, complex, building, floor, scale_a1, scale_a3,
    confidence, raw_text; warnings: page, block, row, message. Rows whose number or title is ambiguous are left out;
    the second record of a drawing number is reported and kept.
    """
    rows = items.select("page", collapsed(F.translate(nfkc(F.col("str")), "\0", " ")).alias("text"), "x", "y", "width").where("text <> ''").distinct()
    rows = rows.withColumn("token", F.regexp_replace("text", r"\s", ""))
    # Each of these small tables is read by several branches below.
    rows = cut(rows)
    blocks = cut(list_blocks(rows))
    pages = items.select("page").distinct()
    warn = [pages.join(blocks.select("page").distinct(), "page", "left_anti").select("page", F.lit(0).alias("block"), F.lit(0).alias("row"), F.lit("drawing list table was not detected on this page").alias("message"))]
    inside = rows.join(blocks, "page").where((F.col("y") <= F.col("upper")) & (F.col("y") >= F.col("lower")))
    big = F.upper("token")
    is_number, is_scale = big.rlike(NUMBER) | big.rlike(PREFIX) | big.rlike(SUFFIX), (big == "NONE") | F.col("token").rlike(SCALE)
    left = F.col("x") < F.col("number_x") - 8

    # Numbers: a row with one whole number, or with one beginning and one end.
    numbers = group_rows(inside.where(is_number & left & (F.abs(F.col("y") - F.col("number_y")) <= 25)).select("page", "block", big.alias("token"), "x", "y"), ["page", "block"], "x", "y", SAME_ROW)
    kinds = numbers.groupBy("page", "block", "row_at").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("token").rlike(p), F.col("token")))).alias(n) for n, p in (("full", NUMBER), ("prefix", PREFIX), ("suffix", SUFFIX))]
    )
    made = F.concat(F.try_element_at("prefix", F.lit(1)), F.try_element_at("suffix", F.lit(1)))
    size = lambda a, b, c: (F.size("full") == a) & (F.size("prefix") == b) & (F.size("suffix") == c)
    number = F.when(size(1, 0, 0), F.try_element_at("full", F.lit(1))).when(size(0, 1, 1) & made.rlike(NUMBER), made)
    kinds = kinds.select("page", "block", "row_at", number.alias("drawing_no")).withColumn("row", F.row_number().over(Window.partitionBy("page", "block").orderBy(F.desc("row_at"))))
    at, kinds = ["page", "block", "row"], cut(kinds)
    warn.append(kinds.where("drawing_no is null").select(*at, F.lit("ambiguous drawing number row was omitted").alias("message")))

    # Titles: rows of the other items; the nearest row within reach, unless two are as near.
    headers = F.upper("token").isin(*HEADERS)
    titles = inside.where(left & (F.col("y") <= F.col("number_y") - 8) & ~is_number & ~is_scale & ~headers).select("page", "block", "text", "x", "y")
    titles = group_rows(titles, ["page", "block"], "x", "y", SAME_ROW)
    said = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), "text")))["text"]
    titles = titles.groupBy("page", "block", F.col("row_at").alias("title_at")).agg(collapsed(F.array_join(said, " ")).alias("title"))
    titles = cut(titles)
    near = kinds.join(titles, ["page", "block"]).withColumn("away", F.abs(F.col("row_at") - F.col("title_at"))).where(F.col("away") <= ROW)
    best = near.groupBy(*at).agg(F.min("away").alias("least"))
    ties = near.join(best, at).where(F.col("away") - F.col("least") <= 0.001).groupBy(*at).agg(F.count("*").alias("n"), F.first("title").alias("title"))
    listed = cut(kinds.where("drawing_no is not null").join(ties, at, "left"))
    none, several = F.concat(F.lit("title is missing for drawing "), "drawing_no"), F.concat(F.lit("ambiguous title row for drawing "), "drawing_no", F.lit(" was omitted"))
    warn.append(listed.where("n is null").select(*at, none.alias("message")))
    warn.append(listed.where("n > 1").select(*at, several.alias("message")))
    counted = kinds.groupBy("page", "block").agg(F.count("*").alias("n_rows"))
    orphans = titles.join(near.select("page", "block", "title_at").distinct(), ["page", "block", "title_at"], "left_anti").join(counted, ["page", "block"], "left")
    orphans = orphans.withColumn("row", F.coalesce("n_rows", F.lit(0)) + F.row_number().over(Window.partitionBy("page", "block").orderBy(F.desc("title_at"))))
    warn.append(orphans.select("page", "block", F.col("row").cast("int").alias("row"), F.concat(F.lit("drawing number is missing for orphan title: "), "title").alias("message")))

    # Scales: the nearest scale text to the row, then to its header.
    listed = listed.where("n = 1").select(*at, "row_at", "drawing_no", "title").join(blocks.select("page", "block", "scale_a1_y", "scale_a3_y", "upper", "lower"), ["page", "block"])
    scales = rows.where(is_scale).select("page", F.col("token").alias("scale"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    for kind in ("scale_a1", "scale_a3"):
        met = listed.join(scales, "page").where((F.col("sy") <= F.col("upper")) & (F.col("sy") >= F.col("lower")))
        across, up = F.abs(F.col("sx") - F.col("row_at")), F.abs(F.col("sy") - F.col(f"{kind}_y"))
        found = met.where((across <= ROW) & (up <= 15)).groupBy(*at).agg(F.min_by("scale", F.struct(across, up, "scale")).alias(kind))
        listed = listed.join(found, at, "left")
    title = F.col("title")
    category, several = title_category(title)
    out = listed.select(
        *at, "drawing_no", "title", category.alias("category"), several.alias("several"), _first_match(title, [r"\d+단지"]).alias("complex"), _first_match(title, [r"\d{3}동"]).alias("building"),
        _first_match(title, FLOORS).alias("floor"), "scale_a1", "scale_a3",
    )
    part = lambda when, value: F.when(when, F.lit(value)).otherwise(F.lit(0.0))
    known = F.col("complex").isNotNull() | F.col("building").isNotNull() | F.col("floor").isNotNull() | (F.col("category") != "기타")
    value = F.lit(0.8) + part(F.col("scale_a1").isNotNull(), 0.075) + part(F.col("scale_a3").isNotNull(), 0.075) + part(known, 0.05) - part(F.col("several"), 0.1)
    out = cut(out).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3))
    warn.append(out.where("several").select(*at, F.concat(F.lit("category conflict for "), "drawing_no").alias("message")))
    warn.append(out.where(F.col("confidence") < LEAST_CONFIDENCE).select(*at, F.concat(F.lit("low-confidence drawing "), "drawing_no", F.lit(" was omitted")).alias("message")))
    stated = lambda c: F.when(F.upper(c) != "NONE", F.col(c))
    out = out.where(F.col("confidence") >= LEAST_CONFIDENCE).drop("several").withColumn("scale_a1", stated("scale_a1")).withColumn("scale_a3", stated("scale_a3"))
    shown = lambda c: F.coalesce(F.col(c), F.lit("NONE"))
    out = out.withColumn("raw_text", F.concat("drawing_no", F.lit(" | "), "title", F.lit(" | A1:"), shown("scale_a1"), F.lit(" | A3:"), shown("scale_a3")))
    second = out.withColumn("_n", F.row_number().over(Window.partitionBy("drawing_no").orderBy(*at))).where("_n = 2")
    warn.append(second.select(*at, F.concat(F.lit("duplicate drawing number "), "drawing_no").alias("message")))
    warnings = warn[0]
    for w in warn[1:]:
        warnings = warnings.unionByName(w)
    return out, warnings


def canonical(text: Column) -> Column:
    """A drawing number in its written form, null for other texts."""
    flat = F.regexp_replace(F.upper(text), r"[\s-]+", "")
    return F.when(flat.rlike(r"^[A-Z]{1,4}\d{2,4}[A-Z]?$"), F.regexp_replace(flat, r"^([A-Z]+)(.*)$", "$1-$2"))


def in_zone(x: Column, y: Column, zone: tuple) -> Column:
    return x.between(zone[0], zone[1]) & y.between(zone[2], zone[3])


def page_candidates(items: DataFrame) -> DataFrame:
    """source, page, drawing_no, detected_title, zone: the numbers that the title block of each page can be read as.

    items: source, page, str, x, y, page_width, page_height. A column of texts in the number zone is read
    from each of its items downwards, and item by item.
    """
    text = collapsed(F.translate(nfkc(F.col("str")), "\0", " "))
    rows = items.where("page_width > 0 and page_height > 0").select("source", "page", text.alias("text"), (F.col("x") / F.col("page_width")).alias("x"), (F.col("y") / F.col("page_height")).alias("y")).where("text <> ''")
    x, y, page = F.col("x"), F.col("y"), ["source", "page"]
    columns = group_rows(rows.where(in_zone(x, y, NUMBER_ZONE)), page, "x", "y", SAME_COLUMN, rising=True)
    order = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), "text")))["text"]
    columns = columns.groupBy(*page, "row_at").agg(order.alias("texts"))
    tails = F.transform(F.sequence(F.lit(1), F.size("texts")), lambda i: F.array_join(F.slice("texts", i, F.size("texts")), ""))
    read = columns.select(*page, "row_at", F.explode(F.array_distinct(F.concat(tails, F.col("texts")))).alias("text"))
    read = read.select(*page, "row_at", canonical(F.col("text")).alias("drawing_no")).where("drawing_no is not null").distinct()
    titles = rows.where(in_zone(x, y, TITLE_ZONE) & (F.col("text") != "NONE") & ~F.col("text").rlike(r"^\d+/\d+$"))
    said = F.array_sort(F.collect_list(F.struct((-F.col("x")).alias("x"), (-F.col("y")).alias("y"), "text")))["text"]
    titles = titles.groupBy(*page).agg(F.nullif(collapsed(F.array_join(said, "")), F.lit("")).alias("detected_title"))
    zone = F.greatest(F.lit(0.0), 1 - F.abs(F.col("row_at") - NUMBER_COLUMN) / 0.02)
    best = read.groupBy(*page, "drawing_no").agg(F.max(F.struct("row_at", zone.alias("zone")))["zone"].alias("zone"))
    return best.join(titles, page, "left")


def parse_pages(items: DataFrame, index: DataFrame) -> DataFrame:
    """source, page, drawing_no, confidence, status of each page with a number of the index in its title block."""
    return map_pages(page_candidates(items), index)
