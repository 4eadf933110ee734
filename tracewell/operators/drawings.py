"""Drawing indexes, pages, layout lines and painted paths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.folding import fold
from tracewell.functions.text import collapsed, round_half_up, title_similarity

# Title patterns by category, first match wins.
CATEGORIES = [
    ("도면목록", r"도면\s*목록"), ("MCC", r"(?i)MCC"), ("보안등", "보안등"), ("조경등", "조경등"), ("태양광", "태양광"), ("피뢰", "피뢰"), ("접지", "접지"), ("수변전", "수변전"),
    ("분전반", "분전반"), ("전력간선", r"전력\s*간선"), ("전등", "전등"), ("전열", "전열"), ("동력", "동력"), ("소방", "소방"), ("기계", "기계"),
]
# Words of a query with other words for them, and words that only command.
ALTERNATIVES = {"간선": ["간선", "전력간선"], "분전함": ["분전함", "분전반"], "수전": ["수전", "수변전"], "결선": ["결선", "결선도"], "결선도": ["결선도", "결선"], "옥탑": ["옥탑", "옥탑층", "옥탑지붕층"]}
COMMANDS = ["검색해줘", "찾아줘", "보여줘", "알려줘", "관련"]
_FLOOR = r"지하\d*층|\d+층|기준(?:\(\d+~\d+\))?층|옥탑지붕층|옥탑층|옥탑|지붕층|pit층"


def title_category(title: Column) -> tuple[Column, Column]:
    """(category, whether several match); 기타 if none does."""
    hits = [F.when(title.rlike(p), F.lit(c)) for c, p in CATEGORIES]
    return F.coalesce(*hits, F.lit("기타")), F.size(F.array_compact(F.array(*hits))) > 1


def canonical_number(text: str) -> str | None:
    m = regex.fullmatch(r"([A-Z]{1,4})(\d{2,4}[A-Z]?)", regex.sub(r"[\s-]+", "", text).upper())
    return f"{m[1]}-{m[2]}" if m else None


def tidy_title(text: str) -> str:
    out = (fold(text) or "").replace("\x00", "").lower()
    for pattern, to in ((r"(\d+)\s*단지", r"\1단지"), (r"(\d{3})\s*동", r"\1동"), (r"지하\s*(\d+)\s*층", r"지하\1층"), (r"(\d+)\s*층", r"\1층"), (r"기준\s*\(\s*(\d+)\s*[~-]\s*(\d+)\s*\)\s*층", r"기준(\1~\2)층"), (r"(\d)\s*kv", r"\1kv")):
        out = regex.sub(pattern, to, out)
    return " ".join(out.split())


def query_units(query: str) -> list[tuple[str, str]]:
    """(kind, canonical) units of a query: drawingNo, complex, building, floor or text; a query without any is refused."""
    text = tidy_title(query)
    for c in COMMANDS:
        text = text.replace(c, " ")
    if whole := canonical_number(text):
        return [("drawingNo", whole)]
    tokens = [t for t in regex.sub(r"[^\p{L}\p{N}.²/()~-]+", " ", text).split() if regex.search(r"[\p{L}\p{N}]", t)]
    units, skip = [], False
    for t, after in zip(tokens, [*tokens[1:], ""]):
        if skip:
            skip = False
            continue
        if regex.fullmatch(r"[a-z]{1,4}-?", t) and after and canonical_number(t + after):
            units.append(("drawingNo", canonical_number(t + after)))
            skip = True
        elif canonical_number(t):
            units.append(("drawingNo", canonical_number(t)))
        elif t != "도면" and len(t) > 1:
            kind = "complex" if regex.fullmatch(r"\d+단지", t) else "building" if regex.fullmatch(r"\d{3}동", t) else "floor" if regex.fullmatch(_FLOOR, t) else "text"
            units.append((kind, t))
    if not units:
        raise ValueError("a query needs a search term")
    return list(dict.fromkeys(units))


def _unit_strength(kind: str, word: str) -> tuple[Column, Column, Column]:
    """(strength, direct, exact metadata) of one unit; a null strength is no match."""
    others = ALTERNATIVES.get(word, [word])
    title, none = F.col("_title"), F.lit(None).cast("double")
    if kind == "drawingNo":
        hit = F.col("drawing_no") == word
        return F.when(hit, 1.0), hit, hit
    if kind in ("complex", "building", "floor"):
        value, cellar = F.col(f"_{kind}"), word == "지하층"
        in_title = F.exists(F.regexp_extract_all("_title", F.lit(f"({_FLOOR})" if kind == "floor" else r"(\d+단지)" if kind == "complex" else r"((?<!\d)\d{3}동)"), 1), lambda v: v.startswith("지하") if cellar else v.isin(*others))
        stored = F.when(F.lit(cellar) & value.startswith("지하"), 0.66).when(value == word, 0.92).when(value.isin(*others), 0.72).otherwise(none)
        exact = F.coalesce((value == word) & ~F.lit(cellar), F.lit(False))
        return F.when(value.isNotNull(), stored).otherwise(F.when(in_title, 0.52 if cellar else 0.62)), exact, exact
    best, direct = none, F.lit(False)
    for i, other in enumerate(others):
        # A longer synonym in the title takes the place of the word it contains.
        hidden = F.lit(False)
        for longer in others[1:] if i == 0 else []:
            if other in longer:
                hidden = hidden | F.contains(title, F.lit(longer))
        s = F.when(F.col("_category") == other, 0.88 if i == 0 else 0.64).when(~hidden & F.contains(title, F.lit(other)), 0.78 if i == 0 else 0.58)
        direct = F.coalesce(s > best, s.isNotNull() & best.isNull(), F.lit(False)) & F.lit(i == 0) if i == 0 else direct & ~F.coalesce(s > best, F.lit(False))
        best = F.greatest(best, s)
    return best, direct, F.lit(False)


def search_drawings(index: DataFrame, query: str, limit: int = 20, filters: dict | None = None) -> DataFrame:
    """The drawings that match every unit of the query, best first.

    index: drawing_no, title, category, complex, building, floor, source_list_page, confidence. The score
    is the mean strength; a lone drawing number scores 1, an equal title at least 0.96.
    """
    if not 1 <= limit <= 100:
        raise ValueError("a limit lies between 1 and 100")
    units = query_units(query)
    rows = index
    for column, value in (filters or {}).items():
        rows = rows.where(F.lower(column) == value.lower())
    for c in ("title", "category", "complex", "building", "floor"):
        rows = rows.withColumn(f"_{c}", collapsed(F.lower(c)))
    parts = [_unit_strength(k, w) for k, w in units]
    for i, (s, _, _) in enumerate(parts):
        rows = rows.withColumn(f"_s{i}", s).where(F.col(f"_s{i}").isNotNull())
    mean = sum((F.col(f"_s{i}") for i in range(len(units))), F.lit(0.0)) / len(units)
    score = F.lit(1.0) if units == [("drawingNo", units[0][1])] else F.when(F.col("_title") == " ".join(w for _, w in units), F.greatest(mean, F.lit(0.96))).otherwise(mean)
    count = lambda j: sum((p[j].cast("int") for p in parts), F.lit(0))
    rows = rows.withColumn("score", round_half_up(score, 4)).withColumn("_direct", count(1)).withColumn("_exact", count(2))
    number = lambda g: F.regexp_extract("drawing_no", r"^([A-Z]{1,4})-(\d{2,4})([A-Z]?)$", g)
    order = [
        F.desc("score"), F.desc("_direct"), F.desc("_exact"), F.desc("confidence"), "source_list_page", number(1), number(2).try_cast("int"), F.length(number(2)), number(3),
        "drawing_no", "title", "category", F.coalesce("complex", F.lit("")), F.coalesce("building", F.lit("")), F.coalesce("floor", F.lit("")),
    ]
    return rows.orderBy(*order).limit(limit).select(*index.columns, "score")


def map_pages(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """source, page, drawing_no, confidence, status from title-block candidates.

    candidates: source, page, drawing_no, detected_title, zone (0..1). A lone indexed number is taken; of
    several the one whose title is most similar, if by 0.15 or more; otherwise the page is ambiguous.
    """
    clean = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    rows = candidates.join(index.select("drawing_no", F.col("title").alias("_indexed")), "drawing_no").dropDuplicates(["source", "page", "drawing_no"])
    found, indexed = clean(F.coalesce("detected_title", F.lit(""))), clean(F.col("_indexed"))
    rows = rows.withColumn("similarity", title_similarity(found, indexed)).withColumn("_same", (found == indexed) & (found != ""))
    page = Window.partitionBy("source", "page")
    w = page.orderBy(F.desc("similarity"), F.desc("zone"), "drawing_no")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(page)).withColumn("_second", F.lead("similarity").over(w)).where("_n = 1")
    clear = (F.col("_all") == 1) | ((F.col("similarity") > 0) & (F.col("similarity") - F.col("_second") >= 0.15))
    title = F.when(F.col("_same"), 0.15).otherwise(F.least(F.lit(0.08), F.col("similarity") * 0.08))
    value = F.lit(0.76) + F.col("zone") * 0.08 + title + F.when(~F.col("_same") & (F.col("similarity") > 0), 0.01).otherwise(0.0) - F.when(F.col("_all") > 1, 0.02).otherwise(0.0)
    return rows.select(
        "source", "page", F.when(clear, F.col("drawing_no")).alias("drawing_no"),
        F.when(clear, round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3)).alias("confidence"), F.when(clear, "MAPPED").otherwise("AMBIGUOUS").alias("status"),
    )


_LAYOUT = "source string, page int, line_id string, text string, item_ids array<string>, x double, y double, width double, height double, rotation double"


def _first_fit(page, box, turns, rotation, centre, thick) -> tuple[list[int], list[int]]:
    """The line of each item, and the first item of each line, lines numbered as they begin; items of a page follow each other.

    box: the lists of x, y, x2, y2 of the items; rotation: its place in turns, (degrees, cosine, sine). An item looks only at
    the cells of lines, by mean centre and size of tolerance, that can reach it; each is compared exactly.
    """
    lines, first, here, (left, top, right, bottom) = [], [], None, box
    total, count, mean, reach, levels_of, places = [], [], [], [], [], []
    floor = math.floor
    for i, code in enumerate(rotation):
        if page[i] != here:
            here, levels, near = page[i], {}, {}
        if code not in near:
            near[code] = [k for k in levels if not _turned(turns[k][0], turns[code][0])]
        best = -1
        for k in near[code]:
            if k == code:
                c, t = centre[i], thick[i]
            else:
                _, cos, sin = turns[k]
                u, u2, v, v2 = left[i] * -sin, right[i] * -sin, top[i] * cos, bottom[i] * cos
                low, high = (u if u < u2 else u2) + (v if v < v2 else v2), (u2 if u < u2 else u) + (v2 if v < v2 else v)
                c, t = (low + high) / 2, high - low
            own = 0.6 * t if t > 2 else max(1.0, 0.6 * t)
            for size, cells in levels[k].items():
                r = (size if size > own else own) * 1.000001 + abs(c) * 1e-15
                # Lines without a finite place, and all lines of a level for a very wide item, are met one by one.
                few = size and c - c == 0 and 2 * r < size * (len(cells) + 3)
                for cell in range(floor((c - r) / size), floor((c + r) / size) + 1) if few else cells:
                    if cell in cells:
                        for n in cells[cell]:
                            if (best < 0 or n < best) and abs(c - mean[n]) <= (own if own > reach[n] else reach[n]):
                                best, at, wide = n, c, own
        if best < 0:
            best, at, wide = len(first), centre[i], max(1.0, 0.6 * thick[i])
            first.append(i), total.append(0), count.append(0), mean.append(0.0), reach.append(0.0), places.append(None)
            if code not in levels:
                levels[code] = {}
                for k, codes in near.items():
                    if not _turned(turns[k][0], turns[code][0]):
                        codes.append(code)
            levels_of.append(levels[code])
        lines.append(best)
        total[best] += at
        count[best] += 1
        mean[best] = middle = total[best] / count[best]
        old, cell = place = places[best] or (None, None)
        size = old
        if wide > reach[best]:
            reach[best] = wide
            size = 2.0 ** math.frexp(wide)[1] if wide < 1e300 else 0.0
        if middle - middle != 0:
            size = 0.0
        now = size, floor(middle / size) if size else 0
        if now != place:
            if old is not None:
                cells = levels_of[best][old]
                cells[cell].remove(best)
                if not cells[cell]:
                    del cells[cell]
            places[best] = now
            levels_of[best].setdefault(size, {}).setdefault(now[1], []).append(best)
    return lines, first


def _turned(a: float, b: float) -> bool:
    turn = abs(a - b) % 360
    return min(turn, 360 - turn) > 2


def _page_lines(items: pa.Table) -> pa.Table:
    """The lines of whole pages, items of a page one after the other."""
    scope = _scopes(items)
    numbers = lambda t, c: t[c].to_numpy(zero_copy_only=False).astype(float)
    ordered = lambda keys: pc.sort_indices(pa.table({str(n): k for n, k in enumerate(keys)}), [(str(n), "ascending") for n in range(len(keys))]).to_numpy()
    order = ordered([scope, *(items[c] for c in ("y", "x", "rotation", "source_order", "item_id"))])
    items, scope = items.take(order), scope[order]
    x, y, rotation = (numbers(items, c) for c in ("x", "y", "rotation"))
    x2, y2 = x + numbers(items, "width"), y + numbers(items, "height")
    degrees, code = np.unique(rotation, return_inverse=True)
    cos, sin = (np.array([f(math.radians(d)) if math.isfinite(d) else math.nan for d in degrees.tolist()]) for f in (math.cos, math.sin))

    def extent(a, b):
        u, u2, v, v2 = x * a, x2 * a, y * b, y2 * b
        return np.minimum(u, u2) + np.minimum(v, v2), np.maximum(u, u2) + np.maximum(v, v2)

    low, high = extent(-sin[code], cos[code])
    box, turns = [a.tolist() for a in (x, y, x2, y2)], list(zip(degrees.tolist(), cos.tolist(), sin.tolist()))
    line, first = (np.array(a) for a in _first_fit(scope.tolist(), box, turns, code.tolist(), ((low + high) / 2).tolist(), (high - low).tolist()))

    way = code[first][line]
    low, high = extent(cos[way], sin[way])
    order = ordered([line, low, high, items["source_order"], items["item_id"]])
    items, line, low, high, scope, way = items.take(order), line[order], low[order], high[order], scope[order], way[order]
    x, y, x2, y2 = x[order], y[order], x2[order], y2[order]
    at, font, eol = numbers(items, "source_order"), items["font_size"].fill_null(0.0).to_numpy(), items["eol"].fill_null(False).to_numpy()
    gap = low[1:] - high[:-1]
    begins = np.r_[True, (line[1:] != line[:-1]) | (gap > 2.5 * np.maximum(np.maximum(font[1:], font[:-1]), 12)) | (eol[:-1] & (at[:-1] < at[1:]))]
    starts = np.flatnonzero(begins)
    ends = np.r_[starts, len(begins)]
    # The texts of a line lie side by side in the buffer: its text is the stretch from its first to its last.
    near = begins | np.r_[True, gap <= 0.5]
    pieces = pc.binary_join_element_wise(pa.array([" ", ""], "large_string").take(pa.array(near.astype(np.int8))), items["text"].fill_null("").cast("large_string").combine_chunks(), pa.scalar("", "large_string"))
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, np.int64)[pieces.offset :][ends]
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), data or pa.py_buffer(b"")).cast("string")
    ids = pa.ListArray.from_arrays(pa.array(ends, "int32"), items["item_id"].combine_chunks())
    left, top = np.minimum.reduceat(x, starts), np.minimum.reduceat(y, starts)
    width, height = np.maximum.reduceat(x2, starts) - left, np.maximum.reduceat(y2, starts) - top
    scope, turn = scope[starts], degrees[way[starts]]
    order = ordered([scope, top, left, turn, text, items["source_order"].take(starts)])
    scope = scope[order]
    number = np.arange(len(order)) - np.searchsorted(scope, scope) + 1
    line_id = pc.binary_join_element_wise("line-", pc.utf8_lpad(pa.array(number).cast("string"), 6, "0"), "")
    taken = items.select(["source", "page"]).take(starts[order])
    columns = [taken["source"], taken["page"], line_id, text.take(pa.array(order)), ids.take(pa.array(order)), *(a[order] for a in (left, top, width, height, turn))]
    return pa.table(columns, ["source", "page", "line_id", "text", "item_ids", "x", "y", "width", "height", "rotation"])


def _scopes(items: pa.Table) -> np.ndarray:
    """The number of each row's page; a page begins where source or page differ from the row before."""
    codes = [items[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("source", "page")]
    return np.cumsum(np.r_[False, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])


def layout_lines(items: DataFrame, together: bool = False) -> DataFrame:
    """Lines of rotated text items: greedy first fit into lines of the same direction and height.

    items: source, page, item_id, text, x, y, width, height, rotation, font_size, eol, source_order. An item
    joins the first line within 2 degrees whose mean centre lies within 0.6 of the larger thickness; lines
    are cut at wide gaps and explicit ends. The result depends on the order of items, page by page; batches
    hold many pages, and a page must fit into one Python worker. together: the caller's plan already keeps
    all items of a page in one partition, one after the other, so they are neither moved nor sorted.
    """

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [(batch["source"][n].as_py(), batch["page"][n].as_py()) for n in (0, batch.num_rows - 1)]
            if held and key != keys[0]:
                yield from _page_lines(pa.Table.from_batches(held).combine_chunks()).to_batches(10_000)
                held = []
            # The last page may go on in the next batch.
            scope = _scopes(pa.Table.from_batches([batch]))
            last = int(np.searchsorted(scope, scope[-1]))
            if last:
                yield from _page_lines(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()).to_batches(10_000)
                held = []
            held.append(batch.slice(last))
            key = keys[1]
        if held:
            yield from _page_lines(pa.Table.from_batches(held).combine_chunks()).to_batches(10_000)

    kinds = {"source": "string", "page": "int", "item_id": "string", "text": "string", "x": "double", "y": "double", "width": "double", "height": "double", "rotation": "double", "font_size": "double", "eol": "boolean"}
    rows = items.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], "source_order")
    if not together:
        # Rows of a page share the hash, a number that sorts faster than text.
        rows = rows.repartition("source", "page").withColumn("_page", F.xxhash64("source", "page")).sortWithinPartitions("_page", "source", "page").drop("_page")
    return rows.mapInArrow(run, _LAYOUT)


def _structure(commands) -> tuple[int, bool, bool, int, bool]:
    """(subpaths, closed, curved, edges that have length, rectangle) of one path."""
    subpaths: list[dict] = []
    for c in commands:
        kind, pts = c["command"], [(p["x"], p["y"]) for p in c["points"]]
        if kind == "M":
            subpaths.append({"start": pts[0], "at": pts[0], "edges": [], "curve": False, "closed": False})
            continue
        s = subpaths[-1]
        to = s["start"] if kind == "Z" else pts[-1]
        s["closed"] |= kind == "Z"
        s["curve"] |= kind in "CQ"
        if kind in "CQ" or math.dist(s["at"], to) > 0:
            s["edges"].append((s["at"], to))
        s["at"] = to
    subpaths = [s for s in subpaths if s["edges"]]
    if not subpaths:
        return 0, False, False, 0, False
    for s in subpaths:
        s["closed"] |= len(s["edges"]) > 2 and math.dist(s["at"], s["start"]) <= 1e-6
    first = subpaths[0]
    closed, curve = all(s["closed"] for s in subpaths), any(s["curve"] for s in subpaths)
    edges = sum(len(s["edges"]) for s in subpaths)
    rectangle = False
    if len(subpaths) == 1 and closed and not curve and edges == 4:
        v = np.array([(b[0] - a[0], b[1] - a[1]) for a, b in first["edges"]])
        n = np.linalg.norm(v, axis=1)
        nxt = np.roll(v, -1, axis=0)
        cross = v[:, 0] * nxt[:, 1] - v[:, 1] * nxt[:, 0]
        square = np.abs((v * nxt).sum(axis=1)) / (n * np.roll(n, -1)) <= 1e-3
        even = np.abs(n[:2] - n[2:]) / np.maximum(n[:2], n[2:]) <= 1e-3
        rectangle = bool(n.min() / n.max() > 1e-4 and square.all() and even.all() and (np.abs(cross) > n.max() ** 2 * 1e-6).all() and len(set(np.sign(cross))) == 1)
    return len(subpaths), closed, curve, edges, rectangle


def classify_primitives(primitives: DataFrame) -> DataFrame:
    """Adds kind, and duplicate_group for equal geometry on a page (numbered by first source order).

    primitives: source, page, primitive_id, source_order, commands, width, height.
    """

    @F.pandas_udf("struct<subpaths:int,closed:boolean,curve:boolean,edges:int,rectangle:boolean>")
    def analyse(commands: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_structure(c) for c in commands], columns=["subpaths", "closed", "curve", "edges", "rectangle"])

    rows = primitives.withColumn("_a", analyse("commands"))
    a = lambda n: F.col(f"_a.{n}")
    kind = (
        F.when((F.col("width") == 0) & (F.col("height") == 0), "zeroLength").when(F.greatest("width", "height") < 1, "tiny").when(a("subpaths") > 1, "compoundPath")
        .when(a("curve"), "curve").when(a("rectangle"), "rectangleCandidate").when(a("closed") & (a("edges") >= 3), "closedPolygon")
        .when((a("subpaths") == 1) & ~a("closed") & (a("edges") >= 2), "polyline").when((a("subpaths") == 1) & ~a("closed") & (a("edges") == 1), "line").otherwise("unknown")
    )
    rows = rows.withColumn("kind", kind).withColumn("_canon", F.sha2(F.to_json("commands"), 256))
    groups = rows.groupBy("source", "page", "_canon").agg(F.count("*").alias("_n"), F.min("source_order").alias("_first")).where("_n > 1")
    number = F.row_number().over(Window.partitionBy("source", "page").orderBy("_first"))
    groups = groups.withColumn("duplicate_group", F.concat(F.lit("duplicate-"), F.lpad(number.cast("string"), 6, "0"))).drop("_n", "_first")
    return rows.join(groups, ["source", "page", "_canon"], "left").drop("_canon", "_a")


_PAINTED = "source string, page int, primitive_id string, source_order int, paint string, line_width double, commands array<struct<command:string,points:array<struct<x:double,y:double>>>>"


def decode_operators(operators: DataFrame) -> DataFrame:
    """Painted paths of pages from their operator lists, in operator order, with a graphics-state stack.

    operators: source, page, position, op (save, restore, transform, lineWidth, path, paint), numbers
    (array<double>), commands, paint. Points come out in page space; an unmatched restore is refused.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, stack, path, out = (np.eye(3), 1.0), [], None, []
        for o in pdf.sort_values("position").itertuples():
            matrix, width = state
            if o.op == "save":
                stack.append(state)
            elif o.op == "restore":
                if not stack:
                    raise ValueError("restore without save")
                state = stack.pop()
            elif o.op == "transform":
                a, b, c, d, e, f = o.numbers
                state = (matrix @ np.array([[a, c, e], [b, d, f], [0, 0, 1.0]]), width)
            elif o.op == "lineWidth":
                state = (matrix, float(o.numbers[0]))
            elif o.op == "path":
                path = o.commands
            elif o.op == "paint" and path is not None:
                place = lambda p, m=matrix: {"x": float(m[0] @ (p["x"], p["y"], 1)), "y": float(m[1] @ (p["x"], p["y"], 1))}
                moved = [{"command": c["command"], "points": [place(p) for p in c["points"]]} for c in path]
                out.append((o.source, o.page, f"primitive-{len(out) + 1:06d}", len(out), o.paint, width, moved))
                path = None
        return pd.DataFrame(out, columns=["source", "page", "primitive_id", "source_order", "paint", "line_width", "commands"])

    return operators.groupBy("source", "page").applyInPandas(run, _PAINTED)
