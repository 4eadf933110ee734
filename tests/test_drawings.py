import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewell.operators import drawings, requirements
from tracewell.plans import drawings as plans

INDEX = "drawing_no string, title string, category string, complex string, building string, floor string, source_list_page int, confidence double"
ROWS = [
    ("E-101", "1단지 101동 지하1층 전등 평면도", "전등", "1단지", "101동", "지하1층", 1, 0.9),
    ("E-102", "수변전 단선결선도", "수변전", None, None, None, 1, 0.9),
    ("E-11", "전력간선 계통도", "전력간선", None, None, None, 2, 0.9),
    ("E-103A", "접지 평면도 3층", "접지", None, None, None, 2, 0.8),
]


def found(spark, query, **kw):
    return [(r["drawing_no"], r["score"]) for r in drawings.search_drawings(spark.createDataFrame(ROWS, INDEX), query, **kw).collect()]


def test_search(spark):
    assert found(spark, "E 102 찾아줘") == [("E-102", 1.0)]
    assert found(spark, "101동 전등 도면 보여줘") == [("E-101", 0.9)]
    assert found(spark, "수전") == [("E-102", 0.64)]
    assert found(spark, "간선") == [("E-11", 0.64)]
    assert found(spark, "접지 3층") == [("E-103A", round((0.88 + 0.62) / 2, 4))]
    assert found(spark, "지하층") == [("E-101", 0.66)]
    assert found(spark, "평면도", filters={"floor": "지하1층"}) == [("E-101", 0.78)]
    assert found(spark, "접지 평면도 3층") == [("E-103A", 0.96)]
    for bad in ("도면", "  "):
        with pytest.raises(ValueError):
            found(spark, bad)
    with pytest.raises(ValueError):
        found(spark, "전등", limit=0)


def test_title_category(spark):
    df = spark.createDataFrame([("수변전 접지 계통도",), ("MCC 결선",), ("목차",), (None,)], "t string")
    c, several = drawings.title_category(F.col("t"))
    assert [tuple(r) for r in df.select(c, several).collect()] == [("접지", True), ("MCC", False), ("기타", False), ("기타", False)]


def test_page_map(spark):
    cands = [("s", 1, "E-101", None, 1.0), ("s", 2, "E-102", "수변전 단선결선도", 0.5), ("s", 2, "E-11", "수변전 단선결선도", 1.0), ("s", 3, "E-11", None, 1.0), ("s", 3, "E-102", None, 1.0), ("s", 4, "X-1", None, 1.0)]
    out = drawings.map_pages(spark.createDataFrame(cands, "source string, page int, drawing_no string, detected_title string, zone double"), spark.createDataFrame(ROWS, INDEX))
    got = {r["page"]: (r["drawing_no"], r["confidence"], r["status"]) for r in out.collect()}
    assert got == {1: ("E-101", 0.84, "MAPPED"), 2: ("E-102", round(0.76 + 0.04 + 0.15 - 0.02, 3), "MAPPED"), 3: (None, None, "AMBIGUOUS")}


def test_layout(spark):
    item = "source string, page int, item_id string, text string, x double, y double, width double, height double, rotation double, font_size double, eol boolean, source_order int"
    rows = [
        ("s", 1, "a", "Main", 10.0, 10.0, 20.0, 10.0, 0.0, 10.0, False, 0), ("s", 1, "b", "panel", 33.0, 11.0, 20.0, 10.0, 0.0, 10.0, False, 1), ("s", 1, "c", "s", 53.2, 11.0, 4.0, 10.0, 0.0, 10.0, False, 2),
        ("s", 1, "d", "far", 200.0, 10.0, 20.0, 10.0, 0.0, 10.0, False, 3), ("s", 1, "e", "below", 10.0, 40.0, 20.0, 10.0, 0.0, None, True, 4), ("s", 1, "f", "up", 300.0, 10.0, 10.0, 20.0, 90.0, 10.0, False, 5),
    ]
    out = drawings.layout_lines(spark.createDataFrame(rows, item)).orderBy("line_id").collect()
    assert [(r["text"], r["item_ids"]) for r in out] == [("Main panels", ["a", "b", "c"]), ("far", ["d"]), ("up", ["f"]), ("below", ["e"])]


ITEM = "source string, page int, item_id string, text string, x double, y double, width double, height double, rotation double, font_size double, eol boolean, source_order int"


def fitted(items):
    """The item_ids of each line, by comparing each item with every line so far."""
    lines = []
    for it in sorted(items, key=lambda r: (r[5], r[4], r[8], r[11], r[2])):
        def project(degrees):
            c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
            corners = [(it[4] + a * it[6], it[5] + b * it[7]) for a in (0, 1) for b in (0, 1)]
            along, across = [x * c + y * s for x, y in corners], [x * -s + y * c for x, y in corners]
            return min(along), max(along), (min(across) + max(across)) / 2, max(across) - min(across), it

        for turn, line in lines:
            p, away = project(turn), abs(turn - it[8]) % 360
            if min(away, 360 - away) <= 2 and abs(p[2] - sum(q[2] for q in line) / len(line)) <= max(1, 0.6 * max(q[3] for q in [p, *line])):
                line.append(p)
                break
        else:
            lines.append((it[8], [project(it[8])]))
    out = []
    for _, line in lines:
        part = []
        for p in sorted(line, key=lambda q: (q[0], q[1], q[4][11])):
            if part and (p[0] - part[-1][1] > 2.5 * max(part[-1][4][9] or 0, p[4][9] or 0, 12) or part[-1][4][10] and part[-1][4][11] < p[4][11]):
                out.append(part)
                part = []
            part.append(p)
        out.append(part)
    return sorted([q[4][2] for q in part] for part in out)


def test_layout_against_all_lines(spark):
    """Pages in pieces of 50 rows, slanted, tall and flat items, unknown font sizes."""
    rnd, rows = random.Random(5), []
    for page in range(40):
        turns = rnd.choice([[0.0], [0.0, 0.5, 90.0], [0.0, 1.5, 3.0, 359.0, -1.0]])
        for n in range(rnd.choice([1, 5, 120])):
            at = round(rnd.uniform(0, 600), 1), round(rnd.uniform(0, 500))
            rows.append(("s", page, f"{page}-{n}", "w", float(at[0]), float(at[1]), 30.0, rnd.choice([0.0, 10.0, 10.0, 40.0, 300.0]), rnd.choice(turns), rnd.choice([None, 10.0, 30.0]), rnd.random() < 0.2, n))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = drawings.layout_lines(spark.createDataFrame(rnd.sample(rows, len(rows)), ITEM)).select("page", "item_ids").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for page in range(40):
        assert sorted(r["item_ids"] for r in got if r["page"] == page) == fitted([r for r in rows if r[1] == page])


def test_layout_of_a_long_page(spark):
    """6,000 lines of one page: an item meets only the lines near it."""
    rows = spark.range(12_000).selectExpr(
        "'s' AS source", "1 AS page", "format_string('i%05d', id) AS item_id", "if(id % 2 = 0, 'a', 'b') AS text", "(id % 2) * 30.0D AS x", "floor(id / 2) * 20.0D AS y",
        "20.0D AS width", "10.0D AS height", "0.0D AS rotation", "10.0D AS font_size", "false AS eol", "CAST(id AS INT) AS source_order",
    )
    began = time.monotonic()
    out = drawings.layout_lines(rows).groupBy("text").count().collect()
    assert [tuple(r) for r in out] == [("a b", 6_000)] and time.monotonic() - began < 30


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_layout_query_keeps_pages_together(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, plans.layout_lines(spark, "/root/testdata/sf0.001").collect()))
    found, own = rows(), drawings.layout_lines
    monkeypatch.setattr(drawings, "layout_lines", lambda items, together: own(items))
    assert found == rows()


def path(*steps):
    return [{"command": c, "points": [{"x": float(x), "y": float(y)} for x, y in p]} for c, p in steps]


SQUARE = path(("M", [(0, 0)]), ("L", [(10, 0)]), ("L", [(10, 10)]), ("L", [(0, 10)]), ("Z", []))
LINE = path(("M", [(0, 0)]), ("L", [(10, 0)]))
COMMANDS = "array<struct<command:string,points:array<struct<x:double,y:double>>>>"


def test_primitives(spark):
    cases = {
        "rectangleCandidate": SQUARE, "line": LINE, "polyline": LINE + path(("L", [(10, 5)])), "closedPolygon": path(("M", [(0, 0)]), ("L", [(10, 0)]), ("L", [(5, 9)]), ("Z", [])),
        "curve": path(("M", [(0, 0)]), ("C", [(1, 1), (2, 2), (9, 3)])), "compoundPath": LINE + SQUARE,
    }
    rows = [("s", 1, k, i, c, 10.0, 10.0) for i, (k, c) in enumerate(cases.items())] + [("s", 1, "twin", 9, SQUARE, 10.0, 10.0), ("s", 1, "dot", 10, LINE, 0.0, 0.0), ("s", 1, "tiny", 11, LINE, 0.5, 0.1)]
    out = drawings.classify_primitives(spark.createDataFrame(rows, f"source string, page int, primitive_id string, source_order int, commands {COMMANDS}, width double, height double")).collect()
    got = {r["primitive_id"]: (r["kind"], r["duplicate_group"]) for r in out}
    assert all(got[k][0] == k for k in cases) and got["dot"][0] == "zeroLength" and got["tiny"][0] == "tiny"
    assert got["twin"][1] == got["rectangleCandidate"][1] == "duplicate-000001" and got["line"][1] == got["dot"][1] == "duplicate-000002"


def test_operators(spark):
    rows = [
        (0, "save", None, None, None), (1, "transform", [2.0, 0.0, 0.0, 2.0, 5.0, 0.0], None, None), (2, "lineWidth", [3.0], None, None), (3, "path", None, LINE, None), (4, "paint", None, None, "stroke"),
        (5, "restore", None, None, None), (6, "path", None, LINE, None), (7, "paint", None, None, "fill"), (8, "paint", None, None, "fill"),
    ]
    df = spark.createDataFrame([("s", 1, *r) for r in rows], f"source string, page int, position int, op string, numbers array<double>, commands {COMMANDS}, paint string")
    out = drawings.decode_operators(df).orderBy("source_order").collect()
    assert [(r["paint"], r["line_width"], r["commands"][1]["points"][0]["x"]) for r in out] == [("stroke", 3.0, 25.0), ("fill", 1.0, 10.0)]


def test_requirements(spark):
    text = [
        (700, 50, "다음 경우에는"), (680, 50, "접지선을 설치하여야 한다."), (600, 50, "일반"), (580, 50, "표지를 부착할 수 있다."), (500, 50, "설명 문장이다."), (480, 50, "보호장치를 권장한다."),
        (400, 50, "a"), (400, 300, "b"), (380, 50, "c"), (380, 300, "d하여야 한다"), (300, 50, "경우에는"), (200, 50, "별도로 설치하여야 한다"),
    ]
    rows = [("s", 1, i, t, float(x), float(y), 60.0, 10.0) for i, (y, x, t) in enumerate(text)]
    lines = requirements.text_lines(spark.createDataFrame(rows, "source string, page int, source_order int, str string, x double, y double, width double, height double"))
    got = [(r["statement"], r["n_fragments"]) for r in requirements.requirements(lines).orderBy("paragraph").collect()]
    assert got == [("다음 경우에는 접지선을 설치하여야 한다.", 2), ("일반 표지를 부착할 수 있다.", 2), ("보호장치를 권장한다.", 1)]
    assert requirements.mark_tables(lines).where("in_table").count() == 2
