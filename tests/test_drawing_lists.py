import pytest
from pyspark.sql import functions as F

from tracewell.operators import drawing_lists as D

I = "page int, str string, x double, y double, width double, block string"


def page(number=1, top=700.0):
    heads = [(number, w, 500.0, top - d, 30.0, "clash") for w, d in (("도면 번호", 0), ("도면명", 60), ("A1", 200), ("A3", 240))]
    row = lambda n, no, title, a1=None, a3=None, off=0.0: [
        *[(number, t, 480.0 - 12 * n + dx, top - dy, 20.0, "") for t, dx, dy in no], *([(number, title, 480.0 - 12 * n + off, top - 60, 90.0, "")] if title else []),
        *([(number, a1, 480.0 - 12 * n, top - 199, 9.0, "")] if a1 else []), *([(number, a3, 480.0 - 12 * n, top - 241, 9.0, "")] if a3 else []),
    ]
    return heads + row(0, [("Ｅ-001", 0, 0)], "101동 3층 전열", "1 / 100", "none") + row(1, [("E-", 0, 0), ("002A", 0.3, 4)], "접지 소방 평면도") + row(2, [("E-003", 0, 0), ("E-004", 0, 5)], "일반") + row(
        3, [("E-001", 0, 0)], "목록", None, "1/50", 2.0) + row(4, [], "외톨이") + row(6, [("E-009", 0, 0)], None)


def test_list(spark):
    rows = page() + page(1, 300.0)[:8] + [(2, "nothing here", 1.0, 1.0, 1.0, ""), (2, None, 1.0, 1.0, 1.0, ""), (1, " ", 400.0, 640.0, 1.0, "")]
    drawings, warnings = D.parse_drawing_list(spark.createDataFrame(rows + rows[:5], I))
    got = {(r.block, r.row): r for r in drawings.collect()}
    assert [got[k].drawing_no for k in sorted(got)] == ["E-001", "E-002A", "E-001", "E-001"]
    first = got[0, 1]
    assert (first.building, first.floor, first.category, first.scale_a1, first.scale_a3, first.confidence) == ("101동", "3층", "전열", "1/100", None, 1.0)
    assert got[0, 2].confidence == 0.75 and got[0, 4].scale_a3 == "1/50" and first.raw_text == "E-001 | 101동 3층 전열 | A1:1/100 | A3:NONE"
    said = {(r.page, r.block, r.row, r.message) for r in warnings.collect()}
    assert said >= {
        (2, 0, 0, "drawing list table was not detected on this page"), (1, 0, 3, "ambiguous drawing number row was omitted"), (1, 0, 5, "title is missing for drawing E-009"),
        (1, 0, 2, "category conflict for E-002A"), (1, 0, 4, "duplicate drawing number E-001"), (1, 0, 6, "drawing number is missing for orphan title: 외톨이"),
    }
    empty, none = D.parse_drawing_list(spark.createDataFrame([], I))
    assert empty.count() == 0 == none.count()


def test_rows_by_running_mean(spark):
    items = spark.createDataFrame([(1, float(x), 0.0) for x in (10.0, 9.5, 9.0, 8.4, 5.0)], "page int, x double, y double")
    assert [round(r.row_at, 3) for r in D.group_rows(items, ["page"], "x", "y", 0.75).orderBy(F.desc("x")).collect()] == [9.5, 9.5, 9.5, 8.4, 5.0]
    assert D.group_rows(items.limit(0), ["page"], "x", "y", 0.75).count() == 0


def test_pages(spark):
    P = "source string, page int, str string, x double, y double, page_width double, page_height double"
    at = lambda page, text, x, y: ("s", page, text, x * 600, y * 800, 600.0, 800.0)
    items = [at(1, "e", 0.11, 0.16), at(1, "001", 0.111, 0.12), at(1, "접지 평면도", 0.15, 0.1), at(2, "E-002", 0.11, 0.1), at(2, "E 003", 0.12, 0.1), at(3, "E-001", 0.5, 0.1), at(4, None, 0.11, 0.1), ("s", 5, "E-001", 66.0, 80.0, 0.0, 0.0)]
    index = spark.createDataFrame([("E-001", "접지 평면도"), ("E-002", "a"), ("E-003", "b")], "drawing_no string, title string")
    got = {r.page: (r.drawing_no, r.status) for r in D.parse_pages(spark.createDataFrame(items, P), index).collect()}
    assert got == {1: ("E-001", "MAPPED"), 2: (None, "AMBIGUOUS")}


@pytest.mark.parametrize("text, want", [("e-001a", "E-001A"), (" EE 12 ", "EE-12"), ("12", None), ("E-1", None), ("ABCDE-12", None)])
def test_canonical(spark, text, want):
    assert spark.range(1).select(D.canonical(F.lit(text)).alias("c")).first()["c"] == want
