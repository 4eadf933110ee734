import json
import zipfile

import pytest

from tracewell.sources import files, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Prices" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Name</t></si><si><r><t>접지</t></r><r><t>봉</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Price</t></is></c><c r="D1" t="inlineStr"><is><t>Day</t></is></c></row>'
            '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="str"><f>1</f><v>1,234.5</v></c><c r="D2" s="1"><v>45292</v></c></row><row r="3"/><row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4" t="inlineStr"><is><t>none</t></is></c><c r="C4"/></row></sheetData></worksheet>',
        )
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "book.xlsx")
    rows = xlsx.sheet_rows(spark, str(tmp_path))
    assert [(r["row_index"], r["cells"]) for r in rows.orderBy("row_index").collect()] == [(1, ["Name", "Price", None, "Day"]), (2, ["접지봉", "1,234.5", None, "2024-01-01"]), (4, ["true", "none"])]
    first = xlsx.read_sheet(rows, max_rows=2).orderBy("row_index").collect()
    assert [r["row_index"] for r in first] == [1, 2] and first[0]["total_rows"] == 3
    out = xlsx.map_material_rows(rows, {"name": "name", "unit_price": "Price", "effective_date": "day"}).orderBy("row_index").collect()
    assert [(r["name"], r["unit_price"], r["effective_date"], r["error"]) for r in out] == [("접지봉", 1234.5, "2024-01-01", None), ("true", None, None, "price is no number")]
    assert xlsx.map_material_rows(rows, {"maker": "Maker"}).where("error = 'missing column Maker'").count() == 2


def test_files(spark, tmp_path):
    for name in ("b.PDF", "a.xlsx", "x.txt", ".git/c.pdf", "node_modules/d.pdf", "sub/e.dwg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("12345")
    got = [(r["path"], r["extension"], r["size"]) for r in files.project_files(spark, str(tmp_path)).collect()]
    assert got == [("a.xlsx", "xlsx", 5), ("b.PDF", "pdf", 5), ("sub/e.dwg", "dwg", 5)]
    paths = spark.createDataFrame([("b/y.pdf",), ("a.pdf",)], "p string")
    ids = [r["source_id"] for r in files.batch_sources(paths, "p").collect()]
    assert ids == sorted(ids) and ids[0].startswith("kecsrc_")
    for bad in ("../a.pdf", "/a.pdf", "a.txt"):
        with pytest.raises(Exception):  # noqa: B017
            files.batch_sources(spark.createDataFrame([(bad,)], "p string"), "p").collect()
    with pytest.raises(Exception):  # noqa: B017
        files.batch_sources(paths.union(paths), "p").collect()
    (tmp_path / "doc.json").write_text(json.dumps({"a": 1, "b": ["x"]}))
    assert files.json_documents(spark, str(tmp_path / "doc.json"), "a int, b array<string>").collect()[0]["b"] == ["x"]


def test_directory_scope_and_large_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.pdf", "a.pdf", "C.PDF", "x.txt", ".h.pdf", "sub/d.pdf"):
        (tmp_path / name).write_text("x")
    assert [r["name"] for r in files.directory_scope(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    with pytest.raises(ValueError):
        files.directory_scope(spark, _empty(tmp_path))
    (tmp_path / "doc.json").write_text(json.dumps({"a": 1}))
    assert files.json_documents(spark, str(tmp_path / "doc.json"), "a int").first()["a"] == 1
    with pytest.raises(ValueError):
        files.json_documents(spark, str(tmp_path / "doc.json"), "a int", most=3)


def _empty(tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "n.txt").write_text("x")
    return str(tmp_path / "empty")
