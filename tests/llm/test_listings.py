import re

import pytest

from tracewell.llm.attributes import read_attributes
from tracewell.llm.listings import code_shapes, find_lines, product_keys, read_listing, read_listings, reference_dictionary, romanised, same_product_pairs

L = "listing_id long, name string, manufacturer string, model string, specification string, product string"
ROWS = [
    (1, "Vektron MCCB JBW42-D061 250A", "Vektron", "JBW42-D061", "25kA 4P"),
    (2, "차단기 Garajidi 250 Amp", "(주)Vektron", "JBW42D061", "차단용량 25㎄ | 4극"),
    (3, "Ｖektron Garajidi 4-pole breaker", "Vektron Co., Ltd.", None, "Icu 25 kA; 250AT; replaces JBW42-A015"),
    (4, "가라지디 MCCB", None, "N/A", "4P 25kA 250A"),
    (5, "MCCB JBW42-A015", "Vektron", "JBW42-A015", "20A 35kA 4P"),
    (6, "MCCB NEW 50 kA", "Ostrikel", "QRS11-B020", "50kA 2P 20A"),
    (7, "something else", None, None, None),
    (8, None, None, None, None),
]


def rewritten(rows, change):
    """The same listings with every code and line written in another shape."""
    return [tuple(re.sub(r"(?<![A-Z0-9])([A-Z]{3})(\d\d)(-?[A-Z]\d{3})?(?![A-Z0-9])", lambda m: change(m[1], m[2], m[3] or ""), x) if isinstance(x, str) else x for x in r) for r in rows]


@pytest.mark.parametrize("change", [lambda a, b, c: a + b + c, lambda a, b, c: a + b + b + c, lambda a, b, c: f"{a}{b}Q{c}", lambda a, b, c: f"{a[0]}{b}{a[1:]}7{c}"])
def test_groups(spark, change):
    rows = rewritten(ROWS, change)
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:2]], L)
    keys = product_keys(df)
    got = {(r[0], r[1]) for r in same_product_pairs(keys).collect()}
    assert got == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4) if a < b}


def test_shards_and_empty_tables(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS + ROWS[:2]], L)
    whole = {tuple(r) for r in product_keys(df).collect()}
    assert {tuple(r) for r in product_keys(df, shard=2).collect()} == whole and {i for i, _ in whole} == {1, 2, 3, 4, 5, 6}
    read = read_listings(df)
    dictionary, brands = reference_dictionary(read, shapes := code_shapes(read))
    read = read.join(brands, read.maker == brands.spelling, "left").drop("spelling")
    assert sorted(map(tuple, find_lines(read, dictionary, shapes, 2, 2).collect())) == sorted(map(tuple, find_lines(read, dictionary, shapes).collect()))
    assert product_keys(df.limit(0)).count() == 0
    assert product_keys(spark.createDataFrame([(9, None, None, None, None, ""), (10, "", "", "", "", "")], L)).count() == 0


def test_lines_are_mined_from_separators(spark):
    models = ["AB-77-X1", "AB77-X1", "AB77X2", "AB77/X3", "QQ1234", "ZZ9876", "none", "12", "a really very long model name 12345"]
    df = spark.createDataFrame([(i, "n", "m", m, "", "") for i, m in enumerate(models)], L)
    assert code_shapes(read_listings(df)) == {"aa99a9": 4, "aa9999": 6}


def test_other_products_in_remarks_and_numbers_of_packages(spark):
    """A code in the specification is another product's; numbers on which a code's listings do not agree rate nothing."""
    rows = [(i, f"MCCB {a}A", "Vektron", f"JBW42-{c}", f"{a}A 3P {n} kg/포; replaces JBW42-{o}", "") for i, (c, o, a, n) in enumerate([("D061", "A015", 250, 5), ("D061", "A015", 250, 25), ("A015", "D061", 20, 5), ("A015", "D061", 20, 10)])]
    rows += [(10, "JBW42 series 250A", "Vektron", None, "3P; 10 kg/포; replaces JBW42-A015", ""), (11, "JBW42 20A", None, "N/A", "", ""), (12, "JBW42", "Vektron", "", "3P", "")]
    got = {(r[0], r[1]) for r in same_product_pairs(product_keys(spark.createDataFrame(rows, L))).collect()}
    assert got == {(0, 1), (0, 10), (1, 10), (2, 3), (2, 11), (3, 11)}


def test_reading():
    assert read_attributes("w300 h100 steel") == {"size": ["300x100"], "material": ["steel"]} and read_attributes("30x10 cm")["size"] == ["300x100"]
    assert read_attributes("0.6 kv 4c 185 sq") == {"volt": ["600"], "cores": ["4"], "area_mm2": ["185"]}
    assert read_attributes("black | white") == {"colour": ["black", "white"]}
    assert read_attributes("φ16 hole, ip65, 사용온도 -20~70 °c, r ≤ 10 ω, nzp-10-p010, 10-c065") == {}
    assert romanised("가라지디") == "garajidi" and romanised("접지") is None
    assert read_listing(None, None, None, None)[:2] == (None, None) and read_listing("x", "(주)", "-", "")[0] is None
