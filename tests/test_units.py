import math

import pytest

from tracewell.operators.units import PHYSICAL, close_pairs, compositions, convert, unit_prices

LISTING = "listing_id long, unit_price double, unit string, currency string, specification string, base string"


def test_compositions_are_shortest_and_consistent():
    to = {(a, b): (s, c) for a, b, s, c in compositions(PHYSICAL, ["m", "K"])}
    assert math.isclose(to["yd", "m"][0], 0.9144) and math.isclose(to["degF", "K"][0] * 212 + to["degF", "K"][1], 373.15)
    with pytest.raises(ValueError):
        compositions([("a", "b", 2.0, 0.0), ("b", "c", 2.0, 0.0), ("a", "c", 5.0, 0.0)], ["c"])


def test_convert(spark):
    df = spark.createDataFrame([(1, 2.0, "km"), (2, 3.0, "ｆｔ"), (3, 1.0, "roll"), (4, None, "m"), (5, 1.0, None)], "i int, v double, u string")
    got = {r["i"]: r["converted"] for r in convert(df, "v", "u", "m").collect()}
    assert got[1] == 2000 and math.isclose(got[2], 0.9144) and got[3] is None and got[4] is None and got[5] is None
    assert convert(df.limit(0), "v", "u", "m").count() == 0


CASES = [
    (1, 1200.0, "M", "원", None, "m", 1200.0),
    (2, 1.2, "m", "천원", "IP65", "m", 1200.0),
    (3, 120000.0, None, "KRW", "(per 100 m)", "m", 1200.0),
    (4, 240000.0, "롤", None, "1롤=200m; 600 V", "m", 1200.0),
    (5, None, None, None, "price KRW 120,000.00 per 100m", "m", 1200.0),
    (6, None, None, None, "옥내용; @ EUR 1.234,50/dozen", "piece", 1234.5 * 1500 / 12),
    (7, None, None, None, "단가 13,45 USD / pair", "piece", 13.45 * 1300 / 2),
    (8, 100.0, "EA", None, "(엔화)", "piece", 900.0),
    (9, 3.0, None, "US$", "톤당 단가", "kg", 3.9),
    (10, 1000.0, "BOX", "₩", "50 EA/BOX", "piece", 20.0),
    (11, 500.0, None, "KRW", "Φ16 hole 10 m² 기준", "m2", 50.0),
    (12, 7.0, "포", "won", "25 kg/포", "kg", 7 / 25),
    (13, 5.0, "kg", None, "단위: 천원, bag of 25 kg", "kg", 5000.0),
    (14, 9.0, "식", "KRW", None, None, None),
    (15, None, "EA", "KRW", "시험성적서 포함", None, None),
    (16, 9.0, "roll", "KRW", None, None, None),
    (17, float("nan"), "m", None, None, None, None),
    (18, -4.0, "m", None, None, None, None),
]


def test_prices(spark):
    rows = [(*c[:5], "clash") for c in CASES]
    rates = spark.createDataFrame([("KRW", 1.0, 1), ("USD", 1300.0, 1), ("EUR", 1500.0, 1), ("JPY", 900.0, 100), ("CNY", 180.0, 1)], "currency_code string, won double, quoted_units int")
    got = {r["listing_id"]: (r["base"], r["won_per_base"]) for r in unit_prices(spark.createDataFrame(rows, LISTING), rates, ["listing_id"]).collect()}
    for n, *_, base, won in CASES:
        if base is None:
            assert n not in got
        else:
            assert got[n][0] == base and math.isclose(got[n][1], won, rel_tol=1e-9), n


def test_close_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "g" if i % 3 else "h", math.exp(rng.uniform(0, 0.3))) for i in range(300)] + [(900 + i, "same", 5.0) for i in range(20)]
    got = {(r[0], r[1]) for r in close_pairs(spark.createDataFrame(rows, "i long, g string, v double"), "i", ["g"], "v", 0.5).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 0.005 * max(a[2], b[2])}
    assert got == want
