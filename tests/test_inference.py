import pytest
from pyspark.sql import functions as F

from tracewell.operators import graph, inference, spatial


def test_rules_and_resolution(spark):
    objects = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.5)], "object_id string, confidence double")
    edges = spark.createDataFrame([("b", "a", "ENDPOINT_CONTACT"), ("a", "b", "ENDPOINT_CONTACT"), ("b", "c", "ENDPOINT_CONTACT"), ("a", "zz", "ENDPOINT_CONTACT"), ("a", "a", "NEAR")], "a string, b string, edge_type string")
    made, parts = inference.construction_graph(objects, edges)
    assert made.count() == 2 and parts.select("component").distinct().count() == 1
    cands = inference.run_rules({"endpoint": inference.endpoint_contacts}, {"objects": objects, "edges": made})
    out = graph.resolve_relationships(cands).collect()
    assert [(r["key"], r["confidence"]) for r in out] == [("a:b", 0.8)]


def test_evidence_and_counts(spark):
    df = spark.createDataFrame([("o", [2, 1], ["t"]), ("p", [], [])], "object_id string, prims array<int>, texts array<string>")
    got = {r[0]: r[1] for r in inference.evidence_index(df, {"primitive": "prims", "text": "texts"}).collect()}
    assert got == {"o": ["primitive:1", "primitive:2", "text:t"], "p": []}
    counts = {r[0]: r[1] for r in inference.typed_counts(spark.createDataFrame([("A",), ("A",)], "k string"), "k", ["A", "B"]).collect()}
    assert counts == {"A": 2, "B": 0}
    assert inference.node_types(spark.createDataFrame([("WIRE",)], "object_type string")).collect()[0]["node_type"] == "CABLE"
    with pytest.raises(Exception):  # noqa: B017
        inference.node_types(spark.createDataFrame([("X",)], "object_type string")).collect()


def test_drawing_lists(spark):
    heads = [(1, "number", 10.0, 5.0), (1, "title", 20.0, 5.0), (1, "number", 110.0, 5.0), (1, "title", 120.0, 5.0), (1, "scale_a1", 40.0, 5.0), (2, "number", 1.0, 1.0)]
    rows = inference.header_anchors(spark.createDataFrame(heads, "page int, kind string, x double, y double")).orderBy("block").collect()
    assert [(r["number_x"], r["title_x"], r["scale_a1_x"], r["right_bound"]) for r in rows] == [(10.0, 20.0, 40.0, 110.0), (110.0, 120.0, None, None)]
    n = spark.createDataFrame([(1, "n1", 10.0), (1, "n2", 50.0), (1, "n3", 90.0), (2, "n1", 12.0)], "page int, number_id string, at double")
    t = spark.createDataFrame([(1, "t1", 12.0), (1, "t2", 47.0), (1, "t3", 53.0)], "page int, title_id string, at double")
    got = {r[1]: (r[2], r[3]) for r in inference.match_titles(n, t).where("page = 1").collect()}
    assert [(r.title_id, r.n_ties) for r in inference.match_titles(n, t).where("page = 2").collect()] == [(None, 0)]
    assert got == {"n1": ("t1", 1), "n2": (None, 2), "n3": (None, 0)}
    s = inference.match_scales(spark.createDataFrame([(1, "r", 10.0, 10.0)], "page int, row_id string, x double, y double"), spark.createDataFrame([(1, "1/100", 12.0, 20.0), (1, "1/50", 11.0, 24.0), (1, "1/1", 11.0, 40.0), (2, "1/9", 10.0, 10.0)], "page int, scale string, x double, y double"))
    assert s.collect()[0]["scale"] == "1/50"


def test_geometry(spark):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in dict(a=0.0, b=10.0, c=-10.0, d=0.0).items()])
    low, high = inference.cubic_bounds(*[F.col(c) for c in "abcd"])
    r = df.select(low.alias("l"), high.alias("h")).collect()[0]
    assert abs(r["h"] - 2.8867513) < 1e-6 and abs(r["l"] + 2.8867513) < 1e-6
    m = inference.affine_product([F.lit(v) for v in (2.0, 0.0, 0.0, 2.0, 1.0, 1.0)], [F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 5.0, 6.0)])
    assert spark.range(1).select(m.alias("m")).collect()[0]["m"] == [2.0, 0.0, 0.0, 2.0, 11.0, 13.0]


def test_proximity_equals_theta_join(spark):
    import random

    rng = random.Random(9)
    box = lambda big: (round(rng.uniform(0, 200), 2), round(rng.uniform(0, 200), 2), round(rng.uniform(0, 150 if big else 12), 2), round(rng.uniform(0, 100 if big else 12), 2))
    texts = [("pg", i, *box(False)) for i in range(120)]
    prims = [("pg", i, *box(i % 10 == 0)) for i in range(120)] + [("pg", 200, *texts[0][2:])]
    t = spark.createDataFrame(texts, "page string, text_id int, tx double, ty double, tw double, th double")
    p = spark.createDataFrame(prims, "page string, prim_id int, px double, py double, pw double, ph double")
    got = [(r["text_id"], r["prim_id"]) for r in spatial.proximity_join(t, p, ["page"]).collect()]

    def gap(a, an, b, bn):
        return max(0.0, b - a - an, a - b - bn)

    want = {(a[1], b[1]) for a in texts for b in prims if (gap(a[2], a[4], b[2], b[4]) ** 2 + gap(a[3], a[5], b[3], b[5]) ** 2) ** 0.5 <= 8}
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.proximity_join(t, p, ["page"]).where("text_id = 0 and prim_id = 200").collect()[0]["topology"] == "overlaps"
