import pytest
from pyspark.sql import functions as F

from tracewell.operators import review, store, validation


def test_requests(spark):
    assert review.request_query("도면을 찾아줘 접지봉 ＫＥＣ!") == "접지봉"
    with pytest.raises(ValueError):
        review.request_query("도면 검토해줘")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "request string")
    found = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("b", 3, 0.7), ("b", 4, 0.7)], "request string, id int, score double")
    got = {r.request: (r.selection, r.n_tied, r.id) for r in review.review_requests(asked, found, "request", "score", "id").collect()}
    assert got == {"a": ("selected", 1, 2), "b": ("ambiguous", 2, None), "c": ("not-found", 0, None)}


def test_relations_of_rows_and_excerpts(spark):
    E = "item string, excerpt string, source_type string, source_path string, sheet_name string, row_index int"
    rows = [("a", "aa", "excel", "p", "s", 1), ("b", "bb", "excel", "p", "s", 1), ("c", "cc bb", "pdf", "q", None, None), ("b", "cc bb", "pdf", "q", None, None), ("d", "dd", "excel", "p", None, None)]
    words = {k: [k * 2] for k in "abcde"}
    got = {(r[0], r[1]): (r[2], r[3]) for r in review.evidence_relations(spark.createDataFrame(rows, E), [("a", "b"), ("b", "c"), ("a", "d"), ("a", "e")], words).collect()}
    assert got == {("a", "b"): ("same-row", "high"), ("b", "c"): ("same-excerpt", "high"), ("a", "d"): ("project-level", "medium")}


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.pdf", "b.PDF", "/a/b.pdf", "a//b.pdf", "a/../b.pdf", ".pdf", "a/.pdf", "a\\b.pdf", "", None)], "p string")
    assert [r[0] for r in df.select(review.managed_path(F.col("p"))).collect()] == [True, True] + [False] * 8
    assert [r[0] for r in df.limit(2).select(review.parent_directory(F.col("p"))).collect()] == ["a", "."]


def test_json(spark):
    df = spark.createDataFrame([(t,) for t in ('{"b": 1, "a": [2, {"d": null, "c": "x"}]}', '{"a":1}}', "1,2", "[", None, '"x"', "")], "t string")
    assert [r[0] for r in df.select(store.canonical_json(F.col("t"))).collect()] == ['{"a":[2,{"c":"x","d":null}],"b":1}', None, None, None, None, '"x"', None]


def test_numbers_and_facts(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 37 % 5000).alias("v"), F.lit("x").alias("n"))
    got = sorted((r.v, r.n) for r in store.numbered(df.drop("n"), "n", ["v"], 10).collect())
    assert got == [(v, v + 11) for v in range(5000)] and store.numbered(df.limit(0).drop("n"), "n", ["v"]).count() == 0
    old = spark.createDataFrame([(1, "a"), (7, "b")], "seq long, v string")
    new = spark.createDataFrame([(None, "d"), (None, "c"), (None, "c")], "seq long, v string")
    assert sorted((r.seq, r.v) for r in store.append_facts(old, new, "seq", ["v"]).collect()) == [(1, "a"), (7, "b"), (8, "c"), (9, "c"), (10, "d")]


def test_write_guard(spark):
    held = spark.createDataFrame([("a", "one.pdf"), ("b", "two.pdf")], "collection string, source_path string")
    meta = spark.createDataFrame([("a", "p", "m", 4)], "collection string, provider string, model string, dimensions int")
    rows = [("a", "one.pdf", "q", "m", 4, 4), ("a", "new", "p", "m", 4, 4), ("a", "new2", "q", "m", 4, 4), ("a", "new3", "p", "n", 4, 4), ("a", "new4", "p", "m", 5, 5), ("a", "new5", "p", "m", 4, 5), ("b", "new", "p", "m", 4, 4), ("z", "new", "p", "m", 4, 4), ("a", "none", "p", "m", None, None)]
    got = [r.status for r in store.write_compatibility(held, meta, spark.createDataFrame(rows, "collection string, source_path string, provider string, model string, least int, most int")).orderBy("collection", "source_path").collect()]
    assert got == ["OK", "PROVIDER_DIFFERS", "MODEL_DIFFERS", "DIMENSION_DIFFERS", "VECTORS_MIXED", "VECTORS_EMPTY", "OK", "METADATA_MISSING", "OK"]


def test_issues(spark):
    nodes = spark.createDataFrame([("a", "PANEL", "1"), ("b", "PANEL", "2"), ("c", "ODD", "3"), ("c", "LOAD", "3")], "node_id string, node_type string, component_id string")
    edges = spark.createDataFrame([("1", "CONNECTED", "b", "a", "UNDIRECTED"), ("2", "CONTAINS", "a", "b", "FORWARD"), ("3", "CONTAINS", "b", "a", "FORWARD"), ("4", "REFERENCES", "a", "z", "BOTH"), ("4", "CONTAINS", "a", "b", "FORWARD")], "edge_id string, edge_type string, source string, target string, direction string")
    got = {(r.code, r.entity_id) for r in validation.graph_issues(nodes, edges).collect()}
    assert got == {
        ("NODE_ID_DUPLICATE", "c"), ("NODE_TYPE_UNKNOWN", "c"), ("EDGE_ID_DUPLICATE", "4"), ("EDGE_REPEATED", "2"), ("EDGE_DANGLING", "4"), ("EDGE_DIRECTION", "4"), ("EDGE_ORDER", "1"),
        ("COMPONENT_SPLIT", "a"), ("CONTAINMENT_CYCLE", "a"), ("CONTAINMENT_CYCLE", "b"), ("NODE_ISOLATED", "c"),
    }
    assert validation.graph_issues(nodes.limit(0), edges.limit(0)).count() == 0


def test_index_pages(spark):
    from tracewell.operators.indexing import index_pages

    C = "collection string, source_path string, page int, chunk_index int, text string, embedding array<double>"
    held = spark.createDataFrame([("a", "x", 1, 0, "old", [1.0]), ("a", "y", 1, 0, "old", [1.0]), ("b", "z", 1, 0, "old", [1.0, 2.0])], C)
    meta = spark.createDataFrame([("a", "p", "m", 1), ("b", "p", "m", 2)], "collection string, provider string, model string, dimensions int")
    rows = [("a", "x", 1, "one two"), ("a", "x", 1, "one two"), ("a", "x", 2, None), ("b", "w", 1, "three"), ("c", "v", 1, "four"), ("a", "u", 1, "  "), ("b", "z", 1, "five six seven")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "collection string, source_path string, page int, text string, model string")
    chunks, metadata, outcome = index_pages(held, meta, pages.drop("model"), lambda t: F.split(t, " "), lambda t: F.array(F.length(t).cast("double")), "p", "m")
    assert {(r[0], r[1]): (r[2], r[3]) for r in outcome.collect()} == {("a", "x"): ("OK", 2), ("b", "w"): ("DIMENSION_DIFFERS", 1), ("c", "v"): ("OK", 1), ("a", "u"): ("VECTORS_EMPTY", 0), ("b", "z"): ("OK", 3)}
    got = sorted((r.collection, r.source_path, r.chunk_index, r.text) for r in chunks.collect())
    assert got == [("a", "x", 0, "one"), ("a", "x", 1, "two"), ("a", "y", 0, "old"), ("b", "z", 0, "five"), ("b", "z", 1, "six"), ("b", "z", 2, "seven"), ("c", "v", 0, "four")]
    assert {r.collection: r.dimensions for r in metadata.collect()} == {"a": 1, "b": 1, "c": 1}


def test_assembly(spark):
    from tracewell.operators.assembly import assemble_objects, object_statistics

    C = "page int, candidate_id string, rule_id string, object_type string, confidence double, primary array<string>, supporting array<string>, labels array<string>"
    rows = [(1, "a", "r", "PANEL", 0.9, ["p2"], ["p1", "p2"], ["t"]), (1, "b", "r", "LOAD", 0.7, ["none"], None, None), (1, "c", "r", "LOAD", 0.5, ["p1"], None, None), (2, "a", "r", "LOAD", 0.65, ["p1"], None, None)]
    prims = spark.createDataFrame([(1, "p1", 0.0, 5.0, 2.0, 2.0), (1, "p2", 10.0, 0.0, 1.0, 1.0), (2, "p1", 1.0, 1.0, 1.0, 1.0)], "page int, primitive_id string, x double, y double, width double, height double")
    df = spark.createDataFrame(rows, C)
    got = {(r.page, r.object_type): (r.status, r.primitive_ids, r.label_ids, r.x, r.y, r.width, r.height) for r in assemble_objects(df.union(df), prims, ["page"]).collect()}
    assert got == {(1, "PANEL"): ("ACCEPTED", ["p1", "p2"], ["t"], 0.0, 0.0, 11.0, 7.0), (2, "LOAD"): ("REVIEW_REQUIRED", ["p1"], [], 1.0, 1.0, 1.0, 1.0)}
    assert {r.page: (r.n_candidates, r.n_accepted, r.n_review, r.n_excluded) for r in object_statistics(df, ["page"]).collect()} == {1: (3, 1, 1, 1), 2: (1, 0, 1, 0)}
