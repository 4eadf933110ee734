"""Queries: stores, graphs, audits, boxes and reviews over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import round_half_up
from tracewell.operators import graph, review, spatial, store
from tracewell.operators.store import index_diagnostics as diagnose
from tracewell.sources import table

MIDDLE = "2001-05-17"


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as stored up to a day, and a batch of all later ones plus the urgent open earlier ones, revised."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    late = F.col("o_orderdate") > F.lit(MIDDLE).cast("timestamp")
    batch = orders.where(late | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))).withColumn("o_orderstatus", F.lit("X"))
    return orders.where(~late), batch


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_batches(spark, sf_dir), ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_orderstatus")


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.replace_source(*_batches(spark, sf_dir), ["o_custkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = _batches(spark, sf_dir)
    return store.delete_source(old, batch.select("o_custkey"), "o_custkey").select("o_orderkey")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = _batches(spark, sf_dir)
    after, _ = store.insert_if_absent(old, batch, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return after.select("o_orderkey", "o_orderstatus")


def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.insert_if_absent(*_batches(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])[1].select("o_orderkey")


def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, batch = _batches(spark, sf_dir)
    return store.stale_sources(old, batch, "o_custkey")


def snapshot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots whose population would change if the members stored in 2024 or later were left out."""
    members = table(spark, sf_dir, "kec_requirement_snapshot_members").distinct()
    early = members.where("stored_at < timestamp'2024-01-01'")
    return store.snapshot_conflicts(members, early, "snapshot_id", "population_index", ["requirement_id", "statement"])


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "decision_records").select("decision_namespace", "record_key").distinct()
    return store.keyset_page(records, ["decision_namespace", "record_key"], ("annex", "DR-00000100"), 100)


def distinct_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "decision_bases").select("decision_namespace", "decision_record_key").distinct()


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "kec_chunks").select("collection", "source_path").distinct()


def index_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "kec_chunks").select("collection", "chunk_seq", "source_path", "embedding", "text").dropDuplicates(["chunk_seq"])
    return diagnose(chunks, "collection", "source_path", "embedding", "text")


def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 300000).alias("failed"))
    return store.batch_outcome(orders, "o_orderkey", "failed").groupBy("status").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "decision_supersessions")
    name = lambda k: F.concat_ws("/", f"{k}_namespace", f"{k}_record_key")
    return s.select(name("superseded").alias("src"), name("superseding").alias("dst")).distinct()


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_edges(spark, sf_dir))


def reference_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reference_cycles(_edges(spark, sf_dir))


def containment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the edges hold a cycle, and how many edges lie on one."""
    edges = _edges(spark, sf_dir)
    cycle = graph.reference_cycles(edges)
    ends = edges.join(cycle.toDF("src", "a"), "src").join(cycle.toDF("dst", "b"), "dst").where("a = b")
    return ends.agg((F.count("*") > 0).alias("has_cycle"), F.count("*").alias("n_cyclic_edges"))


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "decision_records").where("decision_namespace = 'annex'")
    return graph.neighbours(_edges(spark, sf_dir), records.select(F.concat_ws("/", "decision_namespace", "record_key").alias("node")))


def graph_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a record of the annex supersedes (one hop along the edge's direction, from its target)."""
    edges = _edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    records = table(spark, sf_dir, "decision_records").where("decision_namespace = 'annex'")
    return graph.neighbours(edges, records.select(F.concat_ws("/", "decision_namespace", "record_key").alias("node")), directed=True)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "decision_records").where("deleted_at is not null")
    return late.select(F.concat_ws("/", "decision_namespace", "record_key").alias("node"))


def bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bounded_traversal(_edges(spark, sf_dir), _seeds(spark, sf_dir), 4)


def bounded_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50 deleted records lead to within 3 hops, 200 records and 150 links, in visiting order."""
    seeds = _seeds(spark, sf_dir).distinct().orderBy("node").limit(50)
    found = graph.budgeted_subgraph(seeds, _edges(spark, sf_dir), 3, 200, 150)
    return spark.createDataFrame(found.astype(object).where(found.notna(), None), "node string, hop int, direction string, status string, reason string, edges long")


def supersession_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at either end of the deleted records: two equi-joins united, not one join with OR."""
    edges, seeds = _edges(spark, sf_dir), _seeds(spark, sf_dir)
    return edges.join(seeds, edges.src == seeds.node, "left_semi").union(edges.join(seeds, edges.dst == seeds.node, "left_semi")).distinct()


def _relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "CONNECTED_TO").when(F.col("l_returnflag") == "N", "CONNECTED_VIA").when(F.col("l_linestatus") == "F", "BELONGS_TO").otherwise("REFERENCES")
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return lines.select(kind.alias("relationship_type"), node("o", "l_orderkey").alias("source_id"), node("p", "l_partkey").alias("target_id"), node("s", "l_suppkey").alias("via_id"))


def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.project_graph(_relationships(spark, sf_dir))


def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.project_graph(_relationships(spark, sf_dir))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target"))
    return graph.graph_statistics(nodes, edges)


def relationship_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "CONNECTED_TO").when(F.col("l_returnflag") == "N", "CONNECTED_VIA").otherwise("UNKNOWN")
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    candidates = lines.select(
        F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("key"), name.alias("candidate_id"), kind.alias("relationship_type"),
        (F.col("l_linestatus") == "O").alias("hard_gate"), F.col("l_linenumber").alias("priority"),
        round_half_up(graph.relationship_confidence(F.lit(0.55) + F.col("l_discount") * 4)).alias("confidence"), F.array(F.concat(F.lit("line:"), name)).alias("evidence"),
    )
    out = graph.resolve_relationships(candidates)
    return out.select("key", "candidate_id", "relationship_type", "confidence", F.array_join("evidence", ",").alias("evidence"))


def candidate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    candidates = lines.select(
        F.col("l_suppkey").alias("page"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("candidate_id"),
        F.col("l_linenumber").alias("priority"), F.col("l_discount").alias("confidence"), F.array(F.col("l_partkey")).alias("primary"),
        F.array(F.col("l_orderkey") + 10_000_000).alias("supporting"), (F.col("l_returnflag") == "N").alias("shares"),
    )
    return graph.resolve_candidates(candidates, ["page"])


def object_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence and status of objects from five scores and a penalty."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (1 - F.col("l_tax")).alias("b"), (F.col("l_quantity") / 50).alias("c"),
        F.lit(0.5).alias("d"), F.lit(1.0).alias("e"), (F.col("l_tax") / 2).alias("p"),
    )
    conf = graph.object_confidence(dict(zip(graph.OBJECT_WEIGHTS, "abcde")), "p")
    return rows.select("l_orderkey", "l_linenumber", round_half_up(conf).alias("confidence"), graph.object_status(round_half_up(conf)).alias("status"))


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Text and primitive boxes from vector components, scaled to points; the label is the page."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    place, extent = (lambda i: F.round(at(i) * 600 + 300, 3)), (lambda i: F.round(F.abs(at(i)) * 60, 3))
    texts = v.select("label", F.col("vec_id").alias("text_id"), place(0).alias("tx"), place(1).alias("ty"), extent(2).alias("tw"), extent(3).alias("th"))
    prims = v.select("label", F.col("vec_id").alias("prim_id"), place(4).alias("px"), place(5).alias("py"), extent(6).alias("pw"), extent(7).alias("ph"))
    return texts, prims


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.proximity_rank(spatial.proximity_join(*_boxes(spark, sf_dir), ["label"]), ["label", "text_id"], ["prim_id"])


def spatial_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("text_id", "prim_id", "topology", F.col("rounded").alias("distance"), "rank")


def spatial_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("contains", "disjoint", "inside", "overlaps", "touches")], "topology string")
    return kinds.join(_near(spark, sf_dir).groupBy("topology").agg(F.count("*").alias("n")), "topology", "left").select("topology", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of a text: groups of two or more, numbered by their first document."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("canon"))
    groups = docs.groupBy("canon").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    numbered = store.numbered(groups, "number", ["first"])
    numbered = numbered.withColumn("group_id", F.concat(F.lit("duplicate-"), F.lpad(F.col("number").cast("string"), 6, "0")))
    return docs.join(numbered.select("canon", "group_id", "n"), "canon").select("doc_id", "group_id", "n")


def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("text-item-"), F.lpad(F.row_number().over(w).cast("string"), 6, "0")).alias("item_id"))


def nearest_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part whose price is nearest to a customer's balance, within 0.5, and how many tie for it."""
    near = spatial.nearest_in_band(table(spark, sf_dir, "customer"), table(spark, sf_dir, "part"), "c_custkey", "c_acctbal", "p_partkey", "p_retailprice", 0.5)
    return near.select("c_custkey", "p_partkey", "n_ties")


def page_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each catalogue item with its listing: unique gives the listing, none or several give null."""
    m = table(spark, sf_dir, "material_knowledge_metadata").select("catalog_id", "item_code", "listing_id").distinct()
    per = m.groupBy("catalog_id", "item_code").agg(F.count("*").alias("n"), F.min("listing_id").alias("one"))
    return per.select("catalog_id", "item_code", "n", F.when(F.col("n") == 1, F.col("one")).alias("listing_id"))


def duplicate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "material_knowledge_metadata").select("catalog_id", "item_code", "listing_id").distinct()
    lists = m.groupBy("catalog_id", "item_code").agg(F.sort_array(F.collect_list("listing_id")).alias("ids")).where(F.size("ids") > 1)
    return lists.select("catalog_id", "item_code", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("listing_ids"))


def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "decision_records").select("decision_namespace", "record_key").distinct()
    bases = table(spark, sf_dir, "decision_bases").select("decision_namespace", F.col("decision_record_key").alias("record_key"))
    return records.join(bases, ["decision_namespace", "record_key"], "left_anti")


def orphan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members without header, and headers without member."""
    members, headers = table(spark, sf_dir, "kec_requirement_snapshot_members"), table(spark, sf_dir, "kec_requirement_snapshots")
    a = members.join(headers, "snapshot_id", "left_anti").select("snapshot_id").distinct().withColumn("issue", F.lit("member-without-header"))
    b = headers.join(members, "snapshot_id", "left_anti").select("snapshot_id").distinct().withColumn("issue", F.lit("header-without-member"))
    return a.union(b)


def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, prims = _boxes(spark, sf_dir)
    out = prims.groupBy("label").agg(F.min("px").alias("x"), F.min("py").alias("y"), F.max(F.col("px") + F.col("pw")).alias("x2"), F.max(F.col("py") + F.col("ph")).alias("y2"))
    return out.select("label", "x", "y", round_half_up(F.col("x2") - F.col("x")).alias("width"), round_half_up(F.col("y2") - F.col("y")).alias("height"))


def quality_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are cited as a basis (expected) against records that stand undeleted (actual)."""
    key = ["decision_namespace", "record_key"]
    expected = table(spark, sf_dir, "decision_bases").select("decision_namespace", F.col("decision_record_key").alias("record_key"))
    return review.evaluate_sets(expected, table(spark, sf_dir, "decision_records").where("deleted_at is null"), key)


KEYWORDS = {
    "grounding": ["ground rod", "earth electrode", "접지"], "cable": ["cable", "conductor", "케이블"], "breaker": ["breaker", "isolator", "개폐기"], "lighting": ["luminaire", "lamp", "조명"],
    "panel": ["panel", "접속반"], "load": ["load", "부하"], "fire": ["smoke", "fire", "방화"], "battery": ["battery", "배터리"],
}
RULES = [("grounding", "cable"), ("breaker", "load"), ("lighting", "load"), ("panel", "breaker"), ("fire", "cable"), ("battery", "panel")]


def project_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = [(item, k, i) for item, ks in KEYWORDS.items() for i, k in enumerate(ks)]
    return review.design_items(review.evidence_lines(docs, "doc_id", "text"), spark.createDataFrame(rows, "item string, keyword string, place int"), "doc_id")


def design_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_items(spark, sf_dir)


def design_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.design_relations(project_items(spark, sf_dir), RULES, KEYWORDS)


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = project_items(spark, sf_dir)
    relations = review.design_relations(items, RULES, KEYWORDS)
    return review.markdown_report(
        "Review", [("Items", items, ["item", "n"], ["item", "keyword", "excerpt"]), ("Relations", relations, ["left_item", "right_item"], ["left_item", "right_item", "proximity"])], spark
    )


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "kec_chunks").select("chunk_seq", "collection", "chunk_id", "text", "embedding").dropDuplicates(["chunk_seq"])
    twice = chunks.groupBy("collection", "chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    bases = table(spark, sf_dir, "decision_bases").select("basis_seq", "decision_namespace", F.col("decision_record_key").alias("record_key")).distinct()
    return review.issues([
        ("CHUNK_ID_DUPLICATE", "a chunk id occurs twice in its collection", twice),
        ("TEXT_TOO_SHORT", "a chunk has fewer than 15 characters", chunks.where(F.length("text") < 15).select("chunk_seq")),
        ("VECTOR_MISSING", "a chunk has no vector", chunks.where("embedding is null").select("chunk_seq")),
        ("VECTOR_ZERO", "a vector has no length", chunks.where(norm == 0).select("chunk_seq")),
        ("VECTOR_NOT_FINITE", "a vector holds NaN", chunks.where(F.exists("embedding", lambda x: F.isnan(x))).select("chunk_seq")),
        ("BASIS_WITHOUT_RECORD", "a basis names no record", bases.join(table(spark, sf_dir, "decision_records"), ["decision_namespace", "record_key"], "left_anti").select("basis_seq")),
    ])


QUERIES = {
    f.__name__: f
    for f in (
        upsert_latest, replace_source, delete_source, insert_if_absent, identity_conflicts, stale_sources, snapshot_conflicts, keyset_page, distinct_addresses,
        source_paths, index_diagnostics, batch_outcome, graph_components, reference_cycles, containment_check, graph_neighbors, graph_contained, bounded_bfs,
        bounded_subgraph, supersession_lookup, graph_projection, graph_statistics, relationship_resolution, candidate_resolution, object_scores, spatial_relations,
        spatial_statistics, duplicate_groups, positional_ids, nearest_band_join, page_map_join, duplicate_items, anti_unmatched, orphan_audit, bbox_union,
        quality_eval, design_items, design_relations, review_report, validation_issues,
    )
}

_R6 = "(floor(({0}) * 1000000.0 + 0.5) / 1000000.0 + 0.0)"
_OB = f"""old AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '{MIDDLE}'),
new AS (SELECT * REPLACE ('X' AS o_orderstatus) FROM orders WHERE o_orderdate > TIMESTAMP '{MIDDLE}' OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'))"""
_E = "e AS (SELECT DISTINCT superseded_namespace || '/' || superseded_record_key AS src, superseding_namespace || '/' || superseding_record_key AS dst FROM decision_supersessions)"
_SEED = "seeds AS (SELECT DISTINCT decision_namespace || '/' || record_key AS node FROM decision_records WHERE deleted_at IS NOT NULL)"
_CYC = f"""{_E}, walk AS (SELECT src AS s, dst AS a FROM e UNION SELECT w.s, e.dst FROM walk w JOIN e ON e.src = w.a),
cyc AS (SELECT s FROM walk WHERE s = a), low AS (SELECT w.s, min(w.a) AS m, count(DISTINCT w.a) AS n FROM walk w JOIN cyc c ON c.s = w.s GROUP BY 1)"""
_REL = """r AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'CONNECTED_TO' WHEN l_returnflag = 'N' THEN 'CONNECTED_VIA' WHEN l_linestatus = 'F' THEN 'BELONGS_TO' ELSE 'REFERENCES' END AS k,
'o' || l_orderkey AS s, 'p' || l_partkey AS t, 's' || l_suppkey AS v FROM lineitem),
x AS (SELECT 'CONNECTED' AS edge_type, least(s, t) AS source, greatest(s, t) AS target, 'UNDIRECTED' AS direction FROM r WHERE k = 'CONNECTED_TO'
UNION SELECT 'CONNECTED', least(s, v), greatest(s, v), 'UNDIRECTED' FROM r WHERE k = 'CONNECTED_VIA' UNION SELECT 'CONNECTED', least(v, t), greatest(v, t), 'UNDIRECTED' FROM r WHERE k = 'CONNECTED_VIA'
UNION SELECT 'CONTAINS', t, s, 'FORWARD' FROM r WHERE k = 'BELONGS_TO' UNION SELECT 'REFERENCES', s, t, 'FORWARD' FROM r WHERE k = 'REFERENCES')"""
_BX = """tb AS (SELECT label, vec_id AS text_id, round(CAST(embedding[1] AS DOUBLE) * 600 + 300, 3) AS tx, round(CAST(embedding[2] AS DOUBLE) * 600 + 300, 3) AS ty,
round(abs(CAST(embedding[3] AS DOUBLE)) * 60, 3) AS tw, round(abs(CAST(embedding[4] AS DOUBLE)) * 60, 3) AS th FROM embeddings),
pb AS (SELECT label, vec_id AS prim_id, round(CAST(embedding[5] AS DOUBLE) * 600 + 300, 3) AS px, round(CAST(embedding[6] AS DOUBLE) * 600 + 300, 3) AS py,
round(abs(CAST(embedding[7] AS DOUBLE)) * 60, 3) AS pw, round(abs(CAST(embedding[8] AS DOUBLE)) * 60, 3) AS ph FROM embeddings)"""
_NEAR = f"""{_BX},
j AS (SELECT *, greatest(0.0, least(CASE WHEN px <= tx THEN pw ELSE tw END - abs(tx - px), CASE WHEN px <= tx THEN tw ELSE pw END)) AS ox,
greatest(0.0, least(CASE WHEN py <= ty THEN ph ELSE th END - abs(ty - py), CASE WHEN py <= ty THEN th ELSE ph END)) AS oy,
greatest(0.0, abs(tx - px) - CASE WHEN px <= tx THEN pw ELSE tw END) AS gx, greatest(0.0, abs(ty - py) - CASE WHEN py <= ty THEN ph ELSE th END) AS gy
FROM tb JOIN pb USING (label)),
k AS (SELECT *, sqrt(gx * gx + gy * gy) AS d FROM j),
l AS (SELECT *, CASE WHEN abs(px - tx) <= 0.01 AND abs(py - ty) <= 0.01 AND abs(pw - tw) <= 0.01 AND abs(ph - th) <= 0.01 THEN 'overlaps'
WHEN tx - px >= -0.01 AND ty - py >= -0.01 AND tx - px + tw - pw <= 0.01 AND ty - py + th - ph <= 0.01 THEN 'contains'
WHEN px - tx >= -0.01 AND py - ty >= -0.01 AND px - tx + pw - tw <= 0.01 AND py - ty + ph - th <= 0.01 THEN 'inside'
WHEN ox > 0.01 AND oy > 0.01 THEN 'overlaps' WHEN d <= 0.01 THEN 'touches' ELSE 'disjoint' END AS topology, round(d, 3) + 0.0 AS distance FROM k WHERE d <= 8.0),
near AS (SELECT *, CASE WHEN topology = 'disjoint' THEN row_number() OVER (PARTITION BY label, text_id, topology = 'disjoint' ORDER BY distance, prim_id) END AS rank FROM l
QUALIFY topology <> 'disjoint' OR rank <= 8)"""


def items_sql() -> str:
    first = lambda ks: "CASE " + " ".join(f"WHEN contains(lower(line), '{k}') THEN '{k}'" for k in ks) + " END"
    hits = " UNION ALL ".join(f"SELECT '{i}' AS item, doc_id, line_no, line, {first(ks)} AS keyword FROM ln" for i, ks in KEYWORDS.items())
    sp = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
    return f"""sp AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(regexp_replace(parts[i], '{sp}+', ' ', 'g')) AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM sp) WHERE trim(regexp_replace(parts[i], '{sp}+', ' ', 'g')) <> ''),
hit AS (SELECT * FROM ({hits}) WHERE keyword IS NOT NULL),
ex AS (SELECT *, instr(lower(line), keyword) AS a FROM hit),
ey AS (SELECT item, doc_id, line_no, keyword, trim(substr(line, greatest(a - 60, 1), a - greatest(a - 60, 1) + length(keyword) + 80)) AS excerpt FROM ex),
fs AS (SELECT item, excerpt, min(struct_pack(d := doc_id, l := line_no, k := keyword)) AS e FROM ey GROUP BY 1, 2),
it AS (SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY e) AS INTEGER) AS n, e.d AS doc_id, e.l AS line_no, e.k AS keyword, excerpt FROM fs QUALIFY n <= 3)"""


def _relations_sql() -> str:
    names = lambda ks: "(" + " OR ".join(f"contains(lower(excerpt), '{k}')" for k in ks) + ")"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS left_item, '{b}' AS right_item, CASE WHEN EXISTS (SELECT 1 FROM it WHERE item IN ('{a}', '{b}') AND {names(KEYWORDS[a])} AND {names(KEYWORDS[b])}) THEN 'same-excerpt' ELSE 'project-level' END AS proximity "
        f"WHERE EXISTS (SELECT 1 FROM it WHERE item = '{a}') AND EXISTS (SELECT 1 FROM it WHERE item = '{b}')"
        for a, b in RULES
    )


def _subgraph_sql(hops: int, nodes: int, edges: int) -> str:
    """The walk as windows over the whole visiting sequence: an edge counts where it first occurs, the first excess halts."""
    return f"""WITH RECURSIVE {_E}, {_SEED}, sd AS (SELECT node FROM seeds ORDER BY node LIMIT 50), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
b AS (SELECT node, 0 AS hop FROM sd UNION SELECT u.dst, b.hop + 1 FROM b JOIN u ON u.src = b.node WHERE b.hop < {hops}),
v AS (SELECT node, min(hop) AS hop FROM b GROUP BY 1),
w AS (SELECT hop, node, 1 AS d, src, dst, dst AS o FROM v JOIN e ON e.src = v.node WHERE hop < {hops} UNION ALL SELECT hop, node, 2, src, dst, src FROM v JOIN e ON e.dst = v.node WHERE hop < {hops}),
q AS (SELECT *, row_number() OVER (ORDER BY hop, node, d, o) AS pos FROM w),
f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY pos) = 1),
n AS (SELECT x AS node, min(pos) AS pos FROM (SELECT src AS x, pos FROM f UNION ALL SELECT dst, pos FROM f) WHERE x NOT IN (SELECT node FROM sd) GROUP BY 1),
c AS (SELECT f.*, row_number() OVER (ORDER BY f.pos) - 1 AS before, (SELECT count(*) FROM sd) + (SELECT count(*) FROM n WHERE n.pos <= f.pos) AS total FROM f),
h AS (SELECT pos, hop, node, d, CASE WHEN total > {nodes} THEN 'node-bound' ELSE 'edge-bound' END AS reason FROM c WHERE total > {nodes} OR before >= {edges} ORDER BY pos LIMIT 1),
k AS (SELECT node, 0 AS hop FROM sd UNION ALL SELECT n.node, v.hop FROM n JOIN v USING (node) WHERE n.pos < coalesce((SELECT pos FROM h), 9223372036854775807)),
s AS (SELECT k.node, k.hop, t.d, t.direction, (SELECT (k.hop, k.node, t.d) > (h.hop, h.node, h.d) FROM h) AS late, (SELECT (k.hop, k.node, t.d) = (h.hop, h.node, h.d) FROM h) AS here FROM k, (VALUES (1, 'superseding'), (2, 'superseded')) t(d, direction))
SELECT node, CAST(hop AS INTEGER) AS hop, direction, CASE WHEN hop >= {hops} OR late THEN 'NOT_STARTED' WHEN here THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
CASE WHEN hop >= {hops} THEN 'edge-hop-bound' WHEN late OR here THEN (SELECT reason FROM h) END AS reason,
CASE WHEN hop >= {hops} OR late THEN 0 ELSE (SELECT count(*) FROM f WHERE f.node = s.node AND f.d = s.d AND f.pos < coalesce((SELECT pos FROM h), 9223372036854775807)) END AS edges FROM s"""


SQL = {
    "upsert_latest": f"WITH {_OB} SELECT o_orderkey, o_orderstatus FROM new UNION ALL SELECT o_orderkey, o_orderstatus FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)",
    "replace_source": f"WITH {_OB} SELECT o_orderkey, o_custkey, o_orderstatus FROM new UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)",
    "delete_source": f"WITH {_OB} SELECT o_orderkey FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)",
    "insert_if_absent": f"WITH {_OB} SELECT o_orderkey, o_orderstatus FROM old UNION ALL SELECT o_orderkey, o_orderstatus FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)",
    "identity_conflicts": f"WITH {_OB} SELECT new.o_orderkey FROM new JOIN old USING (o_orderkey) WHERE new.o_orderstatus <> old.o_orderstatus OR new.o_totalprice <> old.o_totalprice",
    "stale_sources": f"WITH {_OB} SELECT DISTINCT o_custkey FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)",
    "snapshot_conflicts": """WITH m AS (SELECT DISTINCT snapshot_id, population_index, stored_at FROM kec_requirement_snapshot_members)
SELECT snapshot_id FROM m GROUP BY 1 HAVING count(*) FILTER (stored_at < TIMESTAMP '2024-01-01') > 0 AND count(*) FILTER (stored_at >= TIMESTAMP '2024-01-01') > 0""",
    "keyset_page": """WITH p AS (SELECT DISTINCT decision_namespace, record_key FROM decision_records WHERE (decision_namespace, record_key) > ('annex', 'DR-00000100') ORDER BY 1, 2 LIMIT 101)
SELECT decision_namespace, record_key, (SELECT count(*) FROM p) > 100 AS has_more FROM p ORDER BY 1, 2 LIMIT 100""",
    "distinct_addresses": "SELECT DISTINCT decision_namespace, decision_record_key FROM decision_bases",
    "source_paths": "SELECT DISTINCT collection, source_path FROM kec_chunks",
    "index_diagnostics": """WITH c AS (SELECT DISTINCT collection, chunk_seq, source_path, embedding, text FROM kec_chunks),
d AS (SELECT *, coalesce(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) = 0, false) AS z FROM c),
g AS (SELECT collection, count(*) AS n_chunks, count(DISTINCT source_path) AS n_sources, count(*) FILTER (embedding IS NULL) AS n_missing, count(*) FILTER (z) AS n_zero,
count(DISTINCT len(embedding)) AS n_dimensions, count(*) FILTER (trim(text) = '') AS n_blank FROM d GROUP BY 1)
SELECT *, CASE WHEN n_missing > 0 OR n_zero > 0 OR n_dimensions > 1 OR n_blank > 0 THEN 'DEGRADED' ELSE 'READY' END AS status FROM g""",
    "batch_outcome": """WITH s AS (SELECT min(o_orderkey) FILTER (o_totalprice > 300000) AS stop FROM orders)
SELECT CASE WHEN stop IS NULL OR o_orderkey < stop THEN 'SUCCEEDED' WHEN o_orderkey = stop THEN 'FAILED' ELSE 'NOT_ATTEMPTED' END AS status, count(*) AS n FROM orders, s GROUP BY 1""",
    "graph_components": f"""WITH RECURSIVE {_E}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c AS (SELECT src AS node, src AS other FROM u UNION SELECT c.node, u.dst FROM c JOIN u ON u.src = c.other)
SELECT node, min(other) AS component FROM c GROUP BY 1""",
    "reference_cycles": f"WITH RECURSIVE {_CYC} SELECT s AS node, m AS cycle FROM low WHERE n > 1",
    "containment_check": f"WITH RECURSIVE {_CYC}, lab AS (SELECT s, m FROM low WHERE n > 1) SELECT count(*) > 0 AS has_cycle, count(*) AS n_cyclic_edges FROM e JOIN lab a ON a.s = e.src JOIN lab b ON b.s = e.dst WHERE a.m = b.m",
    "bounded_subgraph": _subgraph_sql(3, 200, 150),
    "graph_neighbors": f"""WITH {_E}, a AS (SELECT DISTINCT decision_namespace || '/' || record_key AS node FROM decision_records WHERE decision_namespace = 'annex')
SELECT src AS node, dst AS neighbour FROM e JOIN a ON a.node = e.src UNION SELECT dst, src FROM e JOIN a ON a.node = e.dst""",
    "graph_contained": f"""WITH {_E}, a AS (SELECT DISTINCT decision_namespace || '/' || record_key AS node FROM decision_records WHERE decision_namespace = 'annex')
SELECT DISTINCT dst AS node, src AS neighbour FROM e JOIN a ON a.node = e.dst""",
    "bounded_bfs": f"""WITH RECURSIVE {_E}, {_SEED}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
b AS (SELECT node, 0 AS hop FROM seeds UNION SELECT u.dst, b.hop + 1 FROM b JOIN u ON u.src = b.node WHERE b.hop < 4) SELECT node, min(hop) AS hop FROM b GROUP BY 1""",
    "supersession_lookup": f"WITH {_E}, {_SEED} SELECT src, dst FROM e WHERE src IN (SELECT node FROM seeds) OR dst IN (SELECT node FROM seeds)",
    "graph_projection": f"""WITH {_REL} SELECT *, sha256('{{"edge_type":"' || edge_type || '","source":"' || source || '","target":"' || target || '","direction":"' || direction || '"}}') AS edge_id FROM x""",
    "relationship_resolution": f"""WITH c AS (SELECT l_partkey || ':' || l_suppkey AS key, l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_returnflag = 'A' THEN 'CONNECTED_TO' WHEN l_returnflag = 'N' THEN 'CONNECTED_VIA' ELSE 'UNKNOWN' END AS kind,
l_linenumber AS p, {_R6.format('least(0.55 + l_discount * 4, (0.55 + l_discount * 4) * 0.4 + 0.6)')} AS conf FROM lineitem WHERE l_linestatus = 'O'),
v AS (SELECT * FROM c WHERE kind <> 'UNKNOWN' AND conf >= 0.6),
g AS (SELECT key, string_agg('line:' || id, ',' ORDER BY 'line:' || id) AS evidence, count(DISTINCT (p, conf)) = 1 AND count(DISTINCT kind) > 1 AS amb FROM v GROUP BY 1),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY p DESC, conf DESC, kind, id) = 1)
SELECT b.key, b.id AS candidate_id, b.kind AS relationship_type, b.conf AS confidence, g.evidence FROM b JOIN g USING (key) WHERE NOT g.amb""",
    "object_scores": f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_R6.format('round(greatest(0.0, least(1.0, l_discount * 10 * 0.30 + (1 - l_tax) * 0.30 + l_quantity / 50 * 0.25 + 0.5 * 0.10 + 1.0 * 0.05 - l_tax / 2)), 12)')} AS confidence FROM lineitem)
SELECT *, CASE WHEN confidence < 0.6 THEN 'EXCLUDED' WHEN confidence < 0.8 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END AS status FROM s""",
    "spatial_relations": f"WITH {_NEAR} SELECT text_id, prim_id, topology, distance, CAST(rank AS INTEGER) AS rank FROM near",
    "spatial_statistics": f"WITH {_NEAR} SELECT t.topology, count(near.text_id) AS n FROM (VALUES ('contains'), ('disjoint'), ('inside'), ('overlaps'), ('touches')) t(topology) LEFT JOIN near USING (topology) GROUP BY 1",
    "duplicate_groups": """WITH g AS (SELECT text, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT text, n, 'duplicate-' || lpad(CAST(row_number() OVER (ORDER BY first) AS VARCHAR), 6, '0') AS group_id FROM g) SELECT doc_id, group_id, n FROM documents JOIN k USING (text)""",
    "positional_ids": "SELECT o_orderkey, 'text-item-' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 6, '0') AS item_id FROM orders",
    "nearest_band_join": """WITH j AS (SELECT c_custkey, p_partkey, abs(c_acctbal - p_retailprice) AS d FROM customer JOIN part ON abs(c_acctbal - p_retailprice) <= 0.5),
k AS (SELECT *, min(d) OVER (PARTITION BY c_custkey) AS m FROM j) SELECT c_custkey, arg_min(p_partkey, struct_pack(a := d, b := p_partkey)) AS p_partkey, count(*) AS n_ties FROM k WHERE d - m <= 0.001 GROUP BY 1""",
    "page_map_join": "SELECT catalog_id, item_code, count(DISTINCT listing_id) AS n, CASE WHEN count(DISTINCT listing_id) = 1 THEN min(listing_id) END AS listing_id FROM material_knowledge_metadata GROUP BY 1, 2",
    "duplicate_items": """WITH d AS (SELECT DISTINCT catalog_id, item_code, listing_id FROM material_knowledge_metadata)
SELECT catalog_id, item_code, string_agg(CAST(listing_id AS VARCHAR), ',' ORDER BY listing_id) AS listing_ids FROM d GROUP BY 1, 2 HAVING count(*) > 1""",
    "anti_unmatched": "SELECT DISTINCT decision_namespace, record_key FROM decision_records r WHERE NOT EXISTS (SELECT 1 FROM decision_bases b WHERE b.decision_namespace = r.decision_namespace AND b.decision_record_key = r.record_key)",
    "orphan_audit": """SELECT DISTINCT snapshot_id, 'member-without-header' AS issue FROM kec_requirement_snapshot_members WHERE snapshot_id NOT IN (SELECT snapshot_id FROM kec_requirement_snapshots)
UNION ALL SELECT DISTINCT snapshot_id, 'header-without-member' FROM kec_requirement_snapshots WHERE snapshot_id NOT IN (SELECT snapshot_id FROM kec_requirement_snapshot_members)""",
    "bbox_union": f"WITH {_BX} SELECT label, min(px) AS x, min(py) AS y, {_R6.format('max(px + pw) - min(px)')} AS width, {_R6.format('max(py + ph) - min(py)')} AS height FROM pb GROUP BY 1",
    "quality_eval": """WITH e AS (SELECT DISTINCT decision_namespace, decision_record_key AS k FROM decision_bases), a AS (SELECT DISTINCT decision_namespace, record_key AS k FROM decision_records WHERE deleted_at IS NULL),
s AS (SELECT (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM a)) AS tp, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM e)) AS fp, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM a)) AS fn)
SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM s""",
    "design_items": f"WITH {items_sql()} SELECT item, n, doc_id, line_no, keyword, excerpt FROM it",
    "design_relations": f"WITH {items_sql()} {_relations_sql()}",
    "validation_issues": """WITH c AS (SELECT DISTINCT chunk_seq, collection, chunk_id, text, embedding FROM kec_chunks)
SELECT 'CHUNK_ID_DUPLICATE' AS code, chunk_id AS entity_id, 'a chunk id occurs twice in its collection' AS message FROM c GROUP BY collection, chunk_id HAVING count(*) > 1
UNION ALL SELECT 'TEXT_TOO_SHORT', CAST(chunk_seq AS VARCHAR), 'a chunk has fewer than 15 characters' FROM c WHERE length(text) < 15
UNION ALL SELECT 'VECTOR_MISSING', CAST(chunk_seq AS VARCHAR), 'a chunk has no vector' FROM c WHERE embedding IS NULL
UNION ALL SELECT 'VECTOR_ZERO', CAST(chunk_seq AS VARCHAR), 'a vector has no length' FROM c WHERE list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) = 0
UNION ALL SELECT 'VECTOR_NOT_FINITE', CAST(chunk_seq AS VARCHAR), 'a vector holds NaN' FROM c WHERE len(list_filter(embedding, lambda x: isnan(x))) > 0
UNION ALL SELECT 'BASIS_WITHOUT_RECORD', CAST(basis_seq AS VARCHAR), 'a basis names no record' FROM (SELECT DISTINCT basis_seq, decision_namespace, decision_record_key FROM decision_bases) b
WHERE NOT EXISTS (SELECT 1 FROM decision_records r WHERE r.decision_namespace = b.decision_namespace AND r.record_key = b.decision_record_key)""",
}
