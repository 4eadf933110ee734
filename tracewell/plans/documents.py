"""Queries: drawing lists, title blocks, request reviews, document validation, inference chains and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as text_functions
from tracewell.operators import assembly, drawing_lists, drawings, graph, indexing, inference, retrieval, review, store, validation
from tracewell.plans.records import KEYWORDS, items_sql, project_items as records_items
from tracewell.plans.retrieval import GROUPS
from tracewell.sources import table

# --- drawing lists and title blocks ----------------------------------------------------------------

_TITLES = ["접지 평면도", "전등 배선도", "MCC 결선도", "소방 기계 도면 목록", "101동 3층 전열", "2단지 지하1층 동력", "일반 사항"]


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of a drawing list for each listing: twenty a page, ten a block."""
    m = table(spark, sf_dir, "material_knowledge_metadata").where("listing_id is not null").select("listing_id").distinct()
    i = F.col("listing_id")
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (i % len(_TITLES) + 1).cast("int"))
    return m.select(
        i.alias("i"), F.floor(i / 20).cast("int").alias("page"), F.floor(i % 20 / 10).cast("int").alias("b"), (480.0 - 12 * (i % 10)).alias("x"),
        F.concat(F.lit("E-"), F.lpad((i % 10_000).cast("string"), 4, "0")).alias("number"), F.concat(title, F.lit(" "), (i % 13).cast("string")).alias("title"),
    )


def _list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items: numbers whole or in two parts, doubled numbers, missing titles and numbers, scales and headers."""
    rows = _listed(spark, sf_dir).withColumn("top", 760.0 - 380 * F.col("b"))
    i = F.col("i")
    item = lambda text, x, y, when=F.lit(True): F.when(when, F.struct(text.alias("str"), x.alias("x"), y.alias("y"), F.lit(20.0).alias("width")))
    x, top = F.col("x"), F.col("top")
    whole, parts, none = (i % 7 != 0) & (i % 13 != 0), (i % 7 == 0) & (i % 13 != 0), i % 17 == 0
    items = [
        item(F.col("number"), x, top, whole), item(F.lit("E-"), x, top, parts), item(F.substring("number", 3, 9), x + 0.25, top - 5, parts), item(F.lit("F-100"), x, top - 9, i % 11 == 0),
        item(F.col("title"), x + i % 5, top - 60, ~none), item(F.lit("1 / 100"), x + 1, top - 200, i % 4 != 0), item(F.when(i % 5 == 0, "none").otherwise("1/200"), x, top - 241, i % 20 != 1),
    ]
    made = rows.select("page", F.explode(F.array_compact(F.array(*items))).alias("o")).select("page", "o.*")
    heads = rows.where(i % 60 != 59).select("page", "top").distinct()
    head = F.array(*[F.struct(F.lit(w).alias("str"), F.lit(500.0).alias("x"), (F.col("top") - d).alias("y"), F.lit(30.0).alias("width")) for w, d in (("도면 번호", 0), ("도면명", 60), ("A1", 200), ("a3", 240))])
    return made.unionByName(heads.select("page", F.explode(head).alias("o")).select("page", "o.*"))


def drawing_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing_lists.parse_drawing_list(_list_items(spark, sf_dir))[0]


def drawing_list_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing_lists.parse_drawing_list(_list_items(spark, sf_dir))[1]


def _page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title block for each listing: its number in one or two texts, for some a second number, its title, texts outside the zones."""
    rows, i = _listed(spark, sf_dir), F.col("i")
    item = lambda text, x, y, when=F.lit(True): F.when(when, F.struct(text.alias("str"), (F.lit(x) * 600).alias("x"), (F.lit(y) * 800).alias("y")))
    other = F.concat(F.lit("e "), F.lpad(((i + 1) % 10_000).cast("string"), 4, "0"))
    items = [
        item(F.lower("number"), 0.11, 0.1, i % 3 != 0), item(F.lit("E"), 0.111, 0.16, i % 3 == 0), item(F.substring("number", 2, 9), 0.112, 0.12, i % 3 == 0), item(other, 0.12, 0.1, i % 5 == 0),
        item(F.lit("E-7777"), 0.5, 0.1), item(F.col("title"), 0.15, 0.1, i % 9 != 0), item(F.lit("NONE"), 0.16, 0.1), item(F.lit("1/100"), 0.17, 0.1),
    ]
    made = rows.select(F.lit("set").alias("source"), F.col("i").cast("int").alias("page"), F.explode(F.array_compact(F.array(*items))).alias("o"))
    return made.select("source", "page", "o.*", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


def page_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages mapped to the drawing whose number stands in their title block, judged by its title."""
    index = _listed(spark, sf_dir).where("i % 19 <> 0").select(F.col("number").alias("drawing_no"), "title").dropDuplicates(["drawing_no"])
    return drawing_lists.parse_pages(_page_items(spark, sf_dir), index)


# --- requests and reviews ---------------------------------------------------------------------------

REQUESTS = ["도면을 찾아줘 접지봉 Haldrin", "cable tray 검토해줘", "관련 도면 HDPE conduit 검색", "nothing anywhere 기준"]


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, listing_id, score: the share of the request's words that a listing's name holds, of those with any."""
    m = table(spark, sf_dir, "material_knowledge_metadata").where("name is not null").dropDuplicates(["listing_id"])
    out = None
    for r in REQUESTS:
        words = review.request_query(r).lower().split()
        hit = sum((F.contains(F.lower("name"), F.lit(w)).cast("int") for w in words), F.lit(0))
        mine = m.select(F.lit(r).alias("request"), "listing_id", (hit / float(len(words))).alias("score")).where("score > 0")
        out = mine if out is None else out.unionByName(mine)
    return out


def request_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the one best result, several as good, or none."""
    requests = spark.createDataFrame([(r,) for r in REQUESTS], "request string")
    return review.review_requests(requests, _found(spark, sf_dir), "request", "score", "listing_id")


def review_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).where(F.col("request") == REQUESTS[1])
    m = table(spark, sf_dir, "material_knowledge_metadata").select("listing_id", "name").dropDuplicates(["listing_id"])
    return review.review_prompt(REQUESTS[1], "E-0001", "page text", found.join(m, "listing_id"), [F.desc("score"), "listing_id"], "listing_id", "name", 10)


_EVIDENCE = {"cable": ["cable", "케이블"], "tray": ["tray", "트레이"], "breaker": ["breaker", "차단기"], "rod": ["earth rod", "접지봉", "ground rod"], "lamp": ["lamp", "등기구"], "panel": ["panel", "no such panel"]}
_EVIDENCE_RULES = [("cable", "tray"), ("breaker", "cable"), ("rod", "lamp"), ("rod", "cable"), ("panel", "lamp"), ("breaker", "tray")]


def evidence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that catalogue rows (name and specification apart) and document sentences state, and how near they stand."""
    m = table(spark, sf_dir, "material_knowledge_metadata").dropDuplicates(["listing_id"])
    cells = m.select(F.explode(F.array("name", "specification")).alias("excerpt"), F.lit("excel").alias("source_type"), "source_path", "sheet_name", "row_index").where("excerpt is not null")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("source", F.explode(F.split("text", r"\r\n|\r|\n")).alias("excerpt"))
    none = F.lit(None)
    lines = docs.select("excerpt", F.lit("pdf").alias("source_type"), F.col("source").alias("source_path"), none.cast("string").alias("sheet_name"), none.cast("int").alias("row_index"))
    item = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(F.lower("excerpt"), k)), F.lit(i)) for i, ks in _EVIDENCE.items()]))
    return review.evidence_relations(cells.unionByName(lines).withColumn("item", F.explode(item)), _EVIDENCE_RULES, _EVIDENCE)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of chunks and catalogue rows: id, domain, label, place."""
    chunks = table(spark, sf_dir, "kec_chunks").dropDuplicates(["chunk_seq"])
    label = F.coalesce("clause", F.lit("Unknown clause"))
    page = F.coalesce(F.col("page").cast("string"), F.lit("?"))
    kec = chunks.where("collection = 'kec'").select(F.concat(F.lit("kec:"), "source_path", F.lit(":p"), page, F.lit(":"), label).alias("citation_id"), F.lit("kec").alias("domain"), label.alias("label"), F.col("page").alias("place"))
    company = chunks.where("collection = 'company'").select(F.concat(F.lit("company:"), "chunk_id"), F.lit("company"), F.concat("document_id", F.lit(": "), "source_path"), "page")
    m = table(spark, sf_dir, "material_knowledge_metadata").dropDuplicates(["listing_id"])
    material = m.select(F.concat(F.lit("material:"), F.col("listing_id").cast("string")), F.lit("material"), F.concat("item_code", F.lit(": "), F.coalesce("name", F.lit(""))), "row_index")
    return kec.union(company).union(material).distinct()


def managed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each path, and some spoilt forms of it, is one of the managed folder, and its parent folder."""
    p = table(spark, sf_dir, "kec_chunks").select("source_path").where("source_path is not null").distinct()
    forms = F.array("source_path", F.concat(F.lit("/"), "source_path"), F.concat(F.lit("a/../"), "source_path"), F.replace("source_path", F.lit("/"), F.lit("\\")), F.concat("source_path", F.lit(".txt")), F.upper("source_path"), F.lit(".pdf"))
    rows = p.select(F.explode(forms).alias("path")).distinct()
    return rows.select("path", review.managed_path(F.col("path")).alias("is_managed"), review.parent_directory(F.col("path")).alias("parent"))


# --- stores -----------------------------------------------------------------------------------------


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "kec_chunks").where("embedding is not null and size(embedding) > 0")
    return c.groupBy("collection").agg(F.lit("local").alias("provider"), F.concat(F.lit("model-"), F.max(F.size("embedding")).cast("string")).alias("model"), F.max(F.size("embedding")).alias("dimensions"), F.max("indexed_at").alias("saved_at"))


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of each index after a later write of one collection replaced its row."""
    old = _metadata(spark, sf_dir)
    new = old.where("collection = 'company'").withColumn("model", F.lit("model-next")).withColumn("saved_at", F.col("saved_at") + F.expr("interval 1 day"))
    return store.upsert(old, new, ["collection"], "saved_at").select("collection", "provider", "model", "dimensions")


def write_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming sources of three shapes against the indexes: same vectors, another model, vectors of mixed length."""
    chunks = table(spark, sf_dir, "kec_chunks")
    meta = _metadata(spark, sf_dir)
    ways = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m"), F.lit(a).alias("least"), F.lit(b).alias("most")) for s, m, a, b in (("new-a.pdf", "model-64", 64, 64), ("new-b.pdf", "other", 64, 64), ("new-c.pdf", "model-64", 32, 64), ("new-d.pdf", "model-64", 32, 32))])
    incoming = meta.select("collection", F.explode(ways).alias("w")).select("collection", F.col("w.s").alias("source_path"), F.lit("local").alias("provider"), F.col("w.m").alias("model"), "w.least", "w.most")
    return store.write_compatibility(chunks, meta.where("collection <> 'site_specs'"), incoming)


def append_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bases recorded before 2024 with the later ones appended behind them in the order of their time."""
    bases = table(spark, sf_dir, "decision_bases").select("basis_seq", "decision_namespace", "decision_record_key", "recorded_at").distinct()
    old, new = bases.where("recorded_at < timestamp'2024-01-01'"), bases.where("recorded_at >= timestamp'2024-01-01'").withColumn("was", F.col("basis_seq"))
    return store.append_facts(old.withColumn("was", F.lit(None).cast("long")), new, "basis_seq", ["recorded_at", "was"]).select("basis_seq", "was", "decision_record_key")


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections in canonical form, with a typed level of the context; what is no JSON is null and marked."""
    r = table(spark, sf_dir, "decision_records").select("decision_namespace", "record_key", "selection", "context").distinct()
    bad = F.when(F.length("record_key") % 9 == 0, F.concat("selection", F.lit("}"))).otherwise(F.col("selection"))
    level = F.try_variant_get(F.try_parse_json(F.col("context")), "$.level", "int")
    return r.select("decision_namespace", "record_key", store.canonical_json(bad).alias("canonical"), (bad.isNotNull() & store.canonical_json(bad).isNull()).alias("is_broken"), level.alias("level")).distinct()


def json_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each locator of each snapshot member, decoded by its type."""
    m = table(spark, sf_dir, "kec_requirement_snapshot_members").where("locators_json is not null").select("snapshot_id", "population_index", "locators_json").distinct()
    rows = m.select("snapshot_id", "population_index", F.posexplode(F.from_json("locators_json", "array<struct<page:int,start:int,end:int>>")).alias("at", "l"))
    return rows.select("snapshot_id", "population_index", "at", "l.page", "l.start", "l.end")


# --- objects, relationships and graphs --------------------------------------------------------------

_TYPES = sorted(inference.NODE_TYPES)


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each part, with scores from its columns; some are spoilt in one way each."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    score = {"geometry": F.col("p_size") / 50, "text": F.lit(0.9), "topology": (k % 10) / 10, "context": F.lit(0.5), "source": F.lit(1.0)}
    rows = p.select(
        F.concat(F.lit("p"), k.cast("string")).alias("object_id"), F.when(k % 37 == 0, "MYSTERY").otherwise(F.element_at(F.array(*map(F.lit, _TYPES)), (k % len(_TYPES) + 1).cast("int"))).alias("object_type"),
        *[v.cast("double").alias(n) for n, v in score.items()], F.lit(0.05).alias("penalty"), k.alias("k"),
        F.when(k % 29 == 0, F.array().cast("array<bigint>")).when(k % 43 == 0, F.array(k, k + 1)).otherwise(F.array(k)).alias("primitive_ids"),
        F.when(k % 47 == 0, -1.0).otherwise(5.0).alias("width"), F.lit(5.0).alias("height"),
    )
    conf = graph.object_confidence({n: n for n in graph.OBJECT_WEIGHTS}, "penalty")
    rows = rows.withColumn("confidence", F.when(F.col("k") % 41 == 0, conf - 0.25).otherwise(conf))
    return rows.unionByName(rows.where("k % 53 = 0")).drop("k")


def object_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    primitives = table(spark, sf_dir, "part").where("p_partkey % 59 <> 0").select(F.col("p_partkey").alias("primitive_id"))
    return validation.object_issues(_objects(spark, sf_dir), primitives)


def construction_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as primitives against parts as classifications, some doubled and some left out on either side."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    a, b = p.where("p_partkey % 31 <> 0"), p.where("p_partkey % 29 <> 0")
    return validation.construction_issues(a.unionByName(a.where("p_partkey % 17 = 0")), b.unionByName(b.where("p_partkey % 23 = 0")), "p_partkey")


def identity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "kec_chunks").where("source_path is not null and page is not null")
    return validation.identity_issues([c.where("text is not null"), c.where("embedding is not null"), c.where("clause is not null")], ["source_path", "page"])


def capture_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "kec_requirement_snapshot_members").select("snapshot_id", "population_index", "requirement_id").distinct()
    i = F.col("population_index")
    seen = m.where(i % 7 != 3).select("snapshot_id", F.when(i % 11 == 5, i + 100_000).otherwise(i).alias("population_index"), F.when(i % 5 == 2, F.concat("requirement_id", F.lit("x"))).otherwise(F.col("requirement_id")).alias("requirement_id"))
    return validation.capture_issues(m, seen)


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, parts and suppliers as objects with a confidence and one piece of evidence each; some orders are missing."""
    one = lambda name, key, prefix: table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("object_id"), (F.lit(0.6) + F.col(key) % 40 / 100).alias("confidence"), F.col(key).alias("k"))
    rows = one("orders", "o_orderkey", "o").where("k % 101 <> 0").unionByName(one("part", "p_partkey", "p")).unionByName(one("supplier", "s_suppkey", "s"))
    return rows.select("object_id", "confidence", F.array(F.concat(F.lit("primitive:"), "object_id")).alias("evidence"))


def relationship_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, o = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    kind = F.when(F.col("l_returnflag") == "N", "CONNECTED_VIA").when(F.col("l_linestatus") == "F", "CONNECTED_TO").otherwise("UNKNOWN")
    source, target = F.concat(F.lit("o"), o.cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    end = F.least(F.lit(0.6) + o % 40 / 100, F.lit(0.6) + F.col("l_partkey") % 40 / 100)
    conf = graph.relationship_confidence(end)
    rows = lines.select(
        F.concat(F.lit("r"), o.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("relationship_id"), kind.alias("relationship_type"), source.alias("source_id"),
        F.when(o % 73 == 0, source).otherwise(target).alias("target_id"), F.when((kind == "CONNECTED_VIA") & (o % 79 != 0), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("via_id"),
        F.when(o % 97 == 0, conf + 0.5).otherwise(conf).alias("confidence"),
        F.when(o % 83 == 0, F.array().cast("array<string>")).when(o % 89 == 0, F.array(F.lit("primitive:none"))).otherwise(F.array(F.concat(F.lit("primitive:"), source))).alias("evidence"),
    )
    return validation.relationship_issues(rows, _ends(spark, sf_dir))


def _record_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records as nodes, each supersession as a connection and as a containment; some are spoilt in one way each."""
    s = table(spark, sf_dir, "decision_supersessions")
    name = lambda k: F.concat_ws("/", f"{k}_namespace", f"{k}_record_key")
    pairs = s.groupBy(name("superseded").alias("a"), name("superseding").alias("b")).agg(F.min("supersession_seq").alias("q")).where("a <> b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    turned = F.col("q") % 31 == 0
    link = pairs.select(F.concat(F.lit("c"), F.col("q").cast("string")).alias("edge_id"), F.lit("CONNECTED").alias("edge_type"), F.when(turned, high).otherwise(low).alias("source"), F.when(turned, low).otherwise(high).alias("target"), F.when(F.col("q") % 37 == 0, "FORWARD").otherwise("UNDIRECTED").alias("direction"))
    holds = pairs.select(F.concat(F.lit("h"), F.col("q").cast("string")), F.lit("CONTAINS"), F.col("b"), F.col("a"), F.lit("FORWARD"))
    edges = link.union(holds)
    nodes = table(spark, sf_dir, "decision_records").select(F.concat_ws("/", "decision_namespace", "record_key").alias("node_id")).distinct()
    kinds = ["PANEL", "BREAKER", "CABLE", "LOAD", "SPARE"]
    real = pairs.join(nodes.toDF("a"), "a", "left_semi").join(nodes.toDF("b"), "b", "left_semi")
    parts = graph.connected_components(real, nodes, "a", "b").withColumnRenamed("node", "node_id")
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.length("node_id") % len(kinds) + 1)
    own = F.when(F.length("node_id") % 11 == 0, F.concat(F.lit("x"), "node_id")).otherwise(F.col("component"))
    return parts.select("node_id", kind.alias("node_type"), own.alias("component_id"), F.substring_index("node_id", "/", -1).alias("display_name")), edges


def graph_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _record_graph(spark, sf_dir)
    return validation.graph_issues(nodes.drop("display_name"), edges)


def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that one query of each kind finds: by type, by name, by id, and one hop from the record with most neighbours."""
    nodes, edges = _record_graph(spark, sf_dir)
    degree = edges.where("edge_type = 'CONTAINS'").groupBy("source").agg(F.count("*").alias("n"))
    hub = degree.join(nodes.select(F.col("node_id").alias("source")), "source").orderBy(F.desc("n"), "source").first()
    hub = hub["source"] if hub else "none"
    asks = [("FIND_NODES_BY_TYPE", "PANEL"), ("FIND_NODES_BY_DISPLAY_NAME", hub.split("/")[-1]), ("FIND_NODE", hub), ("FIND_NODE", "unknown"), ("FIND_CONNECTED_NEIGHBORS", hub), ("FIND_CONTAINED_NODES", hub), ("FIND_REFERENCED_NODES", hub)]
    out = None
    for kind, value in asks:
        found = graph.query_graph(nodes, edges, kind, value).select(F.lit(kind).alias("kind"), "node_id")
        out = found if out is None else out.unionByName(found)
    return out


def _touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (parts) of one order whose lines follow each other touch at an end; each second pair is only near."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("part"))
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("part").alias("b"))
    pairs = lines.withColumnRenamed("part", "a").join(nxt, ["l_orderkey", "l_linenumber"])
    return pairs.select("a", "b", F.when(F.col("l_orderkey") % 2 == 0, "ENDPOINT_CONTACT").otherwise("NEAR").alias("edge_type"))


def _plain_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where("p_partkey % 13 <> 0").select(F.concat(F.lit("p"), k.cast("string")).alias("object_id"), (F.lit(0.5) + k % 50 / 100).alias("confidence"))


def construction_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.construction_graph(_plain_objects(spark, sf_dir), _touching(spark, sf_dir))[0]


def inferred_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From objects and contacts to the relationships that hold: graph, rule, resolution."""
    objects = _plain_objects(spark, sf_dir)
    edges, _ = inference.construction_graph(objects, _touching(spark, sf_dir))
    rules = {"endpoint-contact": inference.endpoint_contacts}
    kept = graph.resolve_relationships(inference.run_rules(rules, {"objects": objects, "edges": edges}))
    return kept.select("key", "relationship_type", F.round("confidence", 6).alias("confidence"), F.array_join("evidence", ",").alias("evidence"))


def object_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaced evidence of each order: its parts as primitives, its return flags as labels."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"), F.collect_list("l_returnflag").alias("flags"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("object_id"), "parts", "flags")
    found = inference.evidence_index(rows, {"primitive": "parts", "label": "flags"})
    return found.select("object_id", F.array_join("evidence", ",").alias("evidence"))


def object_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by type with the types that do not occur, and the node type of each."""
    objects = _objects(spark, sf_dir).where("object_type not in ('MYSTERY', 'SWITCH')").dropDuplicates(["object_id"])
    return inference.node_types(inference.typed_counts(objects, "object_type", _TYPES))


# --- pipelines --------------------------------------------------------------------------------------


def index_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source after a part of the documents was indexed anew; what may not be written keeps its old chunks."""
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", "text").dropDuplicates(["doc_id"])
    kind = F.when(F.length("source") % 3 == 0, "a").when(F.length("source") % 3 == 1, "b").otherwise("c")
    none = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    existing = docs.where("doc_id % 2 = 0").select(kind.alias("collection"), F.col("source").alias("source_path"), F.col("doc_id").cast("int").alias("page"), F.lit(0).alias("chunk_index"), F.lit("old").alias("text"), none.alias("embedding"))
    metadata = spark.createDataFrame([("a", "local", "groups", 4), ("b", "local", "groups", 5)], "collection string, provider string, model string, dimensions int")
    pages = docs.where("doc_id % 3 = 0").select(kind.alias("collection"), F.col("source").alias("source_path"), F.col("doc_id").cast("int").alias("page"), "text")
    chunks, _, outcome = indexing.index_pages(existing, metadata, pages, lambda t: text_functions.fixed_windows(t, 1200), lambda t: retrieval.placeholder_embedding(t, GROUPS), "local", "groups")
    per = chunks.groupBy("collection", "source_path").agg(F.count_if(F.col("text") == "old").alias("n_old"), F.count_if(F.col("text") != "old").alias("n_new"))
    return per.join(outcome.select("collection", "source_path", "status"), ["collection", "source_path"], "left")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate a vector, its label the page: its own primitive first, its neighbours' beside it."""
    v, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    name = lambda k: F.concat(F.lit("p"), k.cast("string"))
    return v.select(
        F.col("label").alias("page"), F.concat(F.lit("c"), i.cast("string")).alias("candidate_id"), F.lit("rule").alias("rule_id"), F.element_at(F.array(*map(F.lit, _TYPES)), (i % len(_TYPES) + 1).cast("int")).alias("object_type"),
        (F.lit(0.5) + i % 50 / 100).alias("confidence"), F.array(name(i)).alias("primary"), F.array(name(i + 10), name(i)).alias("supporting"), F.when(i % 3 == 0, F.array(F.lit("t2"), F.lit("t1"))).alias("labels"),
    )


def object_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    at = lambda n, k: F.round(F.col("embedding")[n].cast("double") * k, 3)
    primitives = v.select(F.col("label").alias("page"), F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("primitive_id"), at(0, 600).alias("x"), at(1, 600).alias("y"), F.abs(at(2, 60)).alias("width"), F.abs(at(3, 60)).alias("height"))
    out = assembly.assemble_objects(_candidates(spark, sf_dir), primitives, ["page"])
    return out.select("page", "object_id", "object_type", "status", F.array_join("primitive_ids", ",").alias("primitives"), F.array_join("label_ids", ",").alias("labels"), "x", "y", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


def object_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.object_statistics(_candidates(spark, sf_dir), ["page"])


def _project(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "kec_chunks").where("collection = 'company' and text is not null").select("chunk_seq", "text").dropDuplicates(["chunk_seq"])
    return records_items(spark, sf_dir), chunks


def item_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.item_knowledge(*_project(spark, sf_dir), KEYWORDS, "chunk_seq", "text")


def project_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword group: evidence in the documents, sources among the company chunks."""
    return review.project_review(*_project(spark, sf_dir), {**KEYWORDS, "turbine": ["no such turbine"]}, "chunk_seq", "text")


def hit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits made of chunks, some spoilt: keys doubled or missing, scores at or beyond the ends."""
    c, i = table(spark, sf_dir, "kec_chunks").select("chunk_seq", "text").dropDuplicates(["chunk_seq"]), F.col("chunk_seq")
    hits = c.select(F.when(i % 61 != 0, F.when(i % 7 == 0, i + 1).otherwise(i)).alias("key"), (i % 12 / 10).alias("score"), F.when(i % 53 == 0, "  ").otherwise(F.col("text")).alias("text"))
    return review.hit_issues(hits, "key", "score", "text")


QUERIES = {
    f.__name__: f
    for f in (
        drawing_list, drawing_list_warnings, page_parsing, request_selection, review_prompt, evidence_relations, citations, managed_paths, index_metadata, write_compatibility, append_bases,
        json_fields, json_locators, object_issues, construction_issues, identity_issues, capture_issues, relationship_issues, graph_issues, graph_lookup, construction_graph,
        inferred_relationships, object_evidence, object_types, index_pipeline, object_assembly, object_statistics, item_knowledge, project_review, hit_issues,
    )
}


# --- SQL twins --------------------------------------------------------------------------------------

_LISTED = f"""li AS (SELECT i, CAST(floor(i / 20) AS INTEGER) AS page, CAST(floor(i % 20 / 10) AS INTEGER) AS b, 480.0 - 12 * (i % 10) AS x, 'E-' || lpad(CAST(i % 10000 AS VARCHAR), 4, '0') AS number,
([{', '.join(f"'{t}'" for t in _TITLES)}])[i % {len(_TITLES)} + 1] || ' ' || (i % 13) AS title, i % 10 AS slot FROM (SELECT DISTINCT listing_id AS i FROM material_knowledge_metadata WHERE listing_id IS NOT NULL))"""
_CAT = " ".join(f"WHEN regexp_matches(title, '{p.replace('(?i)', '')}') THEN '{c}'" for c, p in drawings.CATEGORIES)
_CATS = " + ".join(f"CAST(regexp_matches(title, '{p.replace('(?i)', '')}') AS INTEGER)" for _, p in drawings.CATEGORIES)
_FLOOR_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(title, '{p.replace('(?i)', '')}'), '')" for p in drawing_lists.FLOORS) + ")"
# The rows of a block by the construction of the items: a row has the numbers, titles and scales of its own slot.
_LIST = f"""{_LISTED}, hb AS (SELECT DISTINCT page, b FROM li WHERE i % 60 <> 59),
hp AS (SELECT page, b, row_number() OVER (PARTITION BY page ORDER BY b) - 1 AS block FROM hb),
rw AS (SELECT li.*, block, (i % 7 <> 0 AND i % 13 <> 0) AS whole, (i % 7 = 0 AND i % 13 <> 0) AS parts, i % 11 = 0 AS other, i % 17 <> 0 AS titled FROM li JOIN hp USING (page, b)),
nb AS (SELECT *, CASE WHEN whole AND NOT other OR parts AND NOT other THEN number WHEN other AND NOT whole AND NOT parts THEN 'F-100' END AS drawing_no, whole OR parts OR other AS numbered FROM rw),
rk AS (SELECT *, CASE WHEN numbered THEN row_number() OVER (PARTITION BY page, block, numbered ORDER BY slot) END AS rowno FROM nb),
cf AS (SELECT *, CASE {_CAT} ELSE '기타' END AS category, {_CATS} > 1 AS several, nullif(regexp_extract(title, '\\d+단지'), '') AS complex, nullif(regexp_extract(title, '\\d{{3}}동'), '') AS building, {_FLOOR_SQL} AS floor,
CASE WHEN i % 4 <> 0 THEN '1/100' END AS a1, CASE WHEN i % 20 <> 1 THEN CASE WHEN i % 5 = 0 THEN 'none' ELSE '1/200' END END AS a3 FROM rk),
cg AS (SELECT *, round(0.8 + CASE WHEN a1 IS NULL THEN 0.0 ELSE 0.075 END + CASE WHEN a3 IS NULL THEN 0.0 ELSE 0.075 END + CASE WHEN complex IS NOT NULL OR building IS NOT NULL OR floor IS NOT NULL OR category <> '기타' THEN 0.05 ELSE 0.0 END - CASE WHEN several THEN 0.1 ELSE 0.0 END, 3)::DOUBLE AS confidence FROM cf),
ok AS (SELECT page, block, rowno, drawing_no, title, category, complex, building, floor, a1 AS scale_a1, nullif(a3, 'none') AS scale_a3, confidence, several FROM cg WHERE drawing_no IS NOT NULL AND titled)"""

_PAGE_SQL = f"""{_LISTED}, ix AS (SELECT number AS drawing_no, min(title) AS indexed FROM li WHERE i % 19 <> 0 GROUP BY 1),
cd AS (SELECT i, number AS drawing_no, CASE WHEN i % 3 <> 0 THEN 0.11 ELSE 0.1115 END AS place, title FROM li UNION ALL SELECT i, 'E-' || lpad(CAST((i + 1) % 10000 AS VARCHAR), 4, '0'), 0.12, title FROM li WHERE i % 5 = 0),
cc AS (SELECT i, drawing_no, CASE WHEN i % 9 <> 0 THEN title END AS found, greatest(0.0, 1 - abs(place - 65.9 / 595.0) / 0.02) AS zone FROM cd),
cl AS (SELECT c.*, regexp_replace(lower(coalesce(found, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS a, regexp_replace(lower(indexed), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS b FROM cc c JOIN ix USING (drawing_no)),
gr AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda k: substr(a, k, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda k: substr(b, k, 2))) AS gb FROM cl),
sm AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE len(list_intersect(ga, gb)) / greatest(len(ga), len(gb)) END AS sim FROM gr),
od AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY i) AS cnt, lead(sim) OVER w AS second FROM sm WINDOW w AS (PARTITION BY i ORDER BY sim DESC, zone DESC, drawing_no)),
fi AS (SELECT *, cnt = 1 OR (sim > 0 AND sim - second >= 0.15) AS clear, a = b AND a <> '' AS same FROM od WHERE n = 1)"""


def _request_words(r: str) -> list[str]:
    return review.request_query(r).lower().split()


_FOUND = "fd AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS request, listing_id, name, ({' + '.join(f'''CAST(contains(lower(name), '{w}') AS INTEGER)''' for w in _request_words(r))}) / {float(len(_request_words(r)))} AS score FROM (SELECT DISTINCT listing_id, name FROM material_knowledge_metadata WHERE name IS NOT NULL)"
    for r in REQUESTS
) + "), fs AS (SELECT * FROM fd WHERE score > 0)"
_SPACES = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _relations_sql() -> str:
    names = lambda ks: "(" + " OR ".join(f"contains(lower(excerpt), '{k}')" for k in ks) + ")"
    ev = " UNION ALL ".join(f"SELECT '{i}' AS item, * FROM ce WHERE {names(ks)}" for i, ks in _EVIDENCE.items())
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS left_item, '{b}' AS right_item, (SELECT max(CASE WHEN source_type = 'pdf' THEN 2 ELSE 1 END) FROM ev WHERE item IN ('{a}', '{b}') AND {names(_EVIDENCE[a])} AND {names(_EVIDENCE[b])}) AS one, "
        f"(SELECT count(*) FROM (SELECT DISTINCT source_path, sheet_name, row_index FROM ev WHERE item = '{a}' AND source_type = 'excel' AND row_index IS NOT NULL) x JOIN (SELECT DISTINCT source_path, sheet_name, row_index FROM ev WHERE item = '{b}' AND source_type = 'excel') y USING (source_path, sheet_name, row_index)) AS two "
        f"WHERE EXISTS (SELECT 1 FROM ev WHERE item = '{a}') AND EXISTS (SELECT 1 FROM ev WHERE item = '{b}')"
        for a, b in _EVIDENCE_RULES
    )
    return f"""WITH m AS (SELECT DISTINCT * FROM material_knowledge_metadata),
ce AS (SELECT name AS excerpt, 'excel' AS source_type, source_path, sheet_name, row_index FROM m WHERE name IS NOT NULL UNION ALL SELECT specification, 'excel', source_path, sheet_name, row_index FROM m WHERE specification IS NOT NULL
UNION ALL SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), 'pdf', source, NULL, NULL FROM documents WHERE text IS NOT NULL),
ev AS ({ev}), rl AS ({rows})
SELECT left_item, right_item, CASE WHEN one = 2 THEN 'same-excerpt' WHEN one = 1 OR two > 0 THEN 'same-row' ELSE 'project-level' END AS proximity, CASE WHEN one > 0 OR two > 0 THEN 'high' ELSE 'medium' END AS confidence FROM rl"""


def _issues_sql(*rules: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, CAST(x AS VARCHAR) AS entity_id, '{message}' AS message FROM ({body}) t(x)" for code, message, body in rules)


def _twice_sql(name: str, key: str) -> str:
    return f"SELECT {key} FROM {name} GROUP BY 1 HAVING count(*) > 1"


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"
_OBJ = f"""op AS (SELECT 'p' || p_partkey AS object_id, CASE WHEN p_partkey % 37 = 0 THEN 'MYSTERY' ELSE ({_TYPE_LIST})[p_partkey % {len(_TYPES)} + 1] END AS object_type, p_partkey AS k,
round(greatest(0.0, least(1.0, p_size / 50 * 0.30 + 0.9 * 0.30 + (p_partkey % 10) / 10 * 0.25 + 0.5 * 0.10 + 1.0 * 0.05 - 0.05)), 12) AS conf,
CASE WHEN p_partkey % 29 = 0 THEN [] WHEN p_partkey % 43 = 0 THEN [p_partkey, p_partkey + 1] ELSE [p_partkey] END AS prims FROM part),
ob AS (SELECT * FROM op UNION ALL SELECT * FROM op WHERE k % 53 = 0), ow AS (SELECT DISTINCT object_id, unnest(prims) AS prim FROM ob)"""
_RELS = """rl AS (SELECT 'r' || l_orderkey || '-' || l_linenumber AS id, l_orderkey AS o, l_partkey AS p, CASE WHEN l_returnflag = 'N' THEN 'CONNECTED_VIA' WHEN l_linestatus = 'F' THEN 'CONNECTED_TO' ELSE 'UNKNOWN' END AS kind,
CASE WHEN l_orderkey % 73 = 0 THEN 'o' || l_orderkey ELSE 'p' || l_partkey END AS target, l_returnflag = 'N' AND l_orderkey % 79 <> 0 AS via, (SELECT true FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 101 <> 0) AS held FROM lineitem),
rb AS (SELECT *, 0.6 + o % 40 / 100 AS cs, CASE WHEN o % 73 = 0 THEN 0.6 + o % 40 / 100 ELSE 0.6 + p % 40 / 100 END AS ct, least(0.6 + o % 40 / 100, 0.6 + p % 40 / 100) AS made FROM rl WHERE held),
rc AS (SELECT *, least(made, made * 0.4 + 0.6) + CASE WHEN o % 97 = 0 THEN 0.5 ELSE 0 END AS conf, least(least(cs, ct), least(cs, ct) * 0.4 + 0.6) AS again FROM rb)"""
_GRAPH = """pr AS (SELECT superseded_namespace || '/' || superseded_record_key AS a, superseding_namespace || '/' || superseding_record_key AS b, min(supersession_seq) AS q FROM decision_supersessions GROUP BY 1, 2 HAVING a <> b),
ed AS MATERIALIZED (SELECT 'c' || q AS edge_id, 'CONNECTED' AS edge_type, CASE WHEN q % 31 = 0 THEN greatest(a, b) ELSE least(a, b) END AS source, CASE WHEN q % 31 = 0 THEN least(a, b) ELSE greatest(a, b) END AS target, CASE WHEN q % 37 = 0 THEN 'FORWARD' ELSE 'UNDIRECTED' END AS direction FROM pr
UNION ALL SELECT 'h' || q, 'CONTAINS', b, a, 'FORWARD' FROM pr),
nd AS (SELECT DISTINCT decision_namespace || '/' || record_key AS id FROM decision_records),
lk AS (SELECT a AS x, b AS y FROM pr WHERE a IN (SELECT id FROM nd) AND b IN (SELECT id FROM nd)), lu AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
cc AS (SELECT id AS node, id AS other FROM nd UNION SELECT cc.node, lu.y FROM cc JOIN lu ON lu.x = cc.other),
cm AS MATERIALIZED (SELECT node AS node_id, min(other) AS component FROM cc GROUP BY 1),
no AS MATERIALIZED (SELECT node_id, (['PANEL', 'BREAKER', 'CABLE', 'LOAD', 'SPARE'])[length(node_id) % 5 + 1] AS node_type, component, CASE WHEN length(node_id) % 11 = 0 THEN 'x' || node_id ELSE component END AS component_id FROM cm),
wk AS (SELECT source AS s, target AS t FROM ed WHERE edge_type = 'CONTAINS' UNION SELECT wk.s, ed.target FROM wk JOIN ed ON ed.source = wk.t AND ed.edge_type = 'CONTAINS')"""
_HUB = "hb AS (SELECT source AS h FROM ed WHERE edge_type = 'CONTAINS' AND source IN (SELECT node_id FROM no) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_TOUCH = """lp AS (SELECT 'p' || x.l_partkey AS a, 'p' || y.l_partkey AS b, CASE WHEN x.l_orderkey % 2 = 0 THEN 'ENDPOINT_CONTACT' ELSE 'NEAR' END AS edge_type FROM lineitem x JOIN lineitem y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1),
oj AS (SELECT 'p' || p_partkey AS object_id, 0.5 + p_partkey % 50 / 100 AS confidence FROM part WHERE p_partkey % 13 <> 0),
ce AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, edge_type FROM lp WHERE a <> b AND a IN (SELECT object_id FROM oj) AND b IN (SELECT object_id FROM oj)),
cg AS (SELECT *, 'edge_' || substr(sha256(edge_type || '|' || a || '|' || b), 1, 16) AS edge_id FROM ce)"""
_HOLDS = "CAST(contains(lower(text), '{0}') AS INTEGER)"
_KNOWN = "kx AS (" + " UNION ALL ".join(
    f"SELECT '{i}' AS item, chunk_seq, {' + '.join(_HOLDS.format(k) for k in ks)} AS n_keywords FROM (SELECT DISTINCT chunk_seq, text FROM kec_chunks WHERE collection = 'company' AND text IS NOT NULL)"
    for i, ks in KEYWORDS.items()
) + "), kn AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n_keywords DESC, chunk_seq) AS rank FROM kx WHERE n_keywords > 0 AND item IN (SELECT item FROM it) QUALIFY rank <= 3)"
_NODE_CASE = "CASE object_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in inference.NODE_TYPES.items()) + " END"

SQL = {
    "drawing_list": f"""WITH {_LIST} SELECT page, CAST(block AS INTEGER) AS block, CAST(rowno AS INTEGER) AS row, drawing_no, title, category, complex, building, floor, scale_a1, scale_a3, confidence,
drawing_no || ' | ' || title || ' | A1:' || coalesce(scale_a1, 'NONE') || ' | A3:' || coalesce(scale_a3, 'NONE') AS raw_text FROM ok""",
    "drawing_list_warnings": f"""WITH {_LIST}, us AS (SELECT page, block, rowno FROM ok),
orp AS (SELECT page, block, slot, title, (SELECT count(*) FROM rk z WHERE z.page = r.page AND z.block = r.block AND numbered) AS nn FROM rk r WHERE titled AND NOT numbered)
SELECT DISTINCT page, 0 AS block, 0 AS row, 'drawing list table was not detected on this page' AS message FROM li WHERE page NOT IN (SELECT page FROM hp)
UNION ALL SELECT page, block, rowno, 'ambiguous drawing number row was omitted' FROM rk WHERE numbered AND drawing_no IS NULL
UNION ALL SELECT page, block, rowno, 'title is missing for drawing ' || drawing_no FROM rk WHERE drawing_no IS NOT NULL AND NOT titled
UNION ALL SELECT page, block, nn + row_number() OVER (PARTITION BY page, block ORDER BY slot), 'drawing number is missing for orphan title: ' || title FROM orp
UNION ALL SELECT page, block, rowno, 'category conflict for ' || drawing_no FROM ok WHERE several
UNION ALL SELECT page, block, rowno, 'duplicate drawing number ' || drawing_no FROM (SELECT *, row_number() OVER (PARTITION BY drawing_no ORDER BY page, block, rowno) AS n FROM ok) WHERE n = 2""",
    "page_parsing": f"""WITH {_PAGE_SQL} SELECT 'set' AS source, CAST(i AS INTEGER) AS page, CASE WHEN clear THEN drawing_no END AS drawing_no,
CASE WHEN clear THEN floor((0.76 + zone * 0.08 + CASE WHEN same THEN 0.15 ELSE least(0.08, sim * 0.08) END + CASE WHEN NOT same AND sim > 0 THEN 0.01 ELSE 0.0 END - CASE WHEN cnt > 1 THEN 0.02 ELSE 0.0 END) * 1000 + 0.5) / 1000 END::DOUBLE AS confidence,
CASE WHEN clear THEN 'MAPPED' ELSE 'AMBIGUOUS' END AS status FROM fi""",
    "request_selection": f"""WITH {_FOUND}, rq(request) AS (VALUES {', '.join(f"('{r}')" for r in REQUESTS)}), tp AS (SELECT request, max(score) AS top FROM fs GROUP BY 1),
td AS (SELECT request, count(*) AS n, min(listing_id) AS one FROM fs JOIN tp USING (request) WHERE score = top GROUP BY 1)
SELECT request, CASE WHEN n IS NULL THEN 'not-found' WHEN n = 1 THEN 'selected' ELSE 'ambiguous' END AS selection, coalesce(n, 0) AS n_tied, CASE WHEN n = 1 THEN one END AS listing_id FROM rq LEFT JOIN td USING (request)""",
    "review_prompt": f"""WITH {_FOUND}, tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, listing_id) AS n FROM fs WHERE request = '{REQUESTS[1]}' QUALIFY n <= 10)
SELECT concat_ws(chr(10), '# Request', '{REQUESTS[1]}', '# Drawing', 'E-0001', 'page text', '# Sources', '') || string_agg('- [' || listing_id || '] ' || trim(regexp_replace(name, '{_SPACES}+', ' ', 'g')), chr(10) ORDER BY n) AS prompt FROM tp""",
    "evidence_relations": _relations_sql(),
    "citations": """SELECT DISTINCT 'kec:' || source_path || ':p' || coalesce(CAST(page AS VARCHAR), '?') || ':' || coalesce(clause, 'Unknown clause') AS citation_id, 'kec' AS domain, coalesce(clause, 'Unknown clause') AS label, page AS place FROM kec_chunks WHERE collection = 'kec'
UNION SELECT 'company:' || chunk_id, 'company', document_id || ': ' || source_path, page FROM kec_chunks WHERE collection = 'company'
UNION SELECT 'material:' || listing_id, 'material', item_code || ': ' || coalesce(name, ''), row_index FROM material_knowledge_metadata""",
    "managed_paths": r"""WITH p AS (SELECT DISTINCT source_path AS s FROM kec_chunks WHERE source_path IS NOT NULL),
f AS (SELECT DISTINCT unnest([s, '/' || s, 'a/../' || s, replace(s, '/', '\'), s || '.txt', upper(s), '.pdf']) AS path FROM p),
g AS (SELECT path, string_split(path, '/') AS parts FROM f)
SELECT path, NOT contains(path, '\') AND NOT starts_with(path, '/') AND NOT list_has_any(parts, ['', '.', '..']) AND length(parts[-1]) > 4 AND ends_with(lower(parts[-1]), '.pdf') AS is_managed,
CASE WHEN contains(path, '/') THEN array_to_string(parts[:-2], '/') ELSE '.' END AS parent FROM g""",
    "index_metadata": """SELECT collection, 'local' AS provider, CASE WHEN collection = 'company' THEN 'model-next' ELSE 'model-' || max(len(embedding)) END AS model, CAST(max(len(embedding)) AS INTEGER) AS dimensions
FROM kec_chunks WHERE len(embedding) > 0 GROUP BY 1""",
    "write_compatibility": """WITH m AS (SELECT collection, max(len(embedding)) AS d FROM kec_chunks WHERE len(embedding) > 0 GROUP BY 1),
w(source_path, model, least, most) AS (VALUES ('new-a.pdf', 'model-64', 64, 64), ('new-b.pdf', 'other', 64, 64), ('new-c.pdf', 'model-64', 32, 64), ('new-d.pdf', 'model-64', 32, 32))
SELECT collection, source_path, CASE WHEN least <> most THEN 'VECTORS_MIXED' WHEN collection = 'site_specs' THEN 'METADATA_MISSING' WHEN model <> 'model-' || d THEN 'MODEL_DIFFERS' WHEN least <> d THEN 'DIMENSION_DIFFERS' ELSE 'OK' END AS status FROM m, w""",
    "append_bases": """WITH b AS (SELECT DISTINCT basis_seq, decision_record_key, recorded_at FROM decision_bases),
l AS (SELECT coalesce(max(basis_seq), 0) AS last FROM b WHERE recorded_at < TIMESTAMP '2024-01-01')
SELECT basis_seq, NULL AS was, decision_record_key FROM b WHERE recorded_at < TIMESTAMP '2024-01-01'
UNION ALL SELECT last + row_number() OVER (ORDER BY recorded_at, basis_seq), basis_seq, decision_record_key FROM b, l WHERE recorded_at >= TIMESTAMP '2024-01-01'""",
    "json_fields": """WITH r AS (SELECT DISTINCT decision_namespace, record_key, CASE WHEN length(record_key) % 9 = 0 THEN selection || '}' ELSE selection END AS s, context FROM decision_records)
SELECT DISTINCT decision_namespace, record_key, CASE WHEN json_valid(s) THEN '{' || array_to_string(list_transform(list_sort(json_keys(s)), lambda k: '"' || k || '":' || CAST(json_extract(s, '$."' || k || '"') AS VARCHAR)), ',') || '}' END AS canonical,
s IS NOT NULL AND NOT json_valid(s) AS is_broken, TRY_CAST(json_extract_string(CASE WHEN json_valid(context) THEN context END, '$.level') AS INTEGER) AS level FROM r""",
    "json_locators": """WITH m AS (SELECT DISTINCT snapshot_id, population_index, locators_json FROM kec_requirement_snapshot_members WHERE locators_json IS NOT NULL),
u AS (SELECT snapshot_id, population_index, unnest(range(0, CAST(json_array_length(locators_json) AS BIGINT))) AS k, locators_json AS j FROM m)
SELECT snapshot_id, population_index, CAST(k AS INTEGER) AS "at", CAST(json_extract(j, '$[' || k || '].page') AS INTEGER) AS page, CAST(json_extract(j, '$[' || k || '].start') AS INTEGER) AS start, CAST(json_extract(j, '$[' || k || '].end') AS INTEGER) AS "end" FROM u""",
    "object_issues": f"WITH {_OBJ}, pm AS (SELECT p_partkey AS prim FROM part WHERE p_partkey % 59 <> 0) "
    + _issues_sql(
        ("OBJECT_ID_DUPLICATE", "an object id occurs twice", _twice_sql("ob", "object_id")),
        ("OBJECT_TYPE_UNKNOWN", "an object has no known type", "SELECT object_id FROM ob WHERE object_type = 'MYSTERY'"),
        ("OBJECT_CONFIDENCE_RANGE", "a confidence lies outside 0 to 1", "SELECT object_id FROM ob WHERE k % 41 = 0 AND conf - 0.25 < 0"),
        ("OBJECT_CONFIDENCE_DIFFERS", "a confidence is not that of its scores", "SELECT object_id FROM ob WHERE k % 41 = 0"),
        ("OBJECT_BOX_NEGATIVE", "a box has a negative side", "SELECT object_id FROM ob WHERE k % 47 = 0"),
        ("OBJECT_WITHOUT_PRIMITIVE", "an object names no primitive", "SELECT object_id FROM ob WHERE k % 29 = 0"),
        ("PRIMITIVE_UNKNOWN", "an object names a primitive that does not exist", "SELECT DISTINCT object_id FROM ow WHERE prim NOT IN (SELECT prim FROM pm)"),
        ("PRIMITIVE_SHARED", "a primitive belongs to several objects", "SELECT prim FROM ow GROUP BY 1 HAVING count(*) > 1"),
    ),
    "construction_issues": _issues_sql(
        ("PRIMITIVE_DUPLICATE", "a primitive occurs twice", "SELECT p_partkey FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 17 = 0"),
        ("CLASSIFICATION_DUPLICATE", "a primitive is classified twice", "SELECT p_partkey FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 23 = 0"),
        ("CLASSIFICATION_MISSING", "a primitive is not classified", "SELECT p_partkey FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 29 = 0"),
        ("PRIMITIVE_MISSING", "a classification names no primitive", "SELECT p_partkey FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 = 0"),
    ),
    "identity_issues": """WITH c AS (SELECT source_path || '|' || page AS e, text, embedding, clause FROM kec_chunks WHERE source_path IS NOT NULL AND page IS NOT NULL),
d AS (SELECT DISTINCT e, 0 AS k FROM c WHERE text IS NOT NULL UNION ALL SELECT DISTINCT e, 1 FROM c WHERE embedding IS NOT NULL UNION ALL SELECT DISTINCT e, 2 FROM c WHERE clause IS NOT NULL)
SELECT e AS entity_id, count(*) AS n_documents FROM d GROUP BY 1 HAVING count(*) < 3""",
    "capture_issues": "WITH m AS (SELECT DISTINCT snapshot_id AS s, population_index AS i, requirement_id AS r FROM kec_requirement_snapshot_members) "
    + _issues_sql(
        ("OBSERVATION_MISSING", "a requirement was not observed", "SELECT s || '#' || i FROM m WHERE i % 7 = 3 OR i % 11 = 5"),
        ("OBSERVATION_UNKNOWN", "an observation has no requirement", "SELECT s || '#' || (i + 100000) FROM m WHERE i % 7 <> 3 AND i % 11 = 5"),
        ("OBSERVATION_DIFFERS", "an observation differs from its requirement", "SELECT s || '#' || i FROM m WHERE i % 7 <> 3 AND i % 11 <> 5 AND i % 5 = 2"),
    ),
    "relationship_issues": f"WITH {_RELS} "
    + _issues_sql(
        ("RELATIONSHIP_ID_DUPLICATE", "a relationship id occurs twice", _twice_sql("rl", "id")),
        ("RELATIONSHIP_TYPE_UNKNOWN", "a relationship has no known type", "SELECT id FROM rl WHERE kind = 'UNKNOWN'"),
        ("RELATIONSHIP_TO_ITSELF", "a relationship joins an object to itself", "SELECT id FROM rl WHERE o % 73 = 0"),
        ("RELATIONSHIP_END_UNKNOWN", "an end of a relationship does not exist", "SELECT DISTINCT id FROM rl WHERE held IS NULL"),
        ("RELATIONSHIP_VIA", "only a connection through an object names one", "SELECT id FROM rl WHERE kind = 'CONNECTED_VIA' AND NOT via"),
        ("RELATIONSHIP_CONFIDENCE_HIGH", "a relationship is surer than its ends", "SELECT id FROM rc WHERE conf > least(cs, ct)"),
        ("RELATIONSHIP_CONFIDENCE_DIFFERS", "a confidence is not that of its ends", "SELECT id FROM rc WHERE round(conf, 9) <> round(again, 9)"),
        ("RELATIONSHIP_WITHOUT_EVIDENCE", "a relationship has no evidence", "SELECT id FROM rl WHERE o % 83 = 0"),
        ("EVIDENCE_FOREIGN", "evidence belongs to neither end", "SELECT id FROM rb WHERE o % 83 <> 0 AND o % 89 = 0"),
    ),
    "graph_issues": f"WITH RECURSIVE {_GRAPH} "
    + _issues_sql(
        ("NODE_TYPE_UNKNOWN", "a node has no known type", "SELECT node_id FROM no WHERE node_type = 'SPARE'"),
        ("EDGE_DANGLING", "an end of an edge does not exist", "SELECT edge_id FROM ed WHERE source NOT IN (SELECT id FROM nd) OR target NOT IN (SELECT id FROM nd)"),
        ("EDGE_DIRECTION", "an edge has not the direction of its type", "SELECT edge_id FROM ed WHERE edge_type = 'CONNECTED' AND direction = 'FORWARD'"),
        ("EDGE_ORDER", "the ends of an undirected edge are not in order", "SELECT edge_id FROM ed WHERE direction = 'UNDIRECTED' AND source > target"),
        ("EDGE_REPEATED", "two edges say the same", "SELECT min(edge_id) FROM ed GROUP BY edge_type, source, target, direction HAVING count(*) > 1"),
        ("COMPONENT_SPLIT", "connected nodes are in different components", "SELECT component FROM no GROUP BY 1 HAVING count(DISTINCT component_id) > 1"),
        ("COMPONENT_JOINED", "a component holds nodes that are not connected", "SELECT component_id FROM no GROUP BY 1 HAVING count(DISTINCT component) > 1"),
        ("CONTAINMENT_CYCLE", "a node contains itself", "SELECT DISTINCT s FROM wk WHERE s = t"),
        ("NODE_ISOLATED", "a node has no edge", "SELECT node_id FROM no WHERE node_id NOT IN (SELECT source FROM ed) AND node_id NOT IN (SELECT target FROM ed)"),
    ),
    "graph_lookup": f"""WITH RECURSIVE {_GRAPH}, {_HUB}
SELECT 'FIND_NODES_BY_TYPE' AS kind, node_id FROM no WHERE node_type = 'PANEL' UNION ALL SELECT 'FIND_NODES_BY_DISPLAY_NAME', node_id FROM no, hb WHERE string_split(node_id, '/')[-1] = string_split(h, '/')[-1]
UNION ALL SELECT 'FIND_NODE', h FROM hb
UNION ALL SELECT 'FIND_CONNECTED_NEIGHBORS', x FROM (SELECT DISTINCT CASE WHEN source = h THEN target ELSE source END AS x FROM ed, hb WHERE edge_type = 'CONNECTED' AND (source = h OR target = h)) WHERE x IN (SELECT id FROM nd)
UNION ALL SELECT DISTINCT 'FIND_CONTAINED_NODES', target FROM ed, hb WHERE edge_type = 'CONTAINS' AND source = h AND target IN (SELECT id FROM nd)""",
    "construction_graph": f"WITH {_TOUCH} SELECT a, b, edge_type, edge_id FROM cg",
    "inferred_relationships": f"""WITH {_TOUCH}, q AS (SELECT a || ':' || b AS key, least(x.confidence, y.confidence) AS e, edge_id FROM cg JOIN oj x ON x.object_id = a JOIN oj y ON y.object_id = b WHERE edge_type = 'ENDPOINT_CONTACT')
SELECT key, 'CONNECTED_TO' AS relationship_type, round(least(e, e * 0.4 + 0.6), 6) AS confidence, 'graph-edge:' || edge_id AS evidence FROM q WHERE least(e, e * 0.4 + 0.6) >= 0.6""",
    "object_evidence": """WITH e AS (SELECT DISTINCT l_orderkey AS k, 'primitive:' || l_partkey AS v FROM lineitem UNION SELECT l_orderkey, 'label:' || l_returnflag FROM lineitem),
g AS (SELECT k, string_agg(v, ',' ORDER BY v) AS evidence FROM e GROUP BY 1) SELECT o_orderkey AS object_id, coalesce(evidence, '') AS evidence FROM orders LEFT JOIN g ON k = o_orderkey""",
    "object_types": f"""WITH {_OBJ}, t AS (SELECT object_type, count(*) AS n FROM op WHERE object_type NOT IN ('MYSTERY', 'SWITCH') GROUP BY 1), k AS (SELECT unnest({_TYPE_LIST}) AS object_type)
SELECT object_type, coalesce(n, 0) AS n, {_NODE_CASE} AS node_type FROM k LEFT JOIN t USING (object_type)""",
    "index_pipeline": """WITH d AS (SELECT DISTINCT doc_id, source AS s, text, CASE length(source) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS c FROM documents WHERE source IS NOT NULL),
o AS (SELECT c, s, count(*) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY 1, 2),
f AS (SELECT c, s, doc_id, unnest(list_transform(range(0, CAST(CASE WHEN length(text) > 1200 THEN ceil((length(text) - 1200) / 660.0) ELSE 0 END AS BIGINT) + 1), lambda i: substr(text, i * 660 + 1, 1200))) AS p FROM d WHERE doc_id % 3 = 0 AND text IS NOT NULL),
n AS (SELECT c, s, count(*) FILTER (trim(rtrim(p)) <> '') AS n FROM f GROUP BY 1, 2),
w AS (SELECT DISTINCT c, s FROM d WHERE doc_id % 3 = 0),
st AS (SELECT w.c, w.s, coalesce(n.n, 0) AS made, CASE WHEN coalesce(n.n, 0) = 0 THEN 'VECTORS_EMPTY' WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.c = w.c AND o.s <> w.s) THEN 'OK' WHEN w.c = 'c' THEN 'METADATA_MISSING' WHEN w.c = 'b' THEN 'DIMENSION_DIFFERS' ELSE 'OK' END AS status FROM w LEFT JOIN n USING (c, s)),
j AS (SELECT coalesce(o.c, st.c) AS c, coalesce(o.s, st.s) AS s, CASE WHEN st.status = 'OK' THEN 0 ELSE coalesce(o.n, 0) END AS n_old, CASE WHEN st.status = 'OK' THEN made ELSE 0 END AS n_new, st.status FROM o FULL OUTER JOIN st ON o.c = st.c AND o.s = st.s)
SELECT c AS collection, s AS source_path, n_old, n_new, status FROM j WHERE n_old + n_new > 0""",
    "object_assembly": f"""WITH c AS (SELECT label AS page, vec_id AS i, ({_TYPE_LIST})[vec_id % {len(_TYPES)} + 1] AS object_type, 0.5 + vec_id % 50 / 100 AS conf, list_sort(['p' || vec_id, 'p' || (vec_id + 10)]) AS ps, CASE WHEN vec_id % 3 = 0 THEN 't1,t2' ELSE '' END AS labels FROM embeddings),
p AS (SELECT label AS page, 'p' || vec_id AS id, round(CAST(embedding[1] AS DOUBLE) * 600, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 600, 3) AS y, abs(round(CAST(embedding[3] AS DOUBLE) * 60, 3)) AS w, abs(round(CAST(embedding[4] AS DOUBLE) * 60, 3)) AS h FROM embeddings),
b AS (SELECT c.page, i, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2 FROM c JOIN p ON p.page = c.page AND list_contains(ps, p.id) GROUP BY 1, 2)
SELECT c.page, 'object_' || substr(sha256(c.page || '|rule|' || array_to_string(ps, ',') || '|' || labels), 1, 16) AS object_id, object_type, CASE WHEN conf < 0.8 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END AS status,
array_to_string(ps, ',') AS primitives, labels, x, y, round(x2 - x, 6) AS width, round(y2 - y, 6) AS height FROM c JOIN b ON b.page = c.page AND b.i = c.i WHERE conf >= 0.6""",
    "object_statistics": """WITH c AS (SELECT label AS page, 0.5 + vec_id % 50 / 100 AS conf FROM embeddings)
SELECT page, count(*) AS n_candidates, count(*) FILTER (conf >= 0.8) AS n_accepted, count(*) FILTER (conf >= 0.6 AND conf < 0.8) AS n_review, count(*) FILTER (conf < 0.6) AS n_excluded FROM c GROUP BY 1""",
    "item_knowledge": f"WITH {items_sql()}, {_KNOWN} SELECT item, CAST(rank AS INTEGER) AS rank, chunk_seq, CAST(n_keywords AS INTEGER) AS n_keywords FROM kn",
    "project_review": f"""WITH {items_sql()}, {_KNOWN}, ev AS (SELECT item, count(*) AS n FROM it GROUP BY 1), ks AS (SELECT item, count(*) AS n FROM kn GROUP BY 1),
al(item) AS (VALUES {', '.join(f"('{i}')" for i in [*KEYWORDS, 'turbine'])})
SELECT al.item, coalesce(ev.n, 0) AS n_evidence, coalesce(ks.n, 0) AS n_sources, CASE WHEN ev.n IS NULL THEN 'not-mentioned' WHEN ks.n IS NULL THEN 'no-source' ELSE 'supported' END AS finding FROM al LEFT JOIN ev ON ev.item = al.item LEFT JOIN ks ON ks.item = al.item""",
    "hit_issues": "WITH c AS (SELECT DISTINCT chunk_seq AS i, text FROM kec_chunks), h AS (SELECT CASE WHEN i % 61 <> 0 THEN CASE WHEN i % 7 = 0 THEN i + 1 ELSE i END END AS k, i % 12 / 10 AS s, CASE WHEN i % 53 = 0 THEN '  ' ELSE text END AS t FROM c) "
    + _issues_sql(
        ("HIT_KEY_MISSING", "a hit has no key", "SELECT '?' FROM h WHERE k IS NULL"),
        ("HIT_KEY_DUPLICATE", "a key occurs twice", "SELECT k FROM h WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
        ("HIT_SCORE_RANGE", "a score lies outside 0 to 1", "SELECT coalesce(CAST(k AS VARCHAR), '?') FROM h WHERE s <= 0 OR s > 1"),
        ("HIT_TEXT_BLANK", "a hit has no text", "SELECT coalesce(CAST(k AS VARCHAR), '?') FROM h WHERE coalesce(trim(t), '') = ''"),
    ),
}
