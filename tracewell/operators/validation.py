"""Issue rules over object, relationship and graph frames: one row for each offender of a rule.

Rules are filters, anti-joins and small aggregates; none needs the rows of a document in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.graph import OBJECT_WEIGHTS, connected_components, object_confidence, reference_cycles, relationship_confidence
from tracewell.operators.inference import NODE_TYPES
from tracewell.operators.review import issues

# Kinds of relationships and graph edges.
RELATIONSHIPS = ("CONNECTED_TO", "CONNECTED_VIA", "CONTAINS", "BELONGS_TO", "REFERENCES")
EDGES = {"CONNECTED": "UNDIRECTED", "CONTAINS": "FORWARD", "REFERENCES": "FORWARD"}


def _twice(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)


def object_issues(objects: DataFrame, primitives: DataFrame) -> DataFrame:
    """objects: object_id, object_type, confidence, the five scores, penalty, primitive_ids, width, height; primitives: primitive_id."""
    owned = objects.select("object_id", F.explode("primitive_ids").alias("primitive_id"))
    again = F.round(object_confidence({k: k for k in OBJECT_WEIGHTS}, "penalty"), 9)
    return issues([
        ("OBJECT_ID_DUPLICATE", "an object id occurs twice", _twice(objects, "object_id")),
        ("OBJECT_TYPE_UNKNOWN", "an object has no known type", objects.where(~F.coalesce(F.col("object_type").isin(*NODE_TYPES), F.lit(False))).select("object_id")),
        ("OBJECT_CONFIDENCE_RANGE", "a confidence lies outside 0 to 1", objects.where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).select("object_id")),
        ("OBJECT_CONFIDENCE_DIFFERS", "a confidence is not that of its scores", objects.where(F.round("confidence", 9) != again).select("object_id")),
        ("OBJECT_BOX_NEGATIVE", "a box has a negative side", objects.where("width < 0 or height < 0").select("object_id")),
        ("OBJECT_WITHOUT_PRIMITIVE", "an object names no primitive", objects.where(F.coalesce(F.size("primitive_ids"), F.lit(0)) < 1).select("object_id")),
        ("PRIMITIVE_UNKNOWN", "an object names a primitive that does not exist", owned.join(primitives.select("primitive_id"), "primitive_id", "left_anti").select("object_id").distinct()),
        ("PRIMITIVE_SHARED", "a primitive belongs to several objects", owned.distinct().groupBy("primitive_id").agg(F.count("*").alias("_n")).where("_n > 1").select("primitive_id")),
    ])


def construction_issues(primitives: DataFrame, classifications: DataFrame, key: str) -> DataFrame:
    """Rows of two documents that must meet one to one on ``key``."""
    return issues([
        ("PRIMITIVE_DUPLICATE", "a primitive occurs twice", _twice(primitives, key)),
        ("CLASSIFICATION_DUPLICATE", "a primitive is classified twice", _twice(classifications, key)),
        ("CLASSIFICATION_MISSING", "a primitive is not classified", primitives.join(classifications.select(key), key, "left_anti").select(key).distinct()),
        ("PRIMITIVE_MISSING", "a classification names no primitive", classifications.join(primitives.select(key), key, "left_anti").select(key).distinct()),
    ])


def identity_issues(documents: list[DataFrame], key: list[str]) -> DataFrame:
    """entity_id, n_documents: source pages, as ``key`` joined by |, that do not occur in all documents."""
    marked = [d.select(F.concat_ws("|", *key).alias("entity_id")).distinct().withColumn("_d", F.lit(i)) for i, d in enumerate(documents)]
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    return every.groupBy("entity_id").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") < len(documents))


def relationship_issues(relationships: DataFrame, objects: DataFrame) -> DataFrame:
    """relationships: relationship_id, relationship_type, source_id, target_id, via_id, confidence, evidence; objects: object_id, confidence, evidence."""
    ids = objects.select(F.col("object_id").alias("end")).distinct()
    ends = relationships.select("relationship_id", F.explode(F.array("source_id", "target_id", "via_id")).alias("end")).where("end is not null")
    side = lambda p: objects.select(F.col("object_id").alias(f"{p}_id"), F.col("confidence").alias(f"_{p}"), F.col("evidence").alias(f"_e{p}"))
    both = relationships.join(side("source"), "source_id").join(side("target"), "target_id")
    again = relationship_confidence(F.least("_source", "_target"))
    foreign = F.exists("evidence", lambda e: ~F.array_contains(F.concat("_esource", "_etarget"), e))
    return issues([
        ("RELATIONSHIP_ID_DUPLICATE", "a relationship id occurs twice", _twice(relationships, "relationship_id")),
        ("RELATIONSHIP_TYPE_UNKNOWN", "a relationship has no known type", relationships.where(~F.coalesce(F.col("relationship_type").isin(*RELATIONSHIPS), F.lit(False))).select("relationship_id")),
        ("RELATIONSHIP_TO_ITSELF", "a relationship joins an object to itself", relationships.where("source_id = target_id").select("relationship_id")),
        ("RELATIONSHIP_END_UNKNOWN", "an end of a relationship does not exist", ends.join(ids, "end", "left_anti").select("relationship_id").distinct()),
        ("RELATIONSHIP_VIA", "only a connection through an object names one", relationships.where("(relationship_type = 'CONNECTED_VIA') <> (via_id is not null)").select("relationship_id")),
        ("RELATIONSHIP_CONFIDENCE_HIGH", "a relationship is surer than its ends", both.where(F.col("confidence") > F.least("_source", "_target")).select("relationship_id")),
        ("RELATIONSHIP_CONFIDENCE_DIFFERS", "a confidence is not that of its ends", both.where(F.round("confidence", 9) != F.round(again, 9)).select("relationship_id")),
        ("RELATIONSHIP_WITHOUT_EVIDENCE", "a relationship has no evidence", relationships.where(F.coalesce(F.size("evidence"), F.lit(0)) < 1).select("relationship_id")),
        ("EVIDENCE_FOREIGN", "evidence belongs to neither end", both.where(foreign).select("relationship_id")),
    ])


def graph_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node_id, node_type, component_id; edges: edge_id, edge_type, source, target, direction."""
    ids = nodes.select(F.col("node_id").alias("end")).distinct()
    ends = edges.select("edge_id", F.explode(F.array("source", "target")).alias("end"))
    same = ["edge_type", "source", "target", "direction"]
    kind = F.create_map(*[F.lit(x) for kv in EDGES.items() for x in kv])
    linked = edges.where("edge_type = 'CONNECTED'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    real = connected_components(linked.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi"), nodes.select("node_id"))
    parts = nodes.select("node_id", "component_id").join(real.withColumnRenamed("node", "node_id"), "node_id")
    split = parts.groupBy("component").agg(F.count_distinct("component_id").alias("n")).where("n > 1").select("component")
    joined = parts.groupBy("component_id").agg(F.count_distinct("component").alias("n")).where("n > 1").select("component_id")
    contains = edges.where("edge_type = 'CONTAINS'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    touched = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    return issues([
        ("NODE_ID_DUPLICATE", "a node id occurs twice", _twice(nodes, "node_id")),
        ("NODE_TYPE_UNKNOWN", "a node has no known type", nodes.where(~F.coalesce(F.col("node_type").isin(*sorted(set(NODE_TYPES.values()))), F.lit(False))).select("node_id")),
        ("EDGE_ID_DUPLICATE", "an edge id occurs twice", _twice(edges, "edge_id")),
        ("EDGE_REPEATED", "two edges say the same", edges.groupBy(*same).agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id")).where("n > 1").select("edge_id")),
        ("EDGE_DANGLING", "an end of an edge does not exist", ends.join(ids, "end", "left_anti").select("edge_id").distinct()),
        ("EDGE_DIRECTION", "an edge has not the direction of its type", edges.where(~F.coalesce(F.try_element_at(kind, "edge_type") == F.col("direction"), F.lit(False))).select("edge_id")),
        ("EDGE_ORDER", "the ends of an undirected edge are not in order", edges.where("direction = 'UNDIRECTED' and source > target").select("edge_id")),
        ("COMPONENT_SPLIT", "connected nodes are in different components", split),
        ("COMPONENT_JOINED", "a component holds nodes that are not connected", joined),
        ("CONTAINMENT_CYCLE", "a node contains itself", reference_cycles(contains.where("src <> dst")).select("node").union(contains.where("src = dst").select("src")).distinct()),
        ("NODE_ISOLATED", "a node has no edge", nodes.select("node_id").distinct().join(touched, "node_id", "left_anti")),
    ])


def capture_issues(requirements: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of a snapshot against its requirements: both snapshot_id, position, value, in the same order."""
    key = ["snapshot_id", "position"]
    both = requirements.toDF(*key, "wanted").join(observations.toDF(*key, "got"), key, "full_outer")
    name = F.concat_ws("#", F.col("snapshot_id").cast("string"), F.col("position").cast("string"))
    return issues([
        ("OBSERVATION_MISSING", "a requirement was not observed", both.where("got is null").select(name)),
        ("OBSERVATION_UNKNOWN", "an observation has no requirement", both.where("wanted is null").select(name)),
        ("OBSERVATION_DIFFERS", "an observation differs from its requirement", both.where("wanted <> got").select(name)),
    ])
