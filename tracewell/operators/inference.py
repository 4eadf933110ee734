"""Objects and relationships of drawings: rules, evidence, construction graph, drawing lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.graph import connected_components, relationship_confidence
from tracewell.operators.spatial import nearest_in_band

# Node type of each object type in the circuit graph; unknown types are refused.
NODE_TYPES = {"PANEL": "PANEL", "BREAKER": "BREAKER", "CABLE": "CABLE", "WIRE": "CABLE", "LOAD": "LOAD", "SWITCH": "SWITCH", "OUTLET": "OUTLET", "LUMINAIRE": "LOAD", "TERMINAL": "TERMINAL"}

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def run_rules(rules: dict[str, Rule], frames: dict[str, DataFrame]) -> DataFrame:
    """The candidates of all rules, each with the id of its rule; rules share one result schema."""
    return reduce(DataFrame.unionByName, [rule(frames).withColumn("rule_id", F.lit(name)) for name, rule in sorted(rules.items())])


def construction_graph(objects: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, components): undirected edges with ordered ends, one a pair and type, between known objects."""
    ids = objects.select("object_id").distinct()
    rows = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "edge_type").where("a <> b").distinct()
    rows = rows.join(ids.withColumnRenamed("object_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("object_id", "b"), "b", "left_semi")
    rows = rows.withColumn("edge_id", F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws("|", "edge_type", "a", "b"), 256), 1, 16)))
    return rows, connected_components(rows.select(F.col("a").alias("src"), F.col("b").alias("dst")), ids)


def endpoint_contacts(frames: dict[str, DataFrame]) -> DataFrame:
    """The built-in rule: two objects that touch at an end are connected.

    frames: objects (object_id, confidence), edges (edge_id, edge_type, a, b). The pair's confidence comes
    from its weaker end.
    """
    contacts = frames["edges"].where("edge_type = 'ENDPOINT_CONTACT'")
    ends = frames["objects"].select("object_id", "confidence")
    left, right = ends.toDF("a", "_ca"), ends.toDF("b", "_cb")
    rows = contacts.join(left, "a").join(right, "b").withColumn("_end", F.least("_ca", "_cb"))
    key = F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b"))
    return rows.select(
        key.alias("key"), F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", F.lit("CONNECTED_TO"), key, "edge_id"), 256), 1, 16)).alias("candidate_id"),
        F.lit("CONNECTED_TO").alias("relationship_type"), F.lit(True).alias("hard_gate"), F.lit(100).alias("priority"), relationship_confidence(F.col("_end")).alias("confidence"),
        F.array(F.concat(F.lit("graph-edge:"), "edge_id")).alias("evidence"),
    )


def evidence_index(objects: DataFrame, columns: dict[str, str]) -> DataFrame:
    """object_id, evidence: namespaced evidence ids of each object, distinct and sorted (prefix by array column)."""
    parts = [objects.select("object_id", F.explode(c).alias("_e")).select("object_id", F.concat(F.lit(f"{p}:"), F.col("_e").cast("string")).alias("_e")) for p, c in columns.items()]
    found = reduce(DataFrame.unionByName, parts).groupBy("object_id").agg(F.array_sort(F.collect_set("_e")).alias("evidence"))
    return objects.select("object_id").distinct().join(found, "object_id", "left").select("object_id", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def typed_counts(rows: DataFrame, column: str, kinds: list[str]) -> DataFrame:
    """Counts by type, zero for types that do not occur."""
    dim = rows.sparkSession.createDataFrame([(k,) for k in kinds], f"{column} string")
    return dim.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def node_types(objects: DataFrame, column: str = "object_type") -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])
    known = F.try_element_at(table, F.col(column))
    return objects.withColumn("node_type", F.coalesce(known, F.raise_error(F.concat(F.lit("unknown object type: "), column))))


def header_anchors(headers: DataFrame) -> DataFrame:
    """page, block, x and y by kind, right_bound: headers of the four kinds zipped by their rank from the left.

    headers: page, kind (number, title, scale_a1, scale_a3), x, y. Blocks lacking a number or title are left out.
    """
    rank = F.row_number().over(Window.partitionBy("page", "kind").orderBy("x", F.desc("y")))
    rows = headers.withColumn("block", rank).groupBy("page", "block").pivot("kind", ["number", "title", "scale_a1", "scale_a3"]).agg(F.first("x").alias("x"), F.first("y").alias("y"))
    rows = rows.where("number_x is not null and title_x is not null")
    return rows.withColumn("right_bound", F.lead("number_x").over(Window.partitionBy("page").orderBy("number_x")))


def match_titles(numbers: DataFrame, titles: DataFrame, width: float = 6.0) -> DataFrame:
    """page, number_id, title_id, n_ties: the title row of the page nearest to each number row, null where two tie within 0.001.

    numbers: page, number_id, at; titles: page, title_id, at, both positions along one axis.
    """
    near = nearest_in_band(numbers, titles, "number_id", "at", "title_id", "at", width, by=["page"])
    found = numbers.select("page", "number_id").join(near, ["page", "number_id"], "left")
    return found.select("page", "number_id", F.when(F.col("n_ties") == 1, F.col("title_id")).alias("title_id"), F.coalesce("n_ties", F.lit(0)).alias("n_ties"))


def match_scales(rows: DataFrame, scales: DataFrame, dx: float = 6.0, dy: float = 15.0) -> DataFrame:
    """page, row_id, scale: the scale text of the page nearest to a row by horizontal, then vertical distance, in a box of the two reaches."""
    lhs = rows.select("page", "row_id", F.col("x").alias("_x"), F.col("y").alias("_y")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_x") / dx) + d for d in (-1, 0, 1)])))
    rhs = scales.select("page", "scale", "x", "y").withColumn("_b", F.floor(F.col("x") / dx))
    near = lhs.join(rhs, ["page", "_b"]).withColumn("_dx", F.abs(F.col("_x") - F.col("x"))).withColumn("_dy", F.abs(F.col("_y") - F.col("y"))).where((F.col("_dx") <= dx) & (F.col("_dy") <= dy))
    return near.groupBy("page", "row_id").agg(F.min_by("scale", F.struct("_dx", "_dy", "scale")).alias("scale"))


def drawing_confidence(base: float = 0.8):
    """Confidence of a drawing-list record from what was found with it, rounded to three digits."""
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.round(F.lit(base) + part(F.col("title").isNotNull(), 0.075) + part(F.col("category") != "기타", 0.075) + part(F.col("scale").isNotNull(), 0.05) - part(F.col("conflict"), 0.1), 3)


def affine_product(a, b):
    """Matrix product of two (a, b, c, d, e, f) arrays of columns: first b, then a."""
    return F.array(
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]
    )


def cubic_bounds(p0, p1, p2, p3):
    """(low, high) of a cubic curve along one axis: its ends and the inner roots of its derivative."""
    a, b, c = p3 - 3 * p2 + 3 * p1 - p0, 2 * (p2 - 2 * p1 + p0), p1 - p0
    at = lambda t: (1 - t) * (1 - t) * (1 - t) * p0 + 3 * (1 - t) * (1 - t) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t * p3
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    flat = F.abs(a) < 1e-12
    ts = [F.when(flat, F.try_divide(-c, b)).otherwise(F.try_divide(-b + root, 2 * a)), F.when(~flat, F.try_divide(-b - root, 2 * a))]
    real = flat | (b * b - 4 * a * c >= 0)
    inner = [F.when(real & (t > 0) & (t < 1), at(t)) for t in ts]
    return F.least(p0, p3, *inner), F.greatest(p0, p3, *inner)
