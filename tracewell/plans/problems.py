"""Queries of the general data problems (1, 2 and 4) over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.hierarchy import descendants, resolve_hierarchy
from tracewell.operators.references import orphan_references, references, targets
from tracewell.operators.units import close_pairs, unit_prices
from tracewell.sources import table

CHILD = ["superseded_namespace", "superseded_record_key"]
PARENT = ["superseding_namespace", "superseding_record_key"]


def _flat(column: str, prefix: str) -> list:
    return [F.col(f"{column}.k0").alias(f"{prefix}namespace"), F.col(f"{column}.k1").alias(f"{prefix}record_key")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = resolve_hierarchy(table(spark, sf_dir, "decision_supersessions"), CHILD, PARENT)
    return tree.roots().select(
        F.col("node.k0").alias("record_namespace"), F.col("node.k1").alias("record_key"), *_flat("root", "root_")
    )


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root (names joined by ' > '), depth and root of every record in a tree."""
    tree = resolve_hierarchy(table(spark, sf_dir, "decision_supersessions"), CHILD, PARENT, with_paths=True).trees
    names = F.transform("path", lambda n: F.concat_ws("/", n["k0"], n["k1"]))
    return tree.select(
        F.col("node.k0").alias("record_namespace"), F.col("node.k1").alias("record_key"), "depth", F.concat_ws(" > ", names).alias("path")
    )


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair of the trees with its distance."""
    tree = resolve_hierarchy(table(spark, sf_dir, "decision_supersessions"), CHILD, PARENT, with_paths=True)
    return descendants(tree).select(*_flat("ancestor", "ancestor_"), *_flat("node", "descendant_"), "distance")


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on a cycle, with the smallest record of that cycle."""
    loops = resolve_hierarchy(table(spark, sf_dir, "decision_supersessions"), CHILD, PARENT).looped
    return loops.where("on_cycle").select(
        F.col("node.k0").alias("record_namespace"), F.col("node.k1").alias("record_key"), *_flat("root", "cycle_")
    )


def p2_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Won per base unit of every listing with a convertible price."""
    listings = table(spark, sf_dir, "material_knowledge_metadata").dropDuplicates(["listing_id"])
    return unit_prices(listings, table(spark, sf_dir, "exchange_rates"), ["listing_id", "catalog_id", "item_code"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_pairs(p2_prices(spark, sf_dir), "listing_id", ["catalog_id", "item_code", "base"], "won_per_base", 0.5)


def p4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing references by table, target key and month, with how many fail and why."""
    records = targets(table(spark, sf_dir, "decision_records"), ["decision_namespace", "record_key"], "recorded_at", "deleted_at")
    snapshots = targets(
        table(spark, sf_dir, "kec_requirement_snapshots"), [F.lit(""), F.col("snapshot_id").cast("string")], "stored_at", "deleted_at"
    )
    sides = {
        "decision_bases": (["basis_seq"], ["decision_namespace", "decision_record_key"], "recorded_at", records),
        "decision_supersessions": (["supersession_seq"], PARENT, "recorded_at", records),
        "kec_requirement_snapshot_members": (
            ["snapshot_id", "population_index"], [F.lit(""), F.col("snapshot_id").cast("string")], "stored_at", snapshots,
        ),
    }
    found = None
    for name, (row_id, key, at, known) in sides.items():
        refs = references(table(spark, sf_dir, name), row_id, key, at)
        rows = orphan_references(refs, known).select(
            F.lit(name).alias("ref_table"), F.col("k0").alias("ref_namespace"), F.col("k1").alias("ref_key"), F.col("period").alias("ref_month"),
            F.col("references").alias("n_references"), F.col("missing").alias("n_missing"), F.col("deleted").alias("n_deleted"), F.col("not_yet").alias("n_not_yet"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_orphans(spark, sf_dir).select("ref_table", "ref_namespace", "ref_key", "ref_month")


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_cycles, p2_found, p2_prices, p4_found, p4_orphans)}

# Chains and cycles by recursion; text order of VARCHAR in DuckDB is byte order.
_EDGES = """
e AS (SELECT DISTINCT superseded_namespace cn, superseded_record_key ck, superseding_namespace pn, superseding_record_key pk
      FROM decision_supersessions),
n AS (SELECT cn, ck FROM e UNION SELECT pn, pk FROM e)"""
_CYCLES = f"""{_EDGES},
walk AS (SELECT DISTINCT cn AS sn, ck AS sk, pn AS an, pk AS ak FROM e
         UNION SELECT w.sn, w.sk, e.pn, e.pk FROM walk w JOIN e ON e.cn = w.an AND e.ck = w.ak),
cyc AS (SELECT sn, sk FROM walk WHERE sn = an AND sk = ak),
low AS (SELECT w.sn, w.sk, min(struct_pack(a := w.an, b := w.ak)) AS m FROM walk w JOIN cyc c ON c.sn = w.an AND c.sk = w.ak GROUP BY 1, 2)"""
_TREE = f"""{_EDGES},
r AS (SELECT n.cn, n.ck FROM n LEFT JOIN e ON e.cn = n.cn AND e.ck = n.ck WHERE e.cn IS NULL),
t AS (SELECT cn, ck, 0 AS depth, cn || '/' || ck AS path FROM r
      UNION ALL SELECT e.cn, e.ck, t.depth + 1, t.path || ' > ' || e.cn || '/' || e.ck FROM t JOIN e ON e.pn = t.cn AND e.pk = t.ck)"""
_REFS = """
refs AS (SELECT DISTINCT 'decision_bases' t, CAST(basis_seq AS VARCHAR) id, decision_namespace ns, decision_record_key k, recorded_at a FROM decision_bases
         UNION ALL SELECT DISTINCT 'decision_supersessions', CAST(supersession_seq AS VARCHAR), superseding_namespace, superseding_record_key, recorded_at FROM decision_supersessions
         UNION ALL SELECT DISTINCT 'kec_requirement_snapshot_members', snapshot_id || '/' || population_index, '', CAST(snapshot_id AS VARCHAR), stored_at FROM kec_requirement_snapshot_members),
tg AS (SELECT DISTINCT 'd' s, decision_namespace ns, record_key k, recorded_at b, deleted_at d FROM decision_records
       UNION ALL SELECT DISTINCT 's', '', CAST(snapshot_id AS VARCHAR), stored_at, deleted_at FROM kec_requirement_snapshots),
j AS (SELECT refs.t, refs.ns, refs.k, strftime(refs.a, '%Y-%m') m,
             CASE WHEN tg.k IS NULL THEN 'missing' WHEN refs.a >= tg.d THEN 'deleted' WHEN refs.a < tg.b THEN 'not_yet' END f
      FROM refs LEFT JOIN tg ON tg.ns = refs.ns AND tg.k = refs.k AND tg.s = CASE WHEN refs.t = 'kec_requirement_snapshot_members' THEN 's' ELSE 'd' END)"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_CYCLES},
top AS (SELECT w.sn, w.sk, w.an, w.ak FROM walk w LEFT JOIN e ON e.cn = w.an AND e.ck = w.ak WHERE e.cn IS NULL)
SELECT n.cn AS record_namespace, n.ck AS record_key, coalesce(low.m.a, top.an, n.cn) AS root_namespace, coalesce(low.m.b, top.ak, n.ck) AS root_record_key
FROM n LEFT JOIN low ON low.sn = n.cn AND low.sk = n.ck LEFT JOIN top ON top.sn = n.cn AND top.sk = n.ck""",
    "p1_paths": f"WITH RECURSIVE {_TREE} SELECT cn AS record_namespace, ck AS record_key, depth, path FROM t",
    "p1_descendants": f"""WITH RECURSIVE {_TREE},
d AS (SELECT e.pn AS an, e.pk AS ak, e.cn, e.ck, 1 AS distance FROM e JOIN t ON t.cn = e.cn AND t.ck = e.ck
      UNION ALL SELECT d.an, d.ak, e.cn, e.ck, d.distance + 1 FROM d JOIN e ON e.pn = d.cn AND e.pk = d.ck)
SELECT an AS ancestor_namespace, ak AS ancestor_record_key, cn AS descendant_namespace, ck AS descendant_record_key, distance FROM d""",
    "p1_cycles": f"""WITH RECURSIVE {_CYCLES}
SELECT cyc.sn AS record_namespace, cyc.sk AS record_key, low.m.a AS cycle_namespace, low.m.b AS cycle_record_key
FROM cyc JOIN low ON low.sn = cyc.sn AND low.sk = cyc.sk""",
    "p4_found": f"WITH {_REFS} SELECT DISTINCT t AS ref_table, ns AS ref_namespace, k AS ref_key, m AS ref_month FROM j WHERE f IS NOT NULL",
    "p4_orphans": f"""WITH {_REFS} SELECT t AS ref_table, ns AS ref_namespace, k AS ref_key, m AS ref_month, count(*) AS n_references,
count(*) FILTER (f = 'missing') AS n_missing, count(*) FILTER (f = 'deleted') AS n_deleted, count(*) FILTER (f = 'not_yet') AS n_not_yet
FROM j GROUP BY 1, 2, 3, 4 HAVING count(f) > 0""",
}
