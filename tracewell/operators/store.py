"""Table stores on Parquet: upserts, replacement, optimistic pruning, append-only facts, keyset pages."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.session import cut


def _same(a: str, b: str, cols: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Incoming rows replace existing ones of their key; within a batch the last by ``order`` wins."""
    if order:
        w = Window.partitionBy(*key).orderBy(F.desc(order))
        incoming = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


def replace_source(existing: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of the scopes that come in are dropped, then the incoming rows added."""
    return existing.join(incoming.select(*scope).distinct(), scope, "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


def delete_source(existing: DataFrame, paths: DataFrame, column: str) -> DataFrame:
    return existing.join(paths.select(F.col(paths.columns[0]).alias(column)).distinct(), column, "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table after insertion, identity conflicts): equal payloads are no change, others a conflict."""
    first = incoming.dropDuplicates([*key, *payload])
    differ = reduce(lambda x, y: x | y, [~F.col(f"e.{c}").eqNullSafe(F.col(f"i.{c}")) for c in payload])
    conflicts = first.alias("i").join(existing.alias("e"), _same("i", "e", key)).where(differ).select("i.*")
    fresh = first.join(existing.select(*key), key, "left_anti")
    twice = fresh.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    conflicts = conflicts.select(first.columns).unionByName(fresh.join(twice, key, "left_semi").select(first.columns))
    return existing.unionByName(fresh.join(twice, key, "left_anti").select(existing.columns)), conflicts


def insert_edges(existing: DataFrame, incoming: DataFrame, src: list[str], dst: list[str]) -> DataFrame:
    """Edges not yet known are added; an edge from a node to itself is refused."""
    loop = reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in zip(src, dst)])
    fresh = incoming.where(~loop).dropDuplicates([*src, *dst]).join(existing.select(*src, *dst), [*src, *dst], "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def snapshot_conflicts(stored: DataFrame, incoming: DataFrame, snapshot: str, order: str, payload: list[str]) -> DataFrame:
    """Snapshots that are stored already with another ordered population. Compared by a digest, not by rows."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        member = F.xxhash64(order, *payload).cast("decimal(38,0)")
        return df.groupBy(snapshot).agg(F.struct(F.count("*"), F.sum(member), F.bit_xor(F.xxhash64(*payload, order))).alias(name))

    return digest(stored, "old").join(digest(incoming, "new"), snapshot).where("old <> new").select(snapshot)


def stale_sources(indexed: DataFrame, desired: DataFrame, column: str) -> DataFrame:
    return indexed.select(column).distinct().join(desired.select(column), column, "left_anti")


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def prune_sources(table: DataFrame, expected: DataFrame, stale: DataFrame, column: str) -> DataFrame:
    """The table without its stale sources; refused when the indexed sources are no longer the expected ones."""
    if not same_set(table.select(column).distinct(), expected.select(column).distinct()):
        raise RuntimeError("INDEX_CHANGED")
    return delete_source(table, stale.select(column), column)


def keyset_page(rows: DataFrame, key: list[str], after: tuple | None = None, limit: int = 100) -> DataFrame:
    """The next page in key order with has_more; at most 1,000 rows."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1,000 rows")
    if after is not None:
        rows = rows.where(F.struct(*key) > F.struct(*[F.lit(x).alias(k) for x, k in zip(after, key)]))
    page = rows.orderBy(*key).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*key))
    return page.withColumn("_n", n).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside the target and swap by rename, so readers see the old or the new table."""
    spark: SparkSession = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = f"{path}.new-{uuid4().hex}", f"{path}.old-{uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(fresh), hadoop(path))
    fs.delete(hadoop(old), True)


def write_json_document(df: DataFrame, folder: str, name: str, sha_column: str, page_column: str) -> DataFrame:
    """One JSON text per (source, page), named <name>-<sha12>-page-NNN.json; fields sorted by name."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    file = F.concat(F.lit(f"{folder}/{name}-"), F.substring(sha_column, 1, 12), F.lit("-page-"), F.lpad(F.col(page_column).cast("string"), 3, "0"), F.lit(".json"))
    return df.select(file.alias("file"), body.alias("body"))


ISSUES = ["EMPTY_COLLECTION", "MISSING_VECTORS", "ZERO_VECTORS", "MIXED_DIMENSIONS", "BLANK_TEXT", "MISSING_CLAUSE", "MISSING_PAGE", "LATE_ROWS"]


def index_diagnostics(chunks: DataFrame, collection: str, source: str, vector: str, text: str) -> DataFrame:
    """Per collection: chunks, sources, vector counts, dimensions, and status READY, DEGRADED or EMPTY."""
    norm = F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = chunks.select(collection, source, F.size(vector).alias("dim"), F.coalesce(norm == 0, F.lit(False)).alias("zero"), (F.trim(text) == "").alias("blank"), F.col(vector).isNull().alias("missing"))
    out = rows.groupBy(collection).agg(
        F.count("*").alias("n_chunks"), F.count_distinct(source).alias("n_sources"), F.count_if("missing").alias("n_missing"), F.count_if("zero").alias("n_zero"),
        F.count_distinct(F.when(~F.col("missing"), F.col("dim"))).alias("n_dimensions"), F.count_if("blank").alias("n_blank"),
    )
    bad = (F.col("n_missing") > 0) | (F.col("n_zero") > 0) | (F.col("n_dimensions") > 1) | (F.col("n_blank") > 0)
    return out.withColumn("status", F.when(F.col("n_chunks") == 0, "EMPTY").when(bad, "DEGRADED").otherwise("READY"))


def batch_outcome(sources: DataFrame, order: str, failed: str) -> DataFrame:
    """Fail fast: sources after the first failure were not attempted."""
    first = F.min(F.when(F.col(failed), F.col(order)))
    stop = sources.agg(first.alias("_stop"))
    at = F.col("_stop")
    status = F.when(at.isNull() | (F.col(order) < at), "SUCCEEDED").when(F.col(order) == at, "FAILED").otherwise("NOT_ATTEMPTED")
    return sources.join(F.broadcast(stop)).withColumn("status", status).drop("_stop")


def append_facts(existing: DataFrame, incoming: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """Facts are appended as they come, duplicates kept, numbered on from the last one in the given order.

    Numbers follow a range partitioning with one offset a partition, so no task sees all rows.
    """
    last = existing.agg(F.coalesce(F.max(seq), F.lit(0)).cast("long")).first()[0]
    return existing.unionByName(numbered(incoming.drop(seq), seq, order, last).select(existing.columns))


def numbered(rows: DataFrame, name: str, order: list[str], after: int = 0) -> DataFrame:
    """``rows`` with numbers from ``after`` + 1 on in the order given; rows equal in it come in any order."""
    spread = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # One row a partition.
    sizes, offset, starts = dict(spread.groupBy("_part").count().collect()), after, []
    for part in sorted(sizes):
        starts.append((part, offset))
        offset += sizes[part]
    table = spread.sparkSession.createDataFrame(starts or [(0, after)], "_part int, _start long")
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_n", n).join(F.broadcast(table), "_part").withColumn(name, F.col("_n") + F.col("_start")).drop("_n", "_start", "_part")


def write_compatibility(existing: DataFrame, metadata: DataFrame, incoming: DataFrame) -> DataFrame:
    """collection, status: OK, or why an incoming write must be refused.

    existing: collection, source_path; metadata: collection, provider, model, dimensions; incoming: collection,
    source_path, provider, model, least and most dimensions. Only a source other than the incoming one binds.
    """
    others = existing.select("collection", F.col("source_path").alias("_held")).distinct()
    foreign = incoming.join(others, "collection").where("_held <> source_path").select("collection", "source_path").distinct().withColumn("_foreign", F.lit(True))
    held = metadata.select("collection", F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("dimensions").alias("_d"))
    rows = incoming.join(foreign, ["collection", "source_path"], "left").join(held, "collection", "left")
    status = (
        F.when(F.coalesce("least", F.lit(0)) < 1, "VECTORS_EMPTY").when(F.col("least") != F.col("most"), "VECTORS_MIXED").when(F.col("_foreign").isNull(), "OK").when(F.col("_p").isNull(), "METADATA_MISSING")
        .when(F.col("_p") != F.col("provider"), "PROVIDER_DIFFERS").when(F.col("_m") != F.col("model"), "MODEL_DIFFERS").when(F.col("_d") != F.col("least"), "DIMENSION_DIFFERS").otherwise("OK")
    )
    return rows.select("collection", "source_path", status.alias("status"))


def canonical_json(text):
    """A JSON text with the names of every object sorted and without blanks; null where it is no JSON.

    The parser reads one value and ignores what follows, so the text is read as the only value of a list.
    """
    whole = F.try_parse_json(F.concat(F.lit('{"a":['), text, F.lit("]}")))
    only = F.try_variant_get(whole, "$.a[1]", "variant").isNull()
    return F.when(only, F.to_json(F.try_variant_get(whole, "$.a[0]", "variant")))
