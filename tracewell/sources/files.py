"""File scans: project files by extension, and the sources of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["pdf", "xlsx", "xls", "dwg", "dxf"]


def project_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path (relative), name, extension, size, modified_at, in path order; hidden folders and node_modules are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{base}", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    rows = rows.where(F.col("extension").isin(*(extensions or EXTENSIONS)) & ~F.concat(F.lit("/"), "path").rlike(r"/(\.|node_modules/)"))
    return rows.orderBy(F.expr("path COLLATE UNICODE")).select("path", "name", "extension", "size", "modified_at")


def directory_scope(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, modified_at of the PDF files that lie in a folder itself, in name order; refused where there is none.

    Names end in lower-case ``.pdf``; folders below, links and hidden files are no sources.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", False).load(folder).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")).where(~F.col("name").startswith("."))
    if rows.isEmpty():
        raise ValueError(f"no PDF file in {folder}")
    return rows.orderBy("name")


def batch_sources(paths: DataFrame, column: str) -> DataFrame:
    """source_id, path in id order; a path given twice, or outside the root, is refused when the rows are read."""
    rows = paths.select(F.col(column).alias("path"))
    bad = F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|\\|^$") | ~F.col("path").endswith(".pdf")
    counted = rows.groupBy("path").agg(F.count("*").alias("n"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a relative PDF path: "), "path"))).when(F.col("n") > 1, F.raise_error(F.concat(F.lit("given twice: "), "path"))).otherwise(F.col("path"))
    return counted.select(F.concat(F.lit("kecsrc_"), F.sha2("path", 256)).alias("source_id"), checked.alias("path")).orderBy("source_id")


MOST_BYTES = 10 * 1024 * 1024


def json_documents(spark: SparkSession, path: str, schema: str, most: int = MOST_BYTES) -> DataFrame:
    """JSON documents of a fixed schema; one that does not fit, or of more than ``most`` bytes, fails the read."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    if large := sizes.where(F.col("length") > most).select("path").first():
        raise ValueError(f"{large[0]} has more than {most} bytes")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
