"""Index pipeline: pages of sources become chunks with vectors that replace what a collection holds of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.store import replace_source, upsert, write_compatibility


def index_pages(
    existing: DataFrame, metadata: DataFrame, pages: DataFrame, pieces: Callable[[Column], Column], embed: Callable[[Column], Column], provider: str, model: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, metadata, outcome): each source that may be written replaces its chunks; the others stay as they are.

    existing: collection, source_path, page, chunk_index, text, embedding; metadata: collection, provider,
    model, dimensions; pages: collection, source_path, page, text. ``pieces`` cuts a text, ``embed`` gives its vector.
    outcome: collection, source_path, status, n_chunks. Null and blank pages give no chunk; a source without
    any chunk is refused as empty. Repeated pages count once.
    """
    cut_up = pages.where("text is not null").distinct().select("collection", "source_path", "page", F.posexplode(pieces(F.col("text"))).alias("chunk_index", "text"))
    rows = cut_up.where(F.trim("text") != "").withColumn("embedding", embed(F.col("text")))
    per = rows.groupBy("collection", "source_path").agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.count("*").alias("n_chunks"))
    wanted = pages.select("collection", "source_path").distinct().join(per, ["collection", "source_path"], "left")
    incoming = wanted.select("collection", "source_path", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "least", "most")
    status = write_compatibility(existing, metadata, incoming)
    outcome = wanted.join(status, ["collection", "source_path"]).select("collection", "source_path", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    written = outcome.where("status = 'OK'").select("collection", "source_path")
    fresh = rows.join(written, ["collection", "source_path"], "left_semi")
    held = replace_source(existing, fresh.select(existing.columns), ["collection", "source_path"])
    said = per.join(written, ["collection", "source_path"], "left_semi").groupBy("collection").agg(F.max("most").cast("int").alias("dimensions"))
    said = said.select("collection", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "dimensions")
    return held, upsert(metadata, said.select(metadata.columns), ["collection"]), outcome
