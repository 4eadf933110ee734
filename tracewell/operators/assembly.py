"""Objects of a drawing page from the candidates that were selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.graph import object_status


def assemble_objects(candidates: DataFrame, primitives: DataFrame, scope: list[str]) -> DataFrame:
    """scope.., object_id, object_type, status, primitive_ids, label_ids, x, y, width, height, confidence.

    candidates: scope.., candidate_id, rule_id, object_type, confidence, primary, supporting (arrays of primitive
    ids), labels; primitives: scope.., primitive_id, x, y, width, height. An object owns the primary and supporting primitives, its box is
    theirs together, and its id follows from its page, rule, primitives and labels. Candidates below 0.6
    or without a known primitive give no object; repeated candidates count once.
    """
    tidy = lambda *cs: F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in cs])))
    rows = candidates.where(object_status(F.col("confidence")) != "EXCLUDED").dropDuplicates([*scope, "candidate_id"])
    rows = rows.withColumn("primitive_ids", tidy("primary", "supporting")).withColumn("label_ids", tidy("labels"))
    owned = rows.select(*scope, "candidate_id", F.explode("primitive_ids").alias("primitive_id")).join(primitives, [*scope, "primitive_id"])
    box = owned.groupBy(*scope, "candidate_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_x2"), F.max(F.col("y") + F.col("height")).alias("_y2")
    )
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in scope], "rule_id", F.array_join("primitive_ids", ","), F.array_join("label_ids", ","))
    out = rows.join(box, [*scope, "candidate_id"])
    return out.select(
        *scope, F.concat(F.lit("object_"), F.substring(F.sha2(name, 256), 1, 16)).alias("object_id"), "object_type", object_status(F.col("confidence")).alias("status"), "primitive_ids", "label_ids", "x", "y",
        (F.col("_x2") - F.col("x")).alias("width"), (F.col("_y2") - F.col("y")).alias("height"), "confidence",
    )


def object_statistics(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """scope.., n_candidates, n_accepted, n_review, n_excluded."""
    status = object_status(F.col("confidence"))
    return candidates.groupBy(*scope).agg(
        F.count("*").alias("n_candidates"), F.count_if(status == "ACCEPTED").alias("n_accepted"), F.count_if(status == "REVIEW_REQUIRED").alias("n_review"), F.count_if(status == "EXCLUDED").alias("n_excluded")
    )
