"""All queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans import documents, drawings, problems, records, retrieval

QUERIES = {**problems.QUERIES, **retrieval.QUERIES, **records.QUERIES, **drawings.QUERIES, **documents.QUERIES}
SQL = {**problems.SQL, **retrieval.SQL, **records.SQL, **drawings.SQL, **documents.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["lexical_search"](spark, sf_dir)
