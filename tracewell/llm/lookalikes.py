"""Visually identical text with different characters: one consistent form for whole tables.

For each field of a table the operator gives the stored value, its consistent form (compatibility
normalisation composed, look-alikes of other alphabets mapped, white space mapped, ignorable characters
removed), the comparison key (the same, fully case-folded, white space collapsed) and whether the stored
value is disguised. Each distinct value of an Arrow batch is computed once; values of ordinary
characters are recognised by one scan and pass through.

What looks different is content and stays: superscripts, circled characters, signs, composed accents,
Hangul, line ends, words wholly in another alphabet.

Defined cases: null values give no row; the empty text is its own form; repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.folding import fold, fold_key


def consistent_forms(df: DataFrame, table_name: str, key: str, fields: list[str], forms: bool = True) -> DataFrame:
    """table_name, field_name, row_key, disguised (and form, form_key)."""
    out = "struct<disguised:boolean,form:string,form_key:string>" if forms else "boolean"

    @F.pandas_udf(out)
    def run(values: pd.Series) -> pd.DataFrame:
        codes, uniques = pd.factorize(values)
        folded = [fold(u) for u in uniques]
        changed = [a != b for a, b in zip(folded, uniques)]
        if not forms:
            return pd.Series([c >= 0 and changed[c] for c in codes], dtype=bool)
        keys = [fold_key(f) for f in folded]
        pick = lambda have: [have[c] if c >= 0 else None for c in codes]
        return pd.DataFrame({"disguised": pick(changed), "form": pick(folded), "form_key": pick(keys)})

    def one(field: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull() & F.col(field).isNotNull())
        rows = rows.select(F.col(key).cast("string").alias("row_key"), F.col(field).alias("value"))
        found = rows.select("row_key", run("value").alias("r"))
        found = found.select("row_key", "r.*") if forms else found.select("row_key", F.col("r").alias("disguised"))
        return found.select(F.lit(table_name).alias("table_name"), F.lit(field).alias("field_name"), *found.columns)

    return reduce(DataFrame.unionByName, map(one, fields))
