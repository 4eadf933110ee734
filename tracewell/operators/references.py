"""References to records that do not exist, are deleted, or arrive later.

References are pre-aggregated per key and period, with combining before the shuffle, so afterwards a
key has at most one row per period. Keys that still carry more than 1/1024 of all references (at most
1,024 of them, a proven bound) are checked against their broadcast targets; the rest goes through a
shuffled outer join, and both orphan counts are united. Only groups that a target's own start or end
cuts in two return to their rows for an exact count.

Defined cases: a reference with a null in its key names nothing and is skipped; a null time can only
be judged for existence and belongs to the null period; repeated rows (equal id, key and time) count
once; a target with several rows stands from its first start to its last end, without end if one row
has none; a target with a null start has always stood; an empty side gives no rows or all missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut

HEAVY_SHARE = 1024


def references(df: DataFrame, row_id: list[str], key: list[str | Column], at: str) -> DataFrame:
    """id, k0.., at: the distinct references of one table."""
    cols = [(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(key)]
    refs = df.select(F.struct(*row_id).alias("id"), *cols, F.col(at).alias("at"))
    named = reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(key))])
    return refs.where(named).distinct()


def targets(df: DataFrame, key: list[str | Column], start: str, end: str) -> DataFrame:
    """k0.., since, until (null: stands)."""
    cols = [(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(key)]
    rows = df.select(*cols, F.col(start).alias("s"), F.col(end).alias("e"))
    ends = F.when(F.count("*") == F.count("e"), F.max("e"))
    starts = F.when(F.count("*") == F.count("s"), F.min("s"))
    return rows.groupBy(*[f"k{i}" for i in range(len(key))]).agg(starts.alias("since"), ends.alias("until"), F.lit(True).alias("stored"))


def _fault(at: Column) -> Column:
    return (
        F.when(F.col("stored").isNull(), "missing").when(at >= F.col("until"), "deleted").when(at < F.col("since"), "not_yet")
    )


def orphan_references(refs: DataFrame, tgts: DataFrame, period: str = "yyyy-MM", heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """k0.., period, references, missing, deleted, not_yet: one row for each key and period with an orphan."""
    key = [c for c in refs.columns if c.startswith("k")]
    refs = refs.withColumn("period", F.date_format("at", period))
    # Read by every branch below.
    groups = cut(refs.groupBy(*key, "period").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(cut(groups.groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") * heavy_share > total).select(*key)))
    known = F.broadcast(tgts.join(heavy, key, "left_semi"))
    checked = groups.join(heavy, key, "left_semi").join(known, key, "left").unionByName(
        groups.join(heavy, key, "left_anti").join(tgts, key, "left")
    )
    first, last = _fault(F.col("lo")), _fault(F.col("hi"))
    checked = checked.withColumn("first", first).withColumn("last", last)
    whole = F.col("first").eqNullSafe(F.col("last"))
    bad = cut(checked.where("first is not null or last is not null"))
    counted = lambda fault, of: F.sum(F.when(of == fault, F.col("n")).otherwise(0)).alias(fault)
    uniform = bad.where(whole).select(*key, "period", F.col("n").alias("references"), *[
        F.when(F.col("first") == f, F.col("n")).otherwise(F.lit(0)).alias(f) for f in ("missing", "deleted", "not_yet")
    ])
    split = bad.where(~whole).select(*key, "period", "since", "until", "stored")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*key, "period"]])
    rows = refs.alias("r").join(split.alias("s"), same).select("r.*", "s.since", "s.until", "s.stored", F.lit(1).alias("n"))
    rows = rows.withColumn("fault", _fault(F.col("at")))
    cutup = rows.groupBy(*key, "period").agg(F.sum("n").alias("references"), *[counted(f, F.col("fault")) for f in ("missing", "deleted", "not_yet")])
    return uniform.unionByName(cutup)
