"""Boxes and bands: proximity joins over a uniform grid, topology, nearest matches with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH, CELL, EPSILON, KEEP = 8.0, 8.0, 0.01, 8
MOST_CELLS = 64


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def _spread(df: DataFrame, prefix: str, reach: float, cell: float) -> DataFrame:
    x, y, w, h = (F.col(f"{prefix}{c}") for c in "xywh")
    cx, cy = _cells(x - reach, x + w + reach, cell), _cells(y - reach, y + h + reach, cell)
    return df.withColumn("cx", F.explode(cx)).withColumn("cy", F.explode(cy))


def overlap_and_gap(a: str, b: str, size: str) -> tuple[Column, Column]:
    """Along one axis: overlap and gap of [a, a + size of a) and [b, b + size of b), without cancellation."""
    a0, an = F.col(f"p{a}"), F.col(f"p{size}")
    b0, bn = F.col(f"t{b}"), F.col(f"t{size}")
    first = a0 <= b0
    delta = F.abs(b0 - a0)
    leading, trailing = F.when(first, an).otherwise(bn), F.when(first, bn).otherwise(an)
    return F.greatest(F.lit(0.0), F.least(leading - delta, trailing)), F.greatest(F.lit(0.0), delta - leading)


def relate(pairs: DataFrame) -> DataFrame:
    """Adds gap distances and topology; boxes are px,py,pw,ph (primitive) and tx,ty,tw,th (text)."""
    ox, gx = overlap_and_gap("x", "x", "w")
    oy, gy = overlap_and_gap("y", "y", "h")
    e = EPSILON
    c = {f"{k}{a}": F.col(f"{k}{a}") for k in "pt" for a in "xywh"}
    equal = (F.abs(c["px"] - c["tx"]) <= e) & (F.abs(c["py"] - c["ty"]) <= e) & (F.abs(c["pw"] - c["tw"]) <= e) & (F.abs(c["ph"] - c["th"]) <= e)
    within = lambda i, o: (c[f"{i}x"] - c[f"{o}x"] >= -e) & (c[f"{i}y"] - c[f"{o}y"] >= -e) & (c[f"{i}x"] - c[f"{o}x"] + c[f"{i}w"] - c[f"{o}w"] <= e) & (c[f"{i}y"] - c[f"{o}y"] + c[f"{i}h"] - c[f"{o}h"] <= e)  # noqa: E731, E501
    rows = pairs.withColumn("ox", ox).withColumn("oy", oy).withColumn("distance", F.sqrt(gx * gx + gy * gy))
    topology = (
        F.when(equal, "overlaps").when(within("t", "p"), "contains").when(within("p", "t"), "inside")
        .when((F.col("ox") > e) & (F.col("oy") > e), "overlaps").when(F.col("distance") <= e, "touches").otherwise("disjoint")
    )
    return rows.withColumn("topology", topology)


def proximity_join(texts: DataFrame, primitives: DataFrame, page: list[str], reach: float = REACH, cell: float = CELL) -> DataFrame:
    """Pairs of one page whose boxes lie within ``reach``; equal to the plain theta join.

    Primitives that cover more than ``MOST_CELLS`` cells are joined with the texts of their page directly
    (hash join on the page); the others meet texts cell by cell, and each pair is kept in one cell only.
    """
    cells = (F.floor((F.col("px") + F.col("pw")) / cell) - F.floor(F.col("px") / cell) + 1) * (F.floor((F.col("py") + F.col("ph")) / cell) - F.floor(F.col("py") / cell) + 1)
    small, wide = primitives.where(cells <= MOST_CELLS), primitives.where(cells > MOST_CELLS)
    met = _spread(small, "p", 0.0, cell).join(_spread(texts, "t", reach, cell), [*page, "cx", "cy"])
    # The pair belongs to the first cell that both cover.
    own_x = F.greatest(F.floor(F.col("px") / cell), F.floor((F.col("tx") - reach) / cell))
    own_y = F.greatest(F.floor(F.col("py") / cell), F.floor((F.col("ty") - reach) / cell))
    met = met.where((F.col("cx") == own_x) & (F.col("cy") == own_y)).drop("cx", "cy")
    every = met.unionByName(wide.join(texts, page).select(met.columns))
    return relate(every).where(F.col("distance") <= reach)


def proximity_rank(pairs: DataFrame, entity: list[str], order: list[str], keep: int = KEEP) -> DataFrame:
    """All touching or overlapping pairs, and the ``keep`` nearest disjoint ones with rank and tags."""
    near = pairs.withColumn("rounded", F.round("distance", 3) + F.lit(0.0))
    apart = F.col("topology") == "disjoint"
    w = Window.partitionBy(*entity, apart).orderBy("rounded", *order)
    near = near.withColumn("rank", F.when(apart, F.row_number().over(w)))
    dx = F.abs(F.col("px") + F.col("pw") / 2 - F.col("tx") - F.col("tw") / 2)
    dy = F.abs(F.col("py") + F.col("ph") / 2 - F.col("ty") - F.col("th") / 2)
    tag = lambda name, when: F.when(when, F.lit(name))
    tags = F.array_compact(F.array(tag("adjacent", F.col("distance") <= 2), tag("aligned-x", dx <= 1), tag("aligned-y", dy <= 1), tag("nearest", F.col("rank") == 1)))
    return near.withColumn("tags", tags).where(~apart | (F.col("rank") <= keep))


def nearest_in_band(left: DataFrame, right: DataFrame, left_id: str, left_at: str, right_id: str, right_at: str, width: float, tie: float = 0.001, by: list[str] | None = None) -> DataFrame:
    """by.., left_id, right_id, distance, n_ties: the nearest right value within ``width`` and the same ``by``; ties are counted.

    Both sides fall into buckets as wide as the band; a left row meets its own and the two next to it.
    """
    by = by or []
    lhs = left.select(*by, left_id, F.col(left_at).alias("_l")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_l") / width) + d for d in (-1, 0, 1)])))
    rhs = right.select(*by, right_id, F.col(right_at).alias("_r")).withColumn("_b", F.floor(F.col("_r") / width))
    near = lhs.join(rhs, [*by, "_b"]).withColumn("distance", F.abs(F.col("_l") - F.col("_r"))).where(F.col("distance") <= width)
    w = Window.partitionBy(*by, left_id)
    near = near.withColumn("_m", F.min("distance").over(w)).where(F.col("distance") - F.col("_m") <= tie)
    out = near.groupBy(*by, left_id).agg(F.min(F.struct("distance", right_id)).alias("_x"), F.count("*").alias("n_ties"))
    return out.select(*by, left_id, F.col(f"_x.{right_id}").alias(right_id), F.col("_x.distance").alias("distance"), "n_ties")
