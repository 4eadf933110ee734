"""Quantities recorded in different units, brought to common units.

Conversions are edges of a graph, each an affine function ``target = scale * source + shift``. The
shortest composition from every unit to a canonical target is precomputed once (breadth first over a
vocabulary of fixed size), every closed walk is checked for consistency, and the result is a small table
that rows meet in an equi-join on source unit and canonical target.

Defined cases: null values or units, units without a way to the target, and non-finite results convert
to null; an inconsistent graph raises; unit names compare folded, lower case and without blanks.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.folding import fold_keys
from tracewell.session import cut

Edge = tuple[str, str, float, float]

# Exact definitions of units, as source, target, scale, shift.
PHYSICAL: list[Edge] = [
    ("km", "m", 1000.0, 0.0), ("cm", "m", 0.01, 0.0), ("mm", "cm", 0.1, 0.0), ("ft", "m", 0.3048, 0.0), ("yd", "ft", 3.0, 0.0),
    ("in", "cm", 2.54, 0.0), ("t", "kg", 1000.0, 0.0), ("g", "kg", 0.001, 0.0), ("lb", "kg", 0.45359237, 0.0), ("oz", "lb", 0.0625, 0.0),
    ("cm2", "m2", 0.0001, 0.0), ("sqft", "m2", 0.09290304, 0.0), ("ha", "m2", 10000.0, 0.0), ("pair", "piece", 2.0, 0.0),
    ("dozen", "piece", 12.0, 0.0), ("degC", "K", 1.0, 273.15), ("degF", "degC", 5.0 / 9.0, -160.0 / 9.0), ("MVA", "kVA", 1000.0, 0.0),
    ("kVA", "VA", 1000.0, 0.0), ("kV", "V", 1000.0, 0.0), ("kW", "W", 1000.0, 0.0), ("kA", "A", 1000.0, 0.0),
]
# Spellings of units after folding, lower case, blanks removed.
SPELLINGS = {
    "m": ["m", "meter", "metre", "meters", "미터"], "km": ["km", "킬로미터"], "cm": ["cm", "센티미터"], "mm": ["mm"], "ft": ["ft", "feet"],
    "yd": ["yd", "yard"], "in": ["in", "inch"], "kg": ["kg", "킬로그램"], "g": ["g", "그램"], "t": ["t", "ton", "톤"], "lb": ["lb", "lbs"],
    "oz": ["oz"], "m2": ["m2", "m²", "sqm"], "cm2": ["cm2", "cm²"], "sqft": ["sqft", "ft2", "ft²"], "ha": ["ha"],
    "piece": ["ea", "개", "pcs", "pc", "piece"], "pair": ["pair", "쌍"], "dozen": ["dozen", "다스"],
    "roll": ["roll", "롤", "r/l"], "box": ["box", "박스"], "bag": ["bag", "포"], "lump": ["식", "lot", "set"],
}
MONEY_SPELLINGS = {
    "KRW": ["krw", "원", "₩", "won", "원화"], "kKRW": ["천원", "1,000krw", "thousandwon"], "MKRW": ["백만원"], "USD": ["usd", "us$", "$", "달러"],
    "EUR": ["eur", "€", "유로"], "JPY": ["jpy", "엔", "엔화", "¥"], "CNY": ["cny", "위안", "위안화"],
}
BASES = ["m", "kg", "m2", "piece"]
MOST_CURRENCIES = 10_000


@dataclass(frozen=True)
class Affine:
    scale: float
    shift: float

    def then(self, other: Affine) -> Affine:
        return Affine(self.scale * other.scale, self.shift * other.scale + other.shift)

    def inverse(self) -> Affine:
        return Affine(1.0 / self.scale, -self.shift / self.scale)

    def near(self, other: Affine) -> bool:
        return math.isclose(self.scale, other.scale, rel_tol=1e-9) and math.isclose(self.shift, other.shift, rel_tol=1e-9, abs_tol=1e-9)


def compositions(edges: list[Edge], targets: list[str]) -> list[tuple[str, str, float, float]]:
    """(source, target, scale, shift) for every unit that reaches a target; raises when two ways differ."""
    graph: dict[str, list[tuple[str, Affine]]] = defaultdict(list)
    for a, b, scale, shift in edges:
        if not scale or not math.isfinite(scale) or not math.isfinite(shift):
            raise ValueError(f"conversion {a} to {b} cannot be inverted")
        graph[a].append((b, Affine(scale, shift)))
        graph[b].append((a, Affine(scale, shift).inverse()))
    out = []
    for target in targets:
        # to[u] turns a value in u into the target; each edge beyond the search tree closes a cycle.
        to, queue = {target: Affine(1.0, 0.0)}, deque([target])
        while queue:
            here = queue.popleft()
            for other, forth in graph[here]:
                way = forth.inverse().then(to[here])
                if other not in to:
                    to[other] = way
                    queue.append(other)
                elif not to[other].near(way):
                    raise ValueError(f"conversions of {other} to {target} contradict each other")
        out += [(u, target, w.scale, w.shift) for u, w in to.items()]
    return out


def conversion_table(spark: SparkSession, edges: list[Edge], targets: list[str], spellings: dict[str, list[str]]) -> DataFrame:
    """spelling, target, scale, shift: of the size of the vocabulary, whatever the data."""
    rows = [(s, t, a, b) for u, t, a, b in compositions(edges, targets) for s in spellings.get(u, [u])]
    return spark.createDataFrame(rows, "spelling string, target string, scale double, shift double")


def unit_key(col) -> F.Column:
    return F.regexp_replace(F.lower(col), r"\s+", "")


def convert(df: DataFrame, value: str, unit: str, target: str, edges: list[Edge] = PHYSICAL, spellings: dict[str, list[str]] | None = None, out: str = "converted") -> DataFrame:
    """``df`` with ``out``: ``value`` given in ``unit`` expressed in ``target``."""
    table = conversion_table(df.sparkSession, edges, [target], spellings or SPELLINGS)
    table = F.broadcast(table.select(F.col("spelling").alias("_s"), F.col("scale").alias("_a"), F.col("shift").alias("_b")))
    rows = df.withColumn("_u", unit_key(fold_keys(unit))).join(table, F.col("_u") == F.col("_s"), "left")
    got = F.col(value) * F.col("_a") + F.col("_b")
    finite = got.isNotNull() & ~F.isnan(got) & (F.abs(got) < float("inf"))
    return rows.withColumn(out, F.when(finite, got)).drop("_u", "_s", "_a", "_b")


# --- prices per unit ------------------------------------------------------------------------------

_NUM = r"(\d(?:[\d.,]*\d)?)"
_MONEY = r"(1,000 KRW|KRW|천원|백만원|원|₩|won|USD|US\$|\$|EUR|€|JPY|엔|CNY|위안)"
_UNIT = r"((?:\d+ ?)?(?:sq ft|sqm|square ft|cm²|m²|cm2|m2|meter|metre|미터|km|cm|ft|yd|킬로그램|kg|ton|톤|lb|dozen|pair|pcs|piece|EA|개|roll|R/L|롤|BOX|박스|포|LOT|set|식|M|m|t|g)(?![A-Za-z가-힣]))"
_I = "(?i)"
# A whole price in the text: amount, money and unit groups of each form.
_WHOLE = [
    (rf"{_I}@ ?{_MONEY} ?{_NUM} ?/ ?{_UNIT}", 2, 1, 3),
    (rf"{_I}price {_MONEY} ?{_NUM} per {_UNIT}", 2, 1, 3),
    (rf"{_I}단가 ?{_NUM} ?{_MONEY} ?/ ?{_UNIT}", 1, 2, 3),
]
# The unit a bare number is for.
_BASIS = [
    rf"{_I}\(per {_UNIT}\)", rf"{_I}rate for {_UNIT}", rf"{_I}단가 ?기준 ?{_UNIT}", rf"{_I}(?:price )?per {_UNIT}", rf"{_I}{_UNIT} ?(?:기준|묶음가)",
    rf"{_I}priced by the (metre|meter|kilogram|piece)", rf"{_I}(?<![가-힣A-Za-z0-9])(개|m²|m2|km|kg|m|톤|쌍)당",
]
# What one container holds, by container.
_HOLDS = {
    "roll": [rf"{_I}1 ?롤 ?= ?(\d+ ?(?:m²|m2|m))", rf"{_I}(\d+ ?(?:m²|m2|m)) ?/ ?R/L", rf"{_I}(\d+ ?(?:m²|m2|m)) per roll"],
    "box": [rf"{_I}(\d+ ?(?:EA|개|pcs)) ?/ ?BOX", rf"{_I}1 ?박스 ?(\d+ ?개)입"],
    "bag": [rf"{_I}(\d+ ?kg) ?/ ?포", rf"{_I}1 ?포 ?= ?(\d+ ?kg)"],
}
_STATED_MONEY = [
    (rf"{_I}prices? in {_MONEY}", 1), (rf"{_I}{_MONEY} 단가", 1), (r"\((엔화|원화|위안화|달러|유로)\)", 1), (r"(원화|엔화|위안화) 기준", 1),
    (r"단위: ?(천원|백만원|원)", 1), (rf"{_I}amount in (thousand won)", 1),
]


def _amount(number, money) -> F.Column:
    """A written amount: 1,234.50, or with a decimal comma 1.234,50; below ten euro also 4,324."""
    decimal_comma = number.rlike(r"^\d{1,3}(\.\d{3})*,\d{1,2}$") | (number.rlike(r"^\d,\d+$") & money.isin(*MONEY_SPELLINGS["EUR"]))
    plain = F.when(decimal_comma, F.translate(number, ",.", ".")).otherwise(F.regexp_replace(number, ",", ""))
    return plain.try_cast("double")


def _first(text, forms) -> F.Column:
    """The first form that matches; regexp_extract gives '' where there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p, g in forms])


def _spelling(spark: SparkSession, spellings: dict[str, list[str]], name: str) -> DataFrame:
    rows = [(s, u) for u, all_ in spellings.items() for s in all_]
    return F.broadcast(spark.createDataFrame(rows, f"{name}_s string, {name}_u string"))


def unit_prices(listings: DataFrame, rates: DataFrame, keep: list[str]) -> DataFrame:
    """keep.., base (m, kg, m2, piece), won_per_base.

    Reads unit_price, unit, currency and specification. A price in the text (amount, money, unit) counts
    where the column has none. A price without money stated is in won; lumps, units that cannot be
    reached, containers of unknown content and prices that are not positive give no row.
    """
    spark = listings.sparkSession
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = listings.select(*keep, F.col("unit_price").alias("p"), fold_keys("unit").alias("u"), fold_keys("currency").alias("c"), fold_keys("specification").alias("t"))
    whole = lambda g: _first(text, [(f[0], f[g]) for f in _WHOLE])
    rows = rows.withColumn("told", whole(1)).withColumn("has", F.col("p").isNotNull() & ~F.isnan("p"))
    rows = rows.where(F.col("has") | F.col("told").isNotNull())
    told_unit = F.when(~F.col("has"), whole(3))
    rows = rows.withColumn("unit_text", F.coalesce(told_unit, F.nullif("u", F.lit("")), _first(text, [(p, 1) for p in _BASIS])))
    told_money = F.when(~F.col("has"), whole(2))
    rows = rows.withColumn("money_text", F.coalesce(told_money, F.nullif("c", F.lit("")), _first(text, _STATED_MONEY), F.lit("krw")))
    rows = rows.withColumn("amount", F.when(F.col("has"), F.col("p")).otherwise(_amount(F.col("told"), unit_key(F.col("money_text")))))

    count = lambda c: F.coalesce(F.regexp_extract(c, r"^(\d+)", 1).try_cast("double"), F.lit(1.0))
    name = lambda c: unit_key(F.regexp_replace(c, r"^\d+\s*", ""))
    rows = rows.withColumn("qty", count(F.col("unit_text"))).withColumn("unit_s", name(F.col("unit_text")))
    rows = rows.join(_spelling(spark, SPELLINGS, "unit"), "unit_s", "left")
    held = F.coalesce(*[F.when(F.col("unit_u") == box, _first(text, [(p, 1) for p in forms])) for box, forms in _HOLDS.items()])
    boxed = F.col("unit_u").isin(*_HOLDS)
    rows = rows.withColumn("held", held)
    rows = rows.withColumn("size", F.when(boxed, F.col("qty") * count(F.col("held"))).otherwise(F.col("qty")))
    rows = rows.withColumn("spelling", F.when(boxed, name(F.col("held"))).otherwise(F.col("unit_s")))

    physical = F.broadcast(conversion_table(spark, PHYSICAL, BASES, SPELLINGS).select("spelling", F.col("target").alias("base"), "scale"))
    rows = rows.join(physical, "spelling").withColumn("money_s", unit_key(F.col("money_text")))
    money = F.broadcast(money_table(rates).withColumnRenamed("spelling", "money_s"))
    rows = rows.join(money, "money_s").withColumn("won_per_base", F.col("amount") * F.col("won") / (F.col("size") * F.col("scale")))
    return rows.where((F.col("won_per_base") > 0) & (F.col("won_per_base") < float("inf"))).select(*keep, "base", "won_per_base")


def money_table(rates: DataFrame) -> DataFrame:
    """spelling, won: one row per spelling of a currency, so bounded by the currencies quoted.

    The rates table is the one part of the graph that comes with the data; it has one row a currency and is
    refused beyond ``MOST_CURRENCIES``, never cut.
    """
    spark = rates.sparkSession
    rows = rates.select("currency_code", "won", "quoted_units").where("currency_code is not null").distinct().limit(MOST_CURRENCIES + 1).collect()
    if len(rows) > MOST_CURRENCIES:
        raise ValueError(f"more than {MOST_CURRENCIES} currencies")
    quoted = [(r[0], "KRW", r[1] / r[2], 0.0) for r in rows if r[0] != "KRW" and r[1] and r[2]]
    edges = [*quoted, ("kKRW", "KRW", 1000.0, 0.0), ("MKRW", "kKRW", 1000.0, 0.0)]
    return conversion_table(spark, edges, ["KRW"], MONEY_SPELLINGS).select("spelling", F.col("scale").alias("won"))


def close_pairs(rows: DataFrame, row_id: str, group: list[str], value: str, percent: float) -> DataFrame:
    """row_id_a < row_id_b of one group whose positive values differ by at most ``percent`` of the larger.

    Values fall into bins of their logarithm as wide as the tolerance; a row meets only its own and the
    next bin, so a group of any size is spread over its bins and only close rows ever meet.
    """
    width = -math.log(1 - percent / 100) * 1.000001
    # Both sides of the join read the rows, which may be dear to make.
    binned = cut(rows.select(*group, F.col(row_id).alias("id"), F.col(value).alias("v"), F.floor(F.log(value) / width).alias("bin")))
    left = binned.withColumn("bin", F.explode(F.array("bin", F.col("bin") + 1)))
    left = left.select(*group, "bin", F.col("id").alias("l"), F.col("v").alias("lv"))
    near = left.join(binned, [*group, "bin"])
    near = near.where((F.abs(F.col("lv") - F.col("v")) <= F.greatest("lv", "v") * percent / 100) & (F.col("l") != F.col("id")))
    return near.select(F.least("l", "id").alias(f"{row_id}_a"), F.greatest("l", "id").alias(f"{row_id}_b")).distinct()
