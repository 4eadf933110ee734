"""Filling fixed-capacity containers with items.

Sizes are token counts. An item above the capacity is divided: full containers first, its rest is packed
like any other item. Items are spread over blocks of bounded size; each block starts from best fit
decreasing and is then improved by swap-based local search on its underfull containers: single moves,
one-for-one and two-for-one exchanges that take from the emptiest container and fill the others, each
raising the sum of squared fills, until containers fall empty or the block needs no more than the whole
number of containers its total demands. What is left in underfull containers goes into the next, coarser
round of blocks, until one block is left or after ``ROUNDS`` rounds.

Defined cases: null sizes and sizes below one need no container and give no row; repeated items count
once; equal sizes are taken in the order of their ids; an empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut

CAPACITY, BLOCK_ITEMS, ROUNDS = 2048, 8192, 6
_UNDERFULL = 0.995


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of item positions."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        at = bisect_left(room, (int(sizes[i]), -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(int(i))
        else:
            free, b = capacity, len(bins)
            bins.append([int(i)])
        if free > sizes[i]:
            insort(room, (free - int(sizes[i]), b))
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty the least filled containers into the room of the others, as long as their number can fall."""
    home = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    fill = np.bincount(home, weights=sizes, minlength=len(bins)).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    open_ = fill > 0
    stuck = np.zeros(len(bins), bool)
    while open_.sum() > least and not stuck[open_].all():
        donors = np.flatnonzero(open_ & ~stuck)
        donor = donors[np.argmin(fill[donors])]
        if not _empty_one(sizes, home, fill, open_, donor, capacity):
            stuck[donor] = True
        else:
            open_[donor] = False
    order = {b: i for i, b in enumerate(np.unique(home))}
    out: list[list[int]] = [[] for _ in order]
    for i, b in enumerate(home):
        out[order[b]].append(i)
    return out


def _empty_one(sizes, home, fill, open_, donor, capacity) -> bool:
    """Shrink one container by moves and exchanges, each the largest gain at hand; true once it is empty."""
    while fill[donor]:
        mine = np.flatnonzero(home == donor)
        free = np.where(open_, capacity - fill, 0)
        free[donor] = 0
        # Move: the largest item that fits anywhere, into the tightest room.
        fits = mine[sizes[mine] <= free.max(initial=0)]
        if len(fits):
            x = fits[np.argmax(sizes[fits])]
            rooms = np.flatnonzero(free >= sizes[x])
            b = rooms[np.argmin(free[rooms])]
            fill[donor] -= sizes[x]
            fill[b] += sizes[x]
            home[x] = b
            continue
        others = np.flatnonzero((home != donor) & (free[home] > 0))
        if not len(others):
            return False
        totals, groups = _offers(sizes, mine)
        # For each other item the largest offer that its container still holds once the item is gone.
        at = np.searchsorted(totals, sizes[others] + free[home[others]], side="right") - 1
        gain = np.where(at >= 0, totals[np.maximum(at, 0)] - sizes[others], 0)
        place = int(np.argmax(gain))
        best, swap = int(gain[place]), None
        if best > 0:
            swap = groups[at[place]], others[place]
        # An exchange pays while the other container ends up fuller than the donor was.
        if swap is None or fill[home[swap[1]]] + best <= fill[donor]:
            return False
        group, y = swap
        b = home[y]
        home[list(group)] = b
        home[y] = donor
        fill[b] += best
        fill[donor] -= best
    return True


def _offers(sizes: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(totals in rising order, items) of every different total that one or two of a container's items make.

    Items of one size are alike, and a container holds under 2 * sqrt(capacity) different sizes, so all pairs are few.
    """
    by: dict[int, list[int]] = {}
    for i in mine:
        by.setdefault(int(sizes[i]), []).append(int(i))
    made: dict[int, tuple] = {s: (items[0],) for s, items in by.items()}
    kinds = sorted(by)
    for n, a in enumerate(kinds):
        for b in kinds[n:]:
            if a != b or len(by[a]) > 1:
                made.setdefault(a + b, (by[a][0], by[b][0] if a != b else by[a][1]))
    totals = sorted(made)
    return np.array(totals), [made[t] for t in totals]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(sizes, best_fit_decreasing(sizes, capacity), capacity) if len(sizes) else []


def fill_containers(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, block: int = BLOCK_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """container_id, key, part, start, size: a part for each container an item lies in."""
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("item"), F.col(size).cast("long").alias("size")).where(F.col("item").isNotNull() & (F.col("size") > 0)).dropDuplicates(["item"])
    rows = cut(rows)
    large = rows.where(F.col("size") > capacity).select("item", F.floor(F.col("size") / capacity).alias("whole"))
    full = large.select("item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part"))
    full = full.select(
        F.concat(F.lit("w."), F.col("item").cast("string"), F.lit("."), F.col("part").cast("string")).alias("container_id"), "item",
        F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"),
    )
    whole = F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0)
    left = rows.select("item", whole.cast("int").alias("part"), (whole * capacity).alias("start"), (F.col("size") - whole * capacity).alias("size")).where("size > 0")
    done, waiting = [full], left
    schema = f"container_id string, item {kind}, part int, start long, size long, fill long"

    def packer(stage: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["item", "part"]).reset_index(drop=True)
            sizes = pdf["size"].to_numpy()
            number, fill = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for n, members in enumerate(pack(sizes, capacity)):
                number[members], fill[members] = n, sizes[members].sum()
            names = f"{stage}.{pdf['block'].iloc[0]}." + pd.Series(number).astype(str)
            return pd.DataFrame({"container_id": names, "item": pdf["item"], "part": pdf["part"], "start": pdf["start"], "size": pdf["size"], "fill": fill})

        return run

    n = waiting.count()
    for stage in range(rounds):
        if not n:
            break
        blocks = -(-n // block)
        spread = waiting.withColumn("block", F.pmod(F.xxhash64("item", F.lit(stage)), F.lit(blocks)))
        packed = cut(spread.repartition(blocks, "block").groupBy("block").applyInPandas(packer(stage), schema))
        last = blocks == 1 or stage == rounds - 1
        keep = F.lit(True) if last else F.col("fill") >= capacity * _UNDERFULL
        done.append(packed.where(keep).drop("fill"))
        if last:
            break
        waiting = packed.where(~keep).select("item", "part", "start", "size")
        n = waiting.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d.select(out.columns))
    return out.withColumnRenamed("item", key)
