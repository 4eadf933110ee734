"""Most similar vectors for every vector, by a hierarchical k-means tree.

The upper levels of the tree are fitted on the driver from a bounded, documented sample: one row in
``SAMPLE_SHARE``, at least ``LEAST_SAMPLE`` and at most ``MOST_SAMPLE``, all groups together. Every row is then
stored in its nearest branch. A branch that turns out larger than two leaves gets its lower levels where it
lies, fitted on its own rows, so leaves stay near ``LEAF`` rows at any size of the table.

Branches whose centres lie side by side form a region of at most ``REGION_VALUES`` vector values. A row is
moved once to each region it visits, with the list of its branches there, and its neighbours come back once
from each region: which rows are compared depends on the branches alone, what is moved on the regions.

A query walks the tree best bin first: a priority queue holds the centres met so far, the nearest is
taken, inner nodes push their children, branches are visited. It goes on to further branches while their
centres are within a gap of its best one. How many are looked at and how wide the gap is, is calibrated for
each group: the exact neighbours of sampled probes are found over all rows of the group, and visits widen
until the share of those neighbours that lie in the visited branches reaches the wanted recall. The lower
levels are calibrated the same way on probes of their branch.

Inside a leaf all rows are compared in float32, and all that rounding leaves undecided again in double
precision. Equal vectors of a branch are compared once and stand for their k + 1 smallest ids. Vectors seen
``COPIES`` times in the sample are answered from their smallest ids and stored with those only, so that
copies of one vector never fill a branch; which vectors these are changes the work and not the result.

Groups without a tree (at most 1/4096 of all rows, or a leaf) are one branch each. Vectors are compared
within their length. Defined cases: null, empty, all-zero, non-finite vectors and null groups or ids take
no part; repeated ids count once; equal similarities go to the smaller id; a group with fewer than k
others gives fewer rows; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut, shuffle_width

LEAST_SAMPLE, MOST_SAMPLE, SAMPLE_SHARE = 1 << 15, 1 << 20, 256
LEAF, BRANCH, COPIES = 4096, 128, 16
PROBES, MOST_PROBES, LEAF_PROBES, GROUPS, WAVE = 2048, 8192, 64, 4096, 65_536
REGION_VALUES = 1 << 21
RECALL = 0.995


@dataclass
class Tree:
    """Centres of inner nodes and leaves; ``children`` holds row indices of nodes, ``leaf`` a leaf number or -1.

    ``rows`` is how many rows each leaf stands for, ``region`` the region it lies in. A query looks at ``visits`` leaves and takes those whose centre is at most ``gap`` less similar than its best.
    """

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    rows: np.ndarray
    visits: int = 1
    gap: float = 0.0
    region: np.ndarray | None = None

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        size = np.linalg.norm(total, axis=1)
        live = size > 1e-9
        total[live] /= size[live, None]
        total[~live] = x[rng.choice(len(x), int((~live).sum()))]
        centres = total.astype(np.float32)
    return np.argmax(x @ centres.T, axis=1)


def fit_tree(sample: np.ndarray, rows: int, leaf: int = LEAF, branch: int = BRANCH, seed: int = 7) -> Tree:
    """Split until a node stands for at most ``leaf`` of the ``rows`` indexed, or for under 32 of the sample."""
    rng, share = np.random.default_rng(seed), max(1.0, rows / max(1, len(sample)))
    sample = _unit(sample).astype(np.float32)
    centres, children, leaves, held = [], [], [], []
    count = 0

    def grow(x: np.ndarray) -> int:
        nonlocal count
        me = len(centres)
        mean = x.mean(axis=0)
        size = float(np.linalg.norm(mean))
        centres.append(mean / size if size > 1e-9 else x[0])
        children.append(np.empty(0, np.int64))
        leaves.append(-1)
        parts: list[np.ndarray] = []
        if len(x) * share > leaf and len(x) >= 32:
            k = int(min(branch, max(2, np.ceil(len(x) * share / leaf)), len(x) // 16))
            at = _kmeans(x, k, rng)
            parts = [x[at == i] for i in range(k) if (at == i).any()]
        if len(parts) < 2:
            leaves[me] = count
            held.append(len(x) * share)
            count += 1
        else:
            children[me] = np.array([grow(p) for p in parts])
        return me

    grow(sample)
    return Tree(np.array(centres, np.float32), children, np.array(leaves), np.array(held))


def regions(tree: Tree, most: float, branch: int = BRANCH, seed: int = 5) -> np.ndarray:
    """Region of each leaf: neighbouring leaves that stand for at most ``most`` rows together, or a single one."""
    rng = np.random.default_rng(seed)
    centres = np.empty((tree.leaves, tree.centres.shape[1]), np.float32)
    centres[tree.leaf[tree.leaf >= 0]] = tree.centres[tree.leaf >= 0]
    out, count, left = np.zeros(tree.leaves, np.int64), 0, [np.arange(tree.leaves)]
    while left:
        mine = left.pop()
        rows = tree.rows[mine].sum()
        if rows <= most or len(mine) == 1:
            out[mine] = count
            count += 1
            continue
        k = int(min(branch, len(mine), max(2, np.ceil(rows / most))))
        at = _kmeans(centres[mine], k, rng)
        parts = [mine[at == i] for i in range(k) if (at == i).any()]
        left += parts if len(parts) > 1 else np.array_split(mine, 2)
    return out


def visit(tree: Tree, x: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers in best-bin-first order, one row a query, padded with -1, and the similarity of their centres.

    The queues of a whole batch advance together: each step takes every query's nearest open node.
    """
    n, visits = len(x), min(visits, tree.leaves)
    out, sims = np.full((n, visits), -1, np.int64), np.full((n, visits), -np.inf, np.float32)
    taken = np.zeros(n, np.int64)
    node = np.zeros((n, 1), np.int64)
    near = np.full((n, 1), 2.0, np.float32)
    live = np.arange(n)
    while len(live):
        best = np.argmax(near[live], axis=1)
        here, sim = node[live, best], near[live, best]
        near[live, best] = -np.inf
        leaf = tree.leaf[here]
        done = leaf >= 0
        at = live[done]
        out[at, taken[at]], sims[at, taken[at]] = leaf[done], sim[done]
        taken[at] += 1
        inner, where = live[~done], here[~done]
        if len(inner):
            width = max(len(tree.children[w]) for w in np.unique(where))
            more_near = np.full((n, width), -np.inf, np.float32)
            more_node = np.zeros((n, width), np.int64)
            order = np.argsort(where, kind="stable")
            inner, where = inner[order], where[order]
            edges = np.flatnonzero(np.diff(where, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(where)]):
                kids = tree.children[where[a]]
                more_near[inner[a:b], : len(kids)] = x[inner[a:b]] @ tree.centres[kids].T
                more_node[inner[a:b], : len(kids)] = kids
            near, node = np.hstack([near, more_near]), np.hstack([node, more_node])
        live = live[(taken[live] < visits) & (near[live].max(axis=1) > -np.inf)]
    return out, sims


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf): each query's own leaf, where it would be stored, and the others it visits."""
    leaf, sims = visit(tree, x, tree.visits)
    go = (leaf >= 0) & (sims >= sims.max(axis=1, keepdims=True) - tree.gap)
    go[:, 0] = True
    query, at = np.nonzero(go)
    return query, leaf[query, at]


def homes(tree: Tree, x: np.ndarray) -> np.ndarray:
    return visit(tree, x, 1)[0][:, 0]


def calibrate(tree: Tree, probes: np.ndarray, truth: list[np.ndarray], recall: float) -> float:
    """Set visits and gap to the least that hold the wanted share of ``truth``, the leaves of each probe's neighbours.

    Visits are first widened to lose at most half of what may be lost, then the gap takes the other half.
    """
    if tree.leaves < 2 or not sum(map(len, truth)):
        tree.visits, tree.gap = min(tree.visits, tree.leaves), 4.0
        return 1.0
    whom = np.repeat(np.arange(len(probes)), [len(t) for t in truth])
    want, wide = np.concatenate(truth), 16
    while True:
        leaf, sims = visit(tree, probes, wide)
        hit = leaf[whom] == want[:, None]
        place = np.where(hit.any(axis=1), hit.argmax(axis=1), 1 << 30)
        if wide >= tree.leaves or (place < wide).mean() >= 1 - (1 - recall) / 2:
            break
        wide *= 2
    ordered = np.sort(place)
    last = min(len(ordered) - 1, int(np.ceil((1 - (1 - recall) / 2) * len(ordered))) - 1)
    tree.visits = int(min(ordered[last] + 1, tree.leaves))
    short = np.where(place < tree.visits, 0.0, np.inf)
    inside = place < tree.visits
    short[inside] = (sims[:, : tree.visits].max(axis=1)[whom] - sims[whom, np.minimum(place, leaf.shape[1] - 1)])[inside]
    gaps = np.sort(short)
    # A hair above, so that the neighbour that sets the gap is inside it.
    tree.gap = float(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))) - 1)]) + 1e-6
    return float((short <= tree.gap).mean())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """float32 rows of a list column whose lists all have ``dim`` values."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _usable(df: DataFrame, row_id: str, group: str, vector: str) -> DataFrame:
    """grp (the length of the vector before the group, as only equal lengths compare), id, vec."""
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.where(F.col("g").isNotNull() & F.col("id").isNotNull() & (F.size("vec") > 0))
    return rows.where((norm > 0) & (norm < float("inf"))).select(F.concat_ws(":", F.size("vec").cast("string"), "g").alias("grp"), "id", "vec")


def _dim(grp: str) -> int:
    return int(grp.split(":", 1)[0])


def _by_group(batch: pa.RecordBatch):
    """(group, ids, vectors) of each group in a batch of grp, id, vec."""
    codes = batch.column("grp").dictionary_encode()
    at, ids = codes.indices.to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
    for n, grp in enumerate(codes.dictionary.to_pylist()):
        mine = np.flatnonzero(at == n)
        yield grp, ids[mine], _matrix(batch.column("vec").take(pa.array(mine)), _dim(grp))


def _packed(rows: DataFrame) -> list:
    """grp, ids, vectors of a bounded set of rows, brought to the driver as bytes."""

    def pack(batches):
        for batch in batches:
            for grp, ids, x in _by_group(batch):
                yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["grp", "ids", "vecs"])

    got: dict[str, list] = {}
    for grp, ids, vecs in rows.mapInArrow(pack, "grp string, ids binary, vecs binary").collect():
        got.setdefault(grp, []).append((np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.float32).reshape(-1, _dim(grp))))
    out = []
    for grp in sorted(got):
        ids, x = np.concatenate([i for i, _ in got[grp]]), np.concatenate([v for _, v in got[grp]])
        ids, first = np.unique(ids, return_index=True)
        out.append((grp, ids, x[first]))
    return out


def exact_neighbours(rows: DataFrame, probes: list, k: int) -> DataFrame:
    """grp, q, near (sim, id; best first): brute force of a bounded set of probes over all rows.

    rows: grp, id, vec. Each task keeps k rows a probe, so what is shuffled is of the size of the probes.
    """
    held = rows.sparkSession.sparkContext.broadcast({g: (ids, x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)) for g, ids, x in probes})

    def nearest(batches):
        rounded = {g: unit.astype(np.float32) for g, (_, unit) in held.value.items()}
        best = {g: [np.full((len(i), k), 3.0), np.full((len(i), k), 1 << 62, np.int64)] for g, (i, _) in held.value.items()}
        for batch in batches:
            for grp, ids, x in _by_group(batch):
                if grp not in best:
                    continue
                (own, unit), (score, name) = held.value[grp], best[grp]
                x = _unit(x.astype(np.float64))
                margin = (x.shape[1] + 4) * 2.0**-23
                for a in range(0, len(ids), 2048):
                    # Only what float32 cannot rule out against the k-th best so far is compared exactly.
                    some, once = np.unique(ids[a : a + 2048], return_index=True)
                    part = x[a : a + 2048][once]
                    sims, least = rounded[grp] @ part.astype(np.float32).T, -score[:, -1]
                    if len(part) > k + 1 and (least < -1).any():
                        # Nothing held yet: the block's own k-th best, the probe itself aside.
                        least = np.maximum(least, np.partition(sims, -k - 1, axis=1)[:, -k - 1])
                    q, c = np.nonzero(sims >= (least - margin)[:, None])
                    there = some[c]
                    q, c, there = (v[own[q] != there] for v in (q, c, there))
                    exact = np.empty(len(q))
                    for i in range(0, len(q), 65_536):
                        exact[i : i + 65_536] = np.einsum("ij,ij->i", unit[q[i : i + 65_536]], part[c[i : i + 65_536]])
                    touched = np.unique(q)
                    q = np.concatenate([np.repeat(touched, k), q])
                    there = np.concatenate([name[touched].ravel(), there])
                    exact = np.concatenate([score[touched].ravel(), -exact])
                    order = np.lexsort((there, exact, q))
                    q, there, exact = q[order], there[order], exact[order]
                    # A repeated id counts once: equal rows lie side by side.
                    new = (there == 1 << 62) | (np.diff(there, prepend=-1) != 0) | (np.diff(q, prepend=-1) != 0)
                    q, there, exact = q[new], there[new], exact[new]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    first = place < k
                    score[q[first], place[first]], name[q[first], place[first]] = exact[first], there[first]
        for grp, (score, name) in best.items():
            q, at = np.nonzero(score < 2)
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(q), pa.string()), pa.array(held.value[grp][0][q]), pa.array(score[q, at]), pa.array(name[q, at])], ["grp", "q", "s", "id"])

    found = rows.mapInArrow(nearest, "grp string, q long, s double, id long")
    return found.groupBy("grp", "q").agg(F.slice(F.array_sort(F.collect_set(F.struct("s", "id"))), 1, k).alias("near"))


def build_index(rows: DataFrame, k: int, recall: float = RECALL, sample: int | None = None, probes: int = PROBES, leaf: int = LEAF, copies: int = COPIES, region: int | None = None) -> tuple[dict[str, Tree], dict[str, list[bytes]]]:
    """(trees by group, often stored vectors by group). region: rows of a region, if not by the length of its vectors."""
    counts = cut(rows.groupBy("grp").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return {}, {}
    # Fewer than GROUPS groups hold more than 1/GROUPS of the rows.
    large = {g: n for g, n in counts.where(F.col("n") > max(leaf, total // GROUPS)).collect()}
    sample = sample or min(MOST_SAMPLE, max(LEAST_SAMPLE, total // SAMPLE_SHARE))
    pick = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, int(total / (sample * 0.95))))) == 0
    # The limit guards the driver against ids stored very often; a hash of different ids stays under it.
    drawn = _packed(rows.where(pick).limit(2 * sample))
    often, trees, probed = {}, {}, []
    each = max(32, min(probes, MOST_PROBES // max(1, len(large))))
    for grp, ids, x in drawn:
        same, n = np.unique(x.view(np.dtype((np.void, 4 * x.shape[1]))).ravel(), return_counts=True)
        if (n >= copies).any():
            often[grp] = [v.tobytes() for v in same[n >= copies]]
        if grp in large:
            # The probes are drawn over the whole sample of the group and kept out of the fit.
            mixed = np.random.default_rng(11).permutation(len(ids))
            some, rest = mixed[: min(each, len(ids) // 4)], mixed[min(each, len(ids) // 4) :]
            trees[grp] = fit_tree(x[np.sort(rest)], large[grp], leaf)
            trees[grp].region = regions(trees[grp], region or max(leaf, REGION_VALUES // x.shape[1]))
            probed.append((grp, ids[some], x[some]))
    probed = [p for p in probed if trees[p[0]].leaves > 1]
    if probed:
        truth = exact_leaves(rows, trees, probed, k)
        for grp, ids, x in probed:
            calibrate(trees[grp], _unit(x).astype(np.float32), [truth.get((grp, int(i)), np.empty(0, np.int64)) for i in ids], recall)
    return trees, often


def exact_leaves(rows: DataFrame, trees: dict[str, Tree], probes: list, k: int) -> dict[tuple[str, int], np.ndarray]:
    """The leaf of each exact neighbour of each probe: the neighbours' own rows are looked up by id."""
    near = cut(exact_neighbours(rows, probes, k))
    wanted = near.select("grp", F.explode("near.id").alias("id")).distinct()
    # At most k a probe.
    found = rows.join(F.broadcast(wanted), ["grp", "id"], "left_semi")
    place = {}
    for grp, ids, x in _packed(found.dropDuplicates(["grp", "id"])):
        place |= {(grp, int(i)): int(h) for i, h in zip(ids, homes(trees[grp], _unit(x).astype(np.float32)))}
    return {(r[0], r[1]): np.array([place[r[0], i] for i in r[2]]) for r in near.select("grp", "q", "near.id").collect()}


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the first of each class of equal vectors, class of each row)."""
    _, first, of = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, of.ravel()


def _candidates(query: np.ndarray, base: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, base) row numbers: all that float32 cannot tell from the ``keep`` best of each query."""
    rows, at = [], []
    # Twice what a float32 product of two rounded unit vectors can be off.
    margin = (query.shape[1] + 4) * 2.0**-23
    for a in range(0, len(query), 256):
        sims = query[a : a + 256] @ base.T
        least = np.partition(sims, -keep, axis=1)[:, -keep] - margin if keep < len(base) else np.full(len(sims), -2.0)
        r, c = np.nonzero(sims >= least[:, None])
        rows.append(r + a), at.append(c)
    return np.concatenate(rows), np.concatenate(at)


def search_block(x: np.ndarray, ids: np.ndarray, stored: np.ndarray, k: int, recall: float = RECALL, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, similarity): the k best stored rows of one branch for each of its rows."""
    base = np.flatnonzero(stored)
    base = base[np.unique(ids[base], return_index=True)[1]]
    first, of = _classes(x[base])
    # The k + 1 smallest ids of each class of equal vectors: ``base`` is in the order of ids.
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(first)))
    size = np.minimum(np.diff(np.append(start, len(of))), k + 1)
    asks, who = np.unique(ids, return_index=True)
    x64 = x.astype(np.float64)
    norm = np.linalg.norm(x64, axis=1)
    unit = (x64 / norm[:, None]).astype(np.float32)
    mine, uniq = unit[who], unit[base[first]]
    if len(uniq) <= 2 * leaf:
        q, c = _candidates(mine, uniq, k + 1)
    else:
        tree = fit_tree(uniq, len(uniq), leaf)
        home = homes(tree, uniq)
        some = np.random.default_rng(13).permutation(len(uniq))[:LEAF_PROBES]
        pq, pc = _candidates(uniq[some], uniq, k + 1)
        pq, pc = pq[some[pq] != pc], pc[some[pq] != pc]
        calibrate(tree, uniq[some], [home[pc[pq == i]] for i in range(len(some))], recall)
        go, to = route(tree, mine)
        lies, goes = np.argsort(home, kind="stable"), np.argsort(to, kind="stable")
        parts = []
        for n in range(tree.leaves):
            here = lies[np.searchsorted(home[lies], n) : np.searchsorted(home[lies], n, "right")]
            them = go[goes[np.searchsorted(to[goes], n) : np.searchsorted(to[goes], n, "right")]]
            if len(here) and len(them):
                a, b = _candidates(mine[them], uniq[here], k + 1)
                parts.append((them[a], here[b]))
        q, c = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    exact = np.empty(len(q))
    at, to = who[q], base[first[c]]
    for i in range(0, len(q), 65_536):
        part = slice(i, i + 65_536)
        exact[part] = np.einsum("ij,ij->i", x64[at[part]], x64[to[part]]) / (norm[at[part]] * norm[to[part]])
    # Classes fall apart into ids; a row is no neighbour of its own.
    many = size[c]
    q, exact = np.repeat(q, many), np.repeat(exact, many)
    near = ids[base[order[np.repeat(start[c], many) + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)]]]
    other = asks[q] != near
    q, exact, near = q[other], exact[other], near[other]
    order = np.lexsort((near, -exact, q))
    q = q[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    q = np.sort(q)
    q = q[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return asks[q], near[order], exact[order]


def _often(rows: DataFrame, often: dict[str, list[bytes]], k: int) -> DataFrame:
    """grp, vec, ids: the k + 1 smallest ids of each vector stored very often."""
    held = rows.sparkSession.sparkContext.broadcast({g: set(v) for g, v in often.items()})

    def smallest(batches):
        best: dict[tuple, list] = {}
        for batch in batches:
            for grp, ids, x in _by_group(batch):
                wanted = held.value.get(grp, ())
                for i, v in zip(ids.tolist(), map(bytes, x)) if wanted else ():
                    if v in wanted and ((old := best.get((grp, v))) is None or len(old) <= k or i < old[-1]):
                        best[grp, v] = sorted({*(old or ()), i})[: k + 1]
        out = [(g, np.frombuffer(v, np.float32), i) for (g, v), ids in best.items() for i in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, _, _ in out], pa.string()), pa.array([v for _, v, _ in out], pa.list_(pa.float32())), pa.array([i for _, _, i in out], pa.int64())], ["grp", "vec", "id"]
        )

    few = rows.mapInArrow(smallest, "grp string, vec array<float>, id long")
    return few.groupBy("grp", "vec").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))


def nearest_neighbours(df: DataFrame, row_id: str, group: str, vector: str, k: int = 5, recall: float = RECALL, **sizes) -> DataFrame:
    """id, neighbour, similarity: the k most similar vectors of the same group."""
    rows = _usable(df, row_id, group, vector)
    leaf = sizes.get("leaf", LEAF)
    trees, often = build_index(rows, k, recall, **sizes)
    spare = None
    if often:
        heavy = F.broadcast(cut(_often(rows, often, k)).where(F.size("ids") > k))
        marked = rows.join(heavy, ["grp", "vec"], "left")
        out = F.col("ids").isNotNull() & ~F.array_contains("ids", F.col("id"))
        spare = marked.where(out).select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity")).distinct()
        rows = marked.where(~out).select("grp", "id", "vec")
    held = df.sparkSession.sparkContext.broadcast(trees)

    def scatter(batches):
        """Each row once into every region it visits, with its branches there; the branch that stores it is marked."""
        for batch in batches:
            for grp, ids, raw in _by_group(batch):
                tree = held.value.get(grp)
                if tree is None or tree.leaves < 2:
                    at, to, where = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                else:
                    at, to = route(tree, _unit(raw.astype(np.float64)).astype(np.float32))
                    where = tree.region[to]
                own = np.diff(at, prepend=-1) != 0
                order = np.lexsort((at, where))
                at, to, where = at[order], np.where(own, ~to, to)[order].astype(np.int32), where[order]
                # One packed row for each region: no cost a row in the shuffle.
                starts = np.flatnonzero(np.diff(where, prepend=-1) != 0)
                packs = [(*np.unique(at[a:b], return_counts=True), to[a:b]) for a, b in zip(starts, [*starts[1:], len(at)])]
                blobs = lambda values: pa.array([v.tobytes() for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([grp] * len(packs)), pa.array(where[starts]), blobs(ids[i].astype(np.int64) for i, _, _ in packs),
                        blobs(raw[i] for i, _, _ in packs), blobs(n.astype(np.int32) for _, n, _ in packs), blobs(t for _, _, t in packs),
                    ],
                    ["grp", "region", "ids", "vecs", "visits", "branches"],
                )

    def within(table: pa.Table) -> pa.Table:
        ids, visits, to = (np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("visits", np.int32), ("branches", np.int32)))
        x = np.concatenate([np.frombuffer(b, np.float32) for b in table.column("vecs").to_pylist()]).reshape(len(ids), -1)
        row, stored = np.repeat(np.arange(len(ids)), visits), to < 0
        to = np.where(stored, ~to, to)
        order = np.argsort(to, kind="stable")
        starts = np.flatnonzero(np.diff(to[order], prepend=-1) != 0)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for a, b in zip(starts, [*starts[1:], len(to)]):
            mine = order[a:b]
            if stored[mine].any():
                found.append(search_block(x[row[mine]], ids[row[mine]], stored[mine], k, recall, leaf))
        ids, near, sims = merge_best(*(np.concatenate(c) for c in zip(*found)), k)
        starts = np.flatnonzero(np.diff(ids, prepend=np.iinfo(np.int64).min) != 0) if len(ids) else np.empty(0, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(-sims.astype(np.float64)), pa.array(near)], ["s", "n"])
        return pa.table({"id": pa.array(ids[starts]), "near": pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pairs)})

    spread = rows.mapInArrow(scatter, "grp string, region long, ids binary, vecs binary, visits binary, branches binary")
    # A task's share does not grow with the table: a region or two each, as hashes fall, whatever the session's shuffle width.
    width = max(shuffle_width(df.sparkSession), 4 * sum(int(t.region.max()) + 1 for t in trees.values()))
    local = spread.repartition(width, "grp", "region").groupBy("grp", "region").applyInArrow(within, "id long, near array<struct<s:double,n:long>>")
    best = local.groupBy("id").agg(best_of("near", k).alias("r")).select("id", F.explode("r").alias("r"))
    best = best.select("id", F.col("r.n").alias("neighbour"), (-F.col("r.s")).alias("similarity"))
    return best if spare is None else best.unionByName(spare)


def merge_best(ids: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each id, best first; equal rows count once."""
    order = np.lexsort((near, -sims, ids))
    ids, near, sims = ids[order], near[order], sims[order]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(near) != 0) | (np.diff(sims) != 0)
    ids, near, sims = ids[new], near[new], sims[new]
    first = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return ids[first], near[first], sims[first]


def best_of(near: str, k: int) -> Column:
    """The k first of a row's small lists, one for each region it visited."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(near)))), 1, k)


def measured_recall(df: DataFrame, row_id: str, group: str, vector: str, k: int = 5, every: int = 100, **sizes) -> DataFrame:
    """group, queries, recall: found against exact neighbours of the rows whose id is divisible by ``every``.

    The queries go against all rows in waves of a bounded number.
    """
    rows = _usable(df, row_id, group, vector)
    found = nearest_neighbours(df, row_id, group, vector, k, **sizes).where(F.col("id") % every == 0)
    asks = rows.where(F.col("id") % every == 0)
    waves, exact = -(-max(1, asks.count()) // WAVE), None
    for wave in range(waves):
        probes = _packed(asks.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(waves)) == wave))
        if probes:
            near = exact_neighbours(rows, probes, k).select("grp", F.col("q").alias("id"), F.explode("near.id").alias("neighbour"))
            exact = near if exact is None else exact.unionByName(near)
    if exact is None:
        return df.sparkSession.createDataFrame([], f"{group} string, queries long, recall double")
    both = exact.join(found.select("id", "neighbour", F.lit(1.0).alias("hit")), ["id", "neighbour"], "left")
    by = both.groupBy(F.substring_index("grp", ":", 1).alias("length"), F.expr("substring(grp, locate(':', grp) + 1)").alias(group))
    return by.agg(F.countDistinct("id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")).drop("length")


def mutual_pairs(neighbours: DataFrame, name: str) -> DataFrame:
    """name_a < name_b: one of the two is among the neighbours of the other."""
    return neighbours.select(F.least("id", "neighbour").alias(f"{name}_a"), F.greatest("id", "neighbour").alias(f"{name}_b")).distinct()
