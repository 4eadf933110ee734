import random

from tracewell.operators.hierarchy import descendants, parent_conflicts, resolve_hierarchy

EDGE = "c string, p string, extra string"


def brute(parent):
    out = {}
    for n in {*parent, *parent.values()} - {None}:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parent.get(x)
        out[n] = (seen[-1], False) if x is None else (min(seen[seen.index(x) :]), True)
    return out


def run(spark, rows):
    return resolve_hierarchy(spark.createDataFrame(rows, EDGE), ["c"], ["p"], with_paths=True)


def test_random_functional_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"n{i}" for i in range(60)]
        parent = {n: rng.choice(names) for n in names[:50] if rng.random() < 0.9}
        parent |= {f"chain{i}": f"chain{i + 1}" for i in range(40)}
        rows = [(c, p, "x") for c, p in parent.items()] * 2
        h = run(spark, rows)
        got = {r["node"]["k0"]: (r["root"]["k0"], False) for r in h.trees.collect()}
        got |= {r["node"]["k0"]: (r["root"]["k0"], True) for r in h.looped.collect()}
        assert got == brute(parent)
        for r in h.trees.collect():
            path = [x["k0"] for x in r["path"]]
            assert len(path) == r["depth"] + 1 and path[-1] == r["node"]["k0"] and all(parent[b] == a for a, b in zip(path, path[1:]))
        pairs = descendants(h)
        assert pairs.count() == sum(r["depth"] for r in h.trees.collect())


def test_edge_cases(spark):
    h = run(spark, [("a", "a", None), ("b", None, None), (None, "x", None), (None, None, None), ("c", "b", None), ("c", "d", None)])
    assert {(r["node"]["k0"], r["on_cycle"]) for r in h.looped.collect()} == {("a", True)}
    trees = {r["node"]["k0"]: r["root"]["k0"] for r in h.trees.collect()}
    assert trees == {"b": "b", "x": "x", "c": "b"}
    conflicts = parent_conflicts(spark.createDataFrame([("c", "b", ""), ("c", "d", ""), ("e", "f", "")], EDGE), ["c"], ["p"]).collect()
    assert [(r["node"]["k0"], r["parents"]) for r in conflicts] == [("c", 2)]


def test_empty(spark):
    h = run(spark, [])
    assert h.trees.count() == 0 and h.looped.count() == 0


def test_one_parent_of_all(spark):
    h = run(spark, [(f"c{i}", "top", "") for i in range(2000)])
    assert h.trees.where("depth = 1").count() == 2000
