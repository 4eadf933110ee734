import random

import pytest

from tracewell.operators import graph

E = "src string, dst string, node string"


def make(spark, n, m, seed):
    rng = random.Random(seed)
    rows = [(f"v{rng.randrange(n):03d}", f"v{rng.randrange(n):03d}", "extra") for _ in range(m)]
    return rows, spark.createDataFrame(rows + rows[:3] + [(None, "x", ""), ("y", None, "")], E)


def reach(rows):
    out = {}
    for a, b, _ in rows:
        out.setdefault(a, set()).add(b)
    full = {}
    for a in {x for r in rows for x in r[:2]}:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        full[a] = seen
    return full


def test_components(spark):
    rows, df = make(spark, 80, 60, 2)
    rows += [(f"w{i:03d}", f"w{i + 1:03d}", "") for i in range(200)]
    both = reach(rows + [(b, a, "") for a, b, _ in rows])
    got = {r[0]: r[1] for r in graph.connected_components(df.union(spark.createDataFrame(rows[60:], E))).collect()}
    assert got == {a: min(s | {a}) for a, s in both.items()}


def test_cycles(spark):
    rows, df = make(spark, 30, 40, 5)
    full = reach(rows)
    want = {a: min(b for b in full if a in full[b] and b in full[a]) for a in full if any(b != a and a in full[b] and b in full[a] for b in full)}
    assert {r[0]: r[1] for r in graph.reference_cycles(df).collect()} == want
    assert not graph.has_cycle(spark.createDataFrame([("a", "b", ""), ("b", "c", "")], E))
    assert graph.reference_cycles(df.limit(0)).count() == 0


def test_long_chain_and_long_cycle(spark):
    """A long chain condenses in logarithmically many rounds; a long cycle is found whole."""
    name = lambda i: f"n{i:05d}"
    chain = [(name(i), name(i + 1), "") for i in range(2_000)]
    assert not graph.has_cycle(spark.createDataFrame(chain, E))
    ring = chain[:500] + [(name(500), name(0), ""), (name(50), "tail", ""), ("head", name(70), ""), (name(100), name(40), "")]
    got = {r[0]: r[1] for r in graph.reference_cycles(spark.createDataFrame(ring, E)).collect()}
    assert got == {name(i): name(0) for i in range(501)}


def test_star_is_no_hot_group(spark):
    df = spark.createDataFrame([("hub", f"s{i}", "") for i in range(3000)], E)
    assert graph.connected_components(df).select("component").distinct().count() == 1


def test_budgets(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    hops = graph.bounded_traversal(edges, spark.createDataFrame([("a",)], "node string"), 5)
    assert {(r[0], r[1]) for r in hops.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    seeds = spark.createDataFrame([("a",)], "node string")
    cut = graph.budgeted_subgraph(seeds, edges, 5, 2, 10)
    assert cut.edges.sum() == 1 and "node-bound" in set(cut.reason)
    assert set(graph.budgeted_subgraph(seeds, edges, 5, 9, 0).reason) == {"edge-bound"}
    with pytest.raises(ValueError):
        graph.budgeted_subgraph(edges.select("src"), edges, 5, 2, 10)


def walked(seeds, edges, max_hops, max_nodes, max_edges):
    """The walk by its definition, over all edges in memory."""
    nodes, used, out, front, hop, halted = set(seeds), set(), [], sorted(seeds), 0, "edge-bound" if max_edges == 0 else None
    while front:
        new = []
        for x in front:
            for direction, mine in (("superseding", sorted(e for e in edges if e[0] == x)), ("superseded", sorted(e for e in edges if e[1] == x))):
                if hop >= max_hops or halted:
                    out.append((x, hop, direction, "NOT_STARTED", "edge-hop-bound" if hop >= max_hops else halted, 0))
                    continue
                n = 0
                for e in mine:
                    if e in used:
                        continue
                    fresh = {*e} - nodes
                    halted = "node-bound" if len(nodes) + len(fresh) > max_nodes else "edge-bound" if len(used) >= max_edges else None
                    if halted:
                        break
                    used.add(e), nodes.update(fresh)
                    new += fresh
                    n += 1
                out.append((x, hop, direction, "PARTIAL" if halted else "COMPLETE", halted, n))
        front, hop = sorted(new), hop + 1
    return out


def test_budgeted_walk_equals_its_definition(spark):
    hub = [("zzz", "aaa"), *(("aaa", f"b{i:05d}") for i in range(2000))]
    got = graph.budgeted_subgraph(spark.createDataFrame([("zzz",)], "n string"), spark.createDataFrame(hub, "src string, dst string"), 2, 5, 5)
    rows = [tuple(None if x != x else x for x in r) for r in got.itertuples(index=False)]
    assert rows == walked(["zzz"], hub, 2, 5, 5) and ("aaa", 1, "superseding", "PARTIAL", "node-bound", 3) in rows
    rng = random.Random(8)
    for seed in range(3):
        edges = sorted({(f"v{rng.randrange(25):02d}", f"v{rng.randrange(25):02d}") for _ in range(50)})
        seeds = [f"v{rng.randrange(25):02d}" for _ in range(2)]
        bounds = (rng.randrange(1, 4), rng.randrange(4, 14), rng.randrange(0, 20))
        got = graph.budgeted_subgraph(spark.createDataFrame([(x,) for x in seeds], "n string"), spark.createDataFrame(edges + edges[:4], "src string, dst string"), *bounds)
        assert [tuple(None if x != x else x for x in r) for r in got.itertuples(index=False)] == walked(seeds, edges, *bounds)


def test_rounds_and_bounded_rest_agree(spark):
    """The distributed rounds, with no rest left to one task, give what the bounded finish gives."""
    _, df = make(spark, 60, 70, 5)
    for fn in (graph.connected_components, graph.reference_cycles):
        assert sorted(fn(df, rest=0).collect()) == sorted(fn(df).collect())


def test_graph_queries(spark):
    nodes = spark.createDataFrame([("b", "PANEL", "P1"), ("a", "LOAD", None), ("c", "LOAD", "L")], "node_id string, node_type string, display_name string")
    edges = spark.createDataFrame([("c", "b", "CONNECTED"), ("b", "a", "CONNECTED"), ("b", "b", "CONNECTED"), ("b", "a", "CONTAINS"), ("a", "zz", "REFERENCES")], "source string, target string, edge_type string")
    ask = lambda kind, value: [r[0] for r in graph.query_graph(nodes, edges, kind, value).collect()]
    assert ask("FIND_NODE", "a") == ["a"] and ask("FIND_NODE", "zz") == [] and ask("FIND_NODES_BY_TYPE", "LOAD") == ["a", "c"] and ask("FIND_NODES_BY_DISPLAY_NAME", "L") == ["c"]
    assert ask("FIND_CONNECTED_NEIGHBORS", "b") == ["a", "c"] and ask("FIND_CONTAINED_NODES", "b") == ["a"] and ask("FIND_REFERENCED_NODES", "a") == []
    for bad in (("FIND", "a"), ("FIND_NODE", ""), ("FIND_NODE", None)):
        with pytest.raises(ValueError):
            ask(*bad)


def test_greedy_resolution(spark):
    rows = [("p", "a", 2, 0.9, [1], [2], False), ("p", "b", 1, 0.9, [2], [], False), ("p", "c", 1, 0.8, [3], [2], True), ("p", "d", 0, 0.8, [4], [], True), ("q", "e", 0, 0.1, [1], [], True)]
    df = spark.createDataFrame(rows, "page string, candidate_id string, priority int, confidence double, primary array<int>, supporting array<int>, shares boolean")
    got = {r["candidate_id"]: (r["status"], r["winner_id"]) for r in graph.resolve_candidates(df, ["page"]).collect()}
    assert got == {"a": ("SELECTED", None), "b": ("REJECTED", "a"), "c": ("REJECTED", "a"), "d": ("SELECTED", None), "e": ("SELECTED", None)}
