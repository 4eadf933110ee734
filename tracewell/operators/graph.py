"""Graph operators over edge DataFrames: components, cycles, neighbours, bounded traversal, resolution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut

# A rest of at most so many edges (a few MB) is finished by one task; the rounds go on as long as more are left.
REST_EDGES = 200_000


def _whole(edges: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on one frame of all edges, which the caller has proved few, in one task of an executor."""
    return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: fn(pdf.drop(columns="_all")), schema)


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    """u, v: the smallest node (v) of the component of each node but that one, by union-find."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in up]
    return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    """node, c: strongly connected components of more than one node or with a loop, by depth-first search without recursion."""
    nxt: dict = {}
    for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
        nxt.setdefault(a, []).append(b)
        nxt.setdefault(b, [])
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in nxt:
        work = [] if start in index else [(start, iter(nxt[start]))]
        if work:
            index[start] = low[start] = len(index)
            stack.append(start), on.add(start)
        while work:
            at, ways = work[-1]
            for to in ways:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to), on.add(to)
                    work.append((to, iter(nxt[to])))
                    break
                if to in on:
                    low[at] = min(low[at], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == index[at]:
                    part = []
                    while not part or part[-1] != at:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or at in nxt[at]:
                        out += [(x, min(part)) for x in part]
    return pd.DataFrame(out, columns=["node", "c"])


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", rest: int = REST_EDGES) -> DataFrame:
    """node, component (the smallest node): alternating large-star and small-star rounds.

    Rounds grow with the logarithm of the longest chain. The minimum of a node's neighbours is combined
    before the shuffle; the join that hands it to their edges is an inner equi-join, which adaptive execution
    splits where a node has very many edges. At most ``rest`` edges are finished by union-find in one task.
    Null ends are dropped; nodes without edges, if given, are components of their own.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    if nodes is not None:
        seen = seen.union(nodes.select(nodes.columns[0]).where(F.col(nodes.columns[0]).isNotNull()))
    last, n = None, now.count()
    while n > rest:
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and the node, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        now, n = after, mark[0]
        if mark == last:
            break
        last = mark
    if 0 < n <= rest:
        now = _whole(now, _united, now.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    return seen.distinct().join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _trim(edges: DataFrame) -> DataFrame:
    """One pass without the edges of nodes that have no way in or no way out."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(edges, removed): bypass an independent set of the nodes with one way in and one way out.

    removed: node, before, after. About a third of the nodes of every long chain goes at a time.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.min("src").alias("before"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.min("dst").alias("after"))
    links = into.join(out, "node").where("i = 1 and o = 1 and before <> node").select("node", "before", "after")
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), F.col(c))
    left, right = links.select(F.col("node").alias("before"), F.lit(True).alias("_l")), links.select(F.col("node").alias("after"), F.lit(True).alias("_r"))
    chosen = links.join(left, "before", "left").join(right, "after", "left")
    chosen = chosen.where((F.col("_l").isNull() | (rank("node") < rank("before"))) & (F.col("_r").isNull() | (rank("node") < rank("after"))))
    removed = cut(chosen.select("node", "before", "after"))
    gone = removed.select("node")
    kept = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return kept.select("src", "dst").union(removed.select(F.col("before").alias("src"), F.col("after").alias("dst"))).distinct(), removed


def condense(edges: DataFrame, src: str = "src", dst: str = "dst", rest: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(edges, removed by round): trimmed of what lies on no cycle, with chains bypassed, until at most ``rest`` edges are left.

    Trimming alone takes a round a level; with chains contracted a path of any length takes logarithmically
    many. The rest is empty exactly if the graph has no directed cycle; a loop stands for a whole cycle.
    """
    now = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    n, rounds = now.count(), []
    while n > rest:
        smaller, removed = _contract(cut(_trim(now)), len(rounds))
        now = cut(smaller)
        if not removed.isEmpty():
            rounds.append(removed)
        m = now.count()
        if m == n:
            break
        n = m
    return now, rounds


def reference_cycles(edges: DataFrame, src: str = "src", dst: str = "dst", rest: int = REST_EDGES) -> DataFrame:
    """node, cycle: strongly connected components of more than one node (cycle: their smallest node).

    Once at most ``rest`` edges are left one task finds the components of these. A larger rest is coloured forward to a fixed point; a root's component is what reaches the root
    within its colour, and the rest goes round again. Bypassed nodes then join their neighbours' component.
    """
    left, rounds = condense(edges.where(F.col(src) != F.col(dst)), src, dst, rest)
    if left.count() <= rest:
        return _bypassed(cut(_whole(left, _strong, f"node {left.schema['src'].dataType.simpleString()}, c {left.schema['src'].dataType.simpleString()}")), rounds)
    looped, labels = cut(left.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("looped"))), None
    left = _settled(left.where("src <> dst"))
    while not left.isEmpty():
        colour = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
        while True:
            pushed = left.join(colour, left.src == colour.node).groupBy("dst").agg(F.min("c").alias("n"))
            step = cut(colour.join(pushed, colour.node == pushed.dst, "left").select("node", "c", F.least("c", F.coalesce("n", "c")).alias("d")))
            changed = not step.where("c <> d").isEmpty()
            colour = step.select("node", F.col("d").alias("c"))
            if not changed:
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        inner = cut(left.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        back = cut(colour.where("node = c").select("node", "c"))
        front = back
        while not front.isEmpty():
            more = inner.join(front.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            front = cut(more.join(back, ["node", "c"], "left_anti"))
            back = cut(back.union(front))
        labels = back if labels is None else labels.union(back)
        left = _settled(left.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti"))
    own = looped.select("node", F.col("node").alias("c"))
    labels = own if labels is None else labels.union(own.join(labels.select("node"), "node", "left_anti"))
    size = labels.groupBy("c").agg((F.count("*") > 1).alias("many"))
    real = labels.join(size, "c").join(looped, "node", "left")
    keep = real.groupBy("c").agg(F.max(F.col("many") | F.coalesce("looped", F.lit(False))).alias("keep")).where("keep")
    return _bypassed(cut(labels.join(keep.select("c"), "c").select("node", "c")), rounds)


def _bypassed(labels: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """The components with their bypassed nodes, named by the smallest node."""
    for removed in reversed(rounds):
        ends = removed.join(labels.select(F.col("node").alias("before"), F.col("c").alias("cb")), "before").join(labels.select(F.col("node").alias("after"), F.col("c").alias("ca")), "after")
        labels = cut(labels.union(ends.where("ca = cb").select("node", F.col("ca").alias("c"))))
    return labels.join(labels.groupBy("c").agg(F.min("node").alias("cycle")), "c").select("node", "cycle")


def _settled(edges: DataFrame) -> DataFrame:
    """Trimmed until nothing changes; after condensing few passes are left."""
    now = cut(edges)
    n = now.count()
    while n:
        now = cut(_trim(now))
        m = now.count()
        if m == n:
            break
        n = m
    return now


def has_cycle(edges: DataFrame, src: str = "src", dst: str = "dst") -> bool:
    """Whether a directed cycle exists, loops included."""
    return not condense(edges, src, dst)[0].isEmpty()


def neighbours(edges: DataFrame, of: DataFrame, directed: bool = False) -> DataFrame:
    """node, neighbour: one hop from the nodes of ``of``; both ways unless directed."""
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    if not directed:
        ways = ways.union(edges.select("dst", "src"))
    return ways.join(of.select(F.col(of.columns[0]).alias("node")).distinct(), "node", "left_semi").distinct()


# The kinds of graph queries.
QUERY_KINDS = ("FIND_NODE", "FIND_NODES_BY_TYPE", "FIND_NODES_BY_DISPLAY_NAME", "FIND_CONNECTED_NEIGHBORS", "FIND_CONTAINED_NODES", "FIND_REFERENCED_NODES")


def query_graph(nodes: DataFrame, edges: DataFrame, kind: str, value: str) -> DataFrame:
    """The nodes that one query finds, in the order of their ids; an unknown id, type or name finds none.

    nodes: node_id, node_type, display_name; edges: source, target, edge_type. Names compare exactly, and a
    null name is found by none. Neighbours are one hop away, never the node itself.
    """
    if kind not in QUERY_KINDS or not isinstance(value, str) or not value:
        raise ValueError(f"a graph query is one of {', '.join(QUERY_KINDS)} with a value that is not empty")
    column = {"FIND_NODE": "node_id", "FIND_NODES_BY_TYPE": "node_type", "FIND_NODES_BY_DISPLAY_NAME": "display_name"}.get(kind)
    if column:
        return nodes.where(F.col(column) == value).orderBy("node_id")
    edge_type = {"FIND_CONNECTED_NEIGHBORS": "CONNECTED", "FIND_CONTAINED_NODES": "CONTAINS", "FIND_REFERENCED_NODES": "REFERENCES"}[kind]
    mine = edges.where(F.col("edge_type") == edge_type)
    ids = mine.where(F.col("source") == value).select(F.col("target").alias("node_id"))
    if kind == "FIND_CONNECTED_NEIGHBORS":
        ids = ids.union(mine.where(F.col("target") == value).select("source"))
    return nodes.join(ids.where(F.col("node_id") != value).distinct(), "node_id", "left_semi").orderBy("node_id")


def bounded_traversal(edges: DataFrame, seeds: DataFrame, max_hops: int, directions: tuple = ("up", "down")) -> DataFrame:
    """node, hop: breadth first over edges (src superseded, dst superseding) by a frontier of joins."""
    ways = None
    if "up" in directions:
        ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    if "down" in directions:
        down = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
        ways = down if ways is None else ways.union(down)
    found = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("hop", F.lit(0)))
    front = found
    for hop in range(1, max_hops + 1):
        front = front.join(ways, "node").select(F.col("next").alias("node")).distinct().join(found, "node", "left_anti")
        front = cut(front.withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def budgeted_subgraph(seeds: DataFrame, edges: DataFrame, max_hops: int, max_nodes: int, max_edges: int) -> pd.DataFrame:
    """Observations in visiting order under node and edge budgets: node, hop, direction, status, reason, edges.

    Nodes are visited hop by hop in the order of their addresses, their edges towards superseding, then
    superseded records in the order of theirs. An edge that would exceed a budget halts the walk. The
    budgets are constants given by the caller: a hop reads, of each of its at most ``max_nodes`` nodes and
    each direction, the first edges only, as many as could be known already and fill the budget.
    """
    first = 2 * max_edges + 1
    start = [r[0] for r in seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct().orderBy("node").limit(max_nodes + 1).collect()]
    if len(start) > max_nodes:
        raise ValueError("more seeds than nodes allowed")
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    nodes, used, out, front, hop = set(start), set(), [], start, 0
    halted = "edge-bound" if max_edges == 0 else None
    while front:
        ways: dict[tuple, list] = {}
        if hop < max_hops and not halted:
            here = F.broadcast(spark.createDataFrame([(x,) for x in front], f"node {kind}"))
            for direction, own, other in (("superseding", "src", "dst"), ("superseded", "dst", "src")):
                mine = edges.join(here, edges[own] == here.node, "left_semi").select("src", "dst").where("src is not null and dst is not null").distinct()
                rank = F.row_number().over(Window.partitionBy(own).orderBy(other))
                for r in mine.withColumn("_n", rank).where(F.col("_n") <= first).orderBy(own, "_n").collect():
                    ways.setdefault((r[own], direction), []).append((r["src"], r["dst"]))
        after = []
        for node in front:
            for direction in ("superseding", "superseded"):
                if hop >= max_hops:
                    out.append((node, hop, direction, "NOT_STARTED", "edge-hop-bound", 0))
                    continue
                if halted:
                    out.append((node, hop, direction, "NOT_STARTED", halted, 0))
                    continue
                taken = 0
                for e in ways.get((node, direction), ()):
                    if e in used:
                        continue
                    unseen = [x for x in dict.fromkeys(e) if x not in nodes]
                    if len(nodes) + len(unseen) > max_nodes:
                        halted = "node-bound"
                    elif len(used) >= max_edges:
                        halted = "edge-bound"
                    if halted:
                        break
                    used.add(e)
                    nodes.update(unseen)
                    after += unseen
                    taken += 1
                out.append((node, hop, direction, "PARTIAL" if halted else "COMPLETE", halted, taken))
        front, hop = sorted(after), hop + 1
    return pd.DataFrame(out, columns=["node", "hop", "direction", "status", "reason", "edges"])


def project_graph(relationships: DataFrame) -> DataFrame:
    """edge_id, edge_type, source, target, direction from relationship_type, source_id, target_id, via_id.

    A connection through a third object falls into two segments; belonging turns into containing.
    """
    seg = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("target"))
    kind = F.col("relationship_type")
    parts = (
        F.when(kind == "CONNECTED_VIA", F.array(seg("source_id", "via_id"), seg("via_id", "target_id")))
        .when(kind == "BELONGS_TO", F.array(seg("target_id", "source_id")))
        .when(kind.isin("CONNECTED_TO", "CONTAINS", "REFERENCES"), F.array(seg("source_id", "target_id")))
    )
    name = F.when(kind.isin("CONNECTED_TO", "CONNECTED_VIA"), "CONNECTED").when(kind.isin("CONTAINS", "BELONGS_TO"), "CONTAINS").otherwise("REFERENCES")
    rows = relationships.select(name.alias("edge_type"), F.explode(parts).alias("p"))
    both_ways = F.col("edge_type") == "CONNECTED"
    low, high = F.least("p.source", "p.target"), F.greatest("p.source", "p.target")
    rows = rows.select(
        "edge_type", F.when(both_ways, low).otherwise(F.col("p.source")).alias("source"), F.when(both_ways, high).otherwise(F.col("p.target")).alias("target"),
        F.when(both_ways, "UNDIRECTED").otherwise("FORWARD").alias("direction"),
    ).distinct()
    return rows.withColumn("edge_id", F.sha2(F.to_json(F.struct("edge_type", "source", "target", "direction")), 256))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_components, n_isolated over connected edges."""
    linked = edges.where("edge_type = 'CONNECTED'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    parts = connected_components(linked, nodes)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"))
    touched = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    isolated = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(touched, "node", "left_anti").agg(F.count("*").alias("n_isolated"))
    return totals.join(isolated).join(edges.agg(F.count("*").alias("n_edges")))


OBJECT_WEIGHTS = {"geometry": 0.30, "text": 0.30, "topology": 0.25, "context": 0.10, "source": 0.05}


def object_confidence(scores: dict[str, str], penalty: str):
    """Weighted sum of the five scores less penalties, clamped to 0..1 and stabilised at 12 digits."""
    total = sum((F.col(scores[k]) * w for k, w in OBJECT_WEIGHTS.items()), F.lit(0.0)) - F.col(penalty)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 12) + F.lit(0.0)


def object_status(confidence):
    return F.when(confidence < 0.6, "EXCLUDED").when(confidence < 0.8, "REVIEW_REQUIRED").otherwise("ACCEPTED")


def relationship_confidence(endpoint):
    """Never above the endpoints' own confidence."""
    return F.least(endpoint, endpoint * 0.4 + F.lit(0.3 + 0.2 + 0.1))


def resolve_relationships(candidates: DataFrame) -> DataFrame:
    """The best candidate of each semantic key, with the united evidence of its group.

    candidates: key, candidate_id, relationship_type, hard_gate, priority, confidence, evidence (array).
    Groups in which all candidates tie and types differ are ambiguous and dropped.
    """
    live = candidates.where("hard_gate and confidence >= 0.6 and relationship_type <> 'UNKNOWN'")
    rank = [F.desc("priority"), F.desc("confidence"), F.asc("relationship_type"), F.asc("candidate_id")]
    w = Window.partitionBy("key")
    groups = live.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
        (F.count_distinct("priority", "confidence") == 1).alias("tied"), (F.count_distinct("relationship_type") > 1).alias("mixed"),
    )
    best = live.withColumn("n", F.row_number().over(w.orderBy(*rank))).where("n = 1").drop("n", "evidence")
    return best.join(groups.where("not (tied and mixed)").select("key", "evidence"), "key")


def resolve_candidates(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Greedy conflict resolution within each page: status SELECTED or REJECTED with the winner.

    candidates: group.., candidate_id, priority, confidence, primary (array), supporting (array), shares
    (boolean). In order of priority, confidence and id each candidate is held against all selected ones.
    """
    fields = [f for f in candidates.schema.fields if f.name in group]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", candidate_id string, status string, winner_id string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "confidence", "candidate_id"], ascending=[False, False, True])
        # Owners by primitive: the first selected candidate in order is the recorded winner.
        primary, supporting, chosen, rows = {}, {}, [], []
        for r in pdf.itertuples():
            own, help_ = set(r.primary), set(r.supporting)
            hits = {primary[p] for p in own | help_ if p in primary}
            for p in own:
                hits |= supporting.get(p, set())
            for p in help_:
                hits |= {c for c in supporting.get(p, set()) if not (r.shares and chosen[c][1])}
            if hits:
                rows.append((r.candidate_id, "REJECTED", chosen[min(hits)][0]))
                continue
            at = len(chosen)
            chosen.append((r.candidate_id, r.shares))
            primary.update({p: at for p in own})
            for p in help_:
                supporting.setdefault(p, set()).add(at)
            rows.append((r.candidate_id, "SELECTED", None))
        out = pd.DataFrame(rows, columns=["candidate_id", "status", "winner_id"])
        for f in fields:
            out.insert(0, f.name, pdf[f.name].iloc[0])
        return out[[f.name for f in fields] + ["candidate_id", "status", "winner_id"]]

    return candidates.groupBy(*group).applyInPandas(run, schema)
