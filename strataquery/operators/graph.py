"""Topology of undirected graphs: nodes(node), edges(source, target, weight). Parallel edges count as one, weights summed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

#: Edges beyond which centrality is refused: its work is nodes times edges of the blocks, and every task holds the edges.
MAX_EDGES = 1_000_000
#: Most tasks over which the walks are spread.
WALK_TASKS = 64
#: How the numbers of a summary are made.
FORMULAS = {
    "average_degree": "sum(degrees) / node_count", "average_edge_weight": "sum(edge_weights) / edge_count", "bridge_score": "sum(edge_betweenness) / node_degree",
    "bridge_edge_ratio": "bridge_edge_count / edge_count", "cross_community_edge_ratio": "cross_community_edge_count / edge_count",
}


def simple_edges(edges: DataFrame) -> DataFrame:
    """One row (a, b, weight) for each pair of ends, a <= b."""
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("weight"))


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    return nodes.select("node").unionAll(ends).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    simple = simple_edges(edges).where("a <> b")
    return simple.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(simple.select(F.col("b").alias("node"), F.col("a").alias("other")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component. Smallest labels spread along edges and jump to their label's label
    until nothing changes, so long paths take few rounds; each round is checkpointed."""
    links = checkpointed(both_ways(edges))
    labels = checkpointed(all_nodes(nodes, edges).select("node", F.col("node").alias("label")))
    while True:
        spread = links.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(spread, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = checkpointed(lower.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels


def community_ids(labels: DataFrame) -> DataFrame:
    """node, community: components numbered by their smallest node, with the size of each. One window looks at a row a range."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # numbered range by range: each range's own places, plus how many components stand in the ranges before it
    ranged = sizes.repartitionByRange("label").sortWithinPartitions("label").withColumn("__at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__own", F.col("__at").bitwiseAND((1 << 33) - 1)))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = ranged.join(F.broadcast(before.select("__part", "__before")), "__part").select("label", "size", (F.col("__own") + F.col("__before")).alias("community"))
    return labels.join(ranks, "label").select("node", "community", "size")


def adjacency(edges: list[tuple]) -> dict:
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near


def blocks(edges: list[tuple]) -> tuple[list[list[tuple]], list[dict]]:
    """Edges parted into blocks, which no single node parts any further, and for each block its nodes with their weights: how
    many nodes are met from the node on without the block's edges, itself among them. A walk in depth, without recursion."""
    near, met, low, below = adjacency(edges), {}, {}, {}
    found, weights = [], []
    for root in sorted(near):
        if root in met:
            continue
        first = len(found)
        met[root] = low[root] = len(met)
        below[root] = 1  # nodes of the walk's tree from here on
        stack, open_edges = [(root, None, iter(near[root]), 0)], []
        hung: list[tuple] = []  # for each block its top, and how many nodes its branch has below that
        while stack:
            n, came, rest, at = stack[-1]
            x = next(rest, None)
            if x is None:
                stack.pop()
                if came is None:
                    continue
                low[came] = min(low[came], low[n])
                below[came] += below[n]
                if low[n] >= met[came]:  # nothing below n leads above came: the edges since then are a block
                    found.append(open_edges[at:])
                    del open_edges[at:]
                    hung.append((came, below[n]))
            elif x not in met:
                met[x] = low[x] = len(met)
                below[x] = 1
                stack.append((x, n, iter(near[x]), len(open_edges)))
                open_edges.append((n, x))
            elif x != came and met[x] < met[n]:
                open_edges.append((n, x))
                low[n] = min(low[n], met[x])
        size = below[root]
        under: dict = {}  # what hangs below a node in blocks of which it is the top
        for top, number in hung:
            under[top] = under.get(top, 0) + number
        for block, (top, number) in zip(found[first:], hung, strict=True):
            inner = {n: 1 + under.get(n, 0) for e in block for n in e}
            weights.append(inner | {top: size - number})
    return found, weights


def shares_of_paths(start, near: dict, weight: dict) -> dict[tuple, float]:
    """For each edge of a block, the part of the shortest paths from start to the others that cross it, each end counted as
    often as it weighs."""
    distance, ways, order = {start: 0}, {start: 1.0}, [start]
    for n in order:
        for x in near[n]:
            if x not in distance:
                distance[x], ways[x] = distance[n] + 1, 0.0
                order.append(x)
            if distance[x] == distance[n] + 1:
                ways[x] += ways[n]
    carried, out = dict.fromkeys(order, 0.0), {}
    for x in reversed(order):
        for n in near[x]:
            if distance[n] == distance[x] - 1:
                part = ways[n] / ways[x] * (weight[x] + carried[x])
                carried[n] += part
                out[min(n, x), max(n, x)] = part * weight[start]
    return out


def collected_edges(edges: DataFrame) -> list[tuple]:
    """The simple edges without loops on the driver; ValueError beyond MAX_EDGES."""
    found = [(r.a, r.b) for r in simple_edges(edges).where("a <> b").select("a", "b").limit(MAX_EDGES + 1).collect()]
    if len(found) > MAX_EDGES:
        raise ValueError(f"centrality is for graphs of at most {MAX_EDGES} edges")
    return found


def edge_betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, betweenness: unweighted, over n(n-1)/2 with isolated nodes counted.

    A shortest path between nodes of different blocks enters and leaves each block on its way at the nodes that part them, so
    that each block is walked by itself, its nodes weighing what hangs at them. An edge that is a block is crossed by every
    path between its sides. The work is nodes times edges of the blocks, not of the graph; start nodes of the larger blocks
    are spread over the tasks.
    """
    session = edges.sparkSession
    n = all_nodes(nodes, edges).count()
    kind = edges.schema["source"].dataType.simpleString()
    parted = list(zip(*blocks(collected_edges(edges)), strict=True))
    # what crosses an edge is met from both of its ends
    single = [(min(a, b), max(a, b), 2.0 * weight[a] * weight[b]) for ((a, b), *more), weight in parted if not more]
    larger = session.sparkContext.broadcast([(list(weight), adjacency(block), weight) for block, weight in parted if len(block) > 1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, float] = {}
        for frame in frames:
            for block, place in zip(frame["block"], frame["place"], strict=True):
                starts, near, weight = larger.value[block]
                for edge, part in shares_of_paths(starts[place], near, weight).items():
                    total[edge] = total.get(edge, 0.0) + part
        yield pd.DataFrame([(a, b, v) for (a, b), v in total.items()], columns=["a", "b", "part"])

    schema = f"a {kind}, b {kind}, part double"
    parts = session.createDataFrame(single, schema)
    if sizes := [(i, len(starts)) for i, (starts, _, _) in enumerate(larger.value)]:
        walks = session.createDataFrame(sizes, "block long, nodes long").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes") - 1)).alias("place"))
        tasks = min(sum(number for _, number in sizes), WALK_TASKS)
        parts = parts.unionByName(walks.repartition(tasks, "block", "place").mapInPandas(run, schema))
    return parts.groupBy("a", "b").agg((F.sum("part") / max(1, n * (n - 1))).alias("betweenness"))


def bridge_edges(edges: list[tuple]) -> set[tuple]:
    """Edges whose loss parts a component: no way around them reaches a node met earlier in a depth-first walk."""
    near, met, low, out = adjacency(edges), {}, {}, set()
    for root in sorted(near):
        if root in met:
            continue
        met[root] = low[root] = len(met)
        stack = [(root, None, iter(near[root]))]
        while stack:
            n, came, rest = stack[-1]
            x = next(rest, None)
            if x is None:
                stack.pop()
                if came is not None:
                    low[came] = min(low[came], low[n])
                    if low[n] > met[came]:
                        out.add((min(n, came), max(n, came)))
            elif x not in met:
                met[x] = low[x] = len(met)
                stack.append((x, n, iter(near[x])))
            elif x != came:
                low[n] = min(low[n], met[x])
    return out


def node_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree, bridge_score: betweenness of a node's edges by its degree; a loop counts twice in the degree."""
    simple = simple_edges(edges)
    ends = simple.select(F.col("a").alias("node")).unionAll(simple.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    central = edge_betweenness(nodes, edges)
    beside = central.select(F.col("a").alias("node"), "betweenness").unionAll(central.select(F.col("b").alias("node"), "betweenness"))
    sums = beside.groupBy("node").agg(F.sum("betweenness").alias("incident"))
    joined = all_nodes(nodes, edges).join(ends, "node", "left").join(sums, "node", "left")
    score = F.coalesce(F.round(F.col("incident") / F.col("degree"), 2), F.lit(0.0))
    return joined.select("node", F.coalesce("degree", F.lit(0)).alias("degree"), score.alias("bridge_score"))


def summary(nodes: DataFrame, edges: DataFrame) -> dict:
    """The numbers of the whole graph, and DataFrames of its communities. Communities are its components, so no edge
    crosses them."""
    simple = simple_edges(edges)
    e = simple.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).cast("double").alias("w")).first()
    n = all_nodes(nodes, edges).count()
    labels = components(nodes, edges)
    ids = community_ids(labels)
    sizes = ids.groupBy("community").agg(F.max("size").alias("size"))
    cross = simple.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").count()
    bridges = len(bridge_edges(collected_edges(edges)))
    per = lambda x, of: round(x / of, 2) if of else 0.0
    return {
        "node_count": n, "edge_count": e.n, "total_edge_weight": e.w, "average_degree": per(2 * e.n, n), "average_edge_weight": per(e.w, e.n),
        "community_method": "connected_components", "community_ids": ids.select("node", "community").orderBy("node"), "component_count": sizes.count(),
        "component_sizes": sizes.orderBy("community"), "formulas": FORMULAS, "cross_community_edge_count": cross,
        "cross_community_edge_ratio": per(cross, e.n), "bridge_edge_count": bridges, "bridge_edge_ratio": per(bridges, e.n),
    }
