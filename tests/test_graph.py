import itertools
import random

import pytest

from strataquery.operators import graph


def frames(spark, edges, nodes=()):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "source string, target string, weight double")


def sizes(summary):
    return [r["size"] for r in summary["component_sizes"].collect()]


def scores(nodes, edges):
    return {r.node: r.bridge_score for r in graph.node_scores(nodes, edges).collect()}


def test_two_edges(spark):
    nodes, edges = frames(spark, [("a", "b", 2.0), ("b", "c", 1.0)])
    got = graph.summary(nodes, edges)
    assert (got["average_degree"], got["average_edge_weight"], sizes(got), got["bridge_edge_count"], got["cross_community_edge_count"]) == (1.33, 1.5, [3], 2, 0)


def test_parallel_edges_are_one(spark):
    nodes, edges = frames(spark, [("a", "b", 2.0), ("b", "a", 1.0)])
    got = graph.summary(nodes, edges)
    assert (got["edge_count"], got["total_edge_weight"]) == (1, 3.0)
    assert scores(nodes, edges) == {"a": 1.0, "b": 1.0}


@pytest.mark.parametrize("order", [0, 1])
def test_path_beside_an_isolated_node(spark, order):
    rows = [("a", "b", 1.0), ("c", "b", 1.0), ("c", "d", 1.0)]
    assert scores(*frames(spark, rows[::-1] if order else rows, ["isolated", "a"])) == {"a": 0.3, "b": 0.35, "c": 0.35, "d": 0.3, "isolated": 0.0}


def test_empty_and_isolated(spark):
    got = graph.summary(*frames(spark, []))
    assert (got["node_count"], got["average_degree"], sizes(got), got["bridge_edge_ratio"]) == (0, 0.0, [], 0.0)
    assert sizes(graph.summary(*frames(spark, [], ["x"]))) == [1]


def test_communities_are_numbered_by_their_smallest_node(spark):
    nodes, edges = frames(spark, [(f"n{i:03}", f"n{i + 100:03}", 1.0) for i in range(100)])
    ids = {r.node: (r.community, r.size) for r in graph.community_ids(graph.components(nodes, edges)).collect()}
    assert ids == {f"n{i:03}": (i % 100, 2) for i in range(200)}


def test_bridges_and_components_against_brute_force(spark):
    draw = random.Random(3)
    pairs = sorted(draw.sample(list(itertools.combinations("abcdefghijklmn", 2)), 16))

    def parts(edges):
        found = {n: {n} for e in pairs for n in e}
        for a, b in edges:
            if found[a] is not found[b]:
                found[a] |= found[b]
                for n in found[b]:
                    found[n] = found[a]
        return {n: min(s) for n, s in found.items()}

    assert graph.bridge_edges(pairs) == {e for e in pairs if len(set(parts([x for x in pairs if x != e]).values())) > len(set(parts(pairs).values()))}
    nodes, edges = frames(spark, [(a, b, 1.0) for a, b in pairs])
    assert {r.node: r.label for r in graph.components(nodes, edges).collect()} == parts(pairs)


def betweenness_by_paths(nodes, pairs):
    """All shortest paths of all pairs of nodes, written out."""
    near = graph.adjacency(pairs)
    total = dict.fromkeys(pairs, 0.0)
    for s, t in itertools.combinations(sorted(nodes), 2):
        paths, done = [[s]], []
        while paths and not done:
            paths = [[*p, x] for p in paths for x in near.get(p[-1], ()) if x not in p]
            done = [p for p in paths if p[-1] == t]
        for p in done:
            for a, b in itertools.pairwise(p):
                total[min(a, b), max(a, b)] += 1 / len(done)
    return {e: v * 2 / (len(nodes) * (len(nodes) - 1)) for e, v in total.items()}


@pytest.mark.parametrize("seed", range(4))
def test_betweenness_against_all_paths(spark, seed):
    draw = random.Random(seed)
    names = "abcdefghijk"
    pairs = sorted(draw.sample(list(itertools.combinations(names, 2)), 8 + 2 * seed))
    nodes, edges = frames(spark, [(b, a, 1.0) for a, b in pairs] + [("a", "a", 1.0)], names)
    got = {(r.a, r.b): r.betweenness for r in graph.edge_betweenness(nodes, edges).collect()}
    assert got == pytest.approx(betweenness_by_paths(names, pairs))


def test_blocks_and_what_hangs_at_their_nodes():
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("x", "y")]
    found = {tuple(sorted(weight)): weight for _, weight in zip(*graph.blocks(pairs), strict=True)}
    assert found == {
        ("a", "b", "c"): {"a": 1, "b": 1, "c": 4}, ("c", "d"): {"c": 3, "d": 3}, ("d", "e"): {"d": 5, "e": 1}, ("d", "f"): {"d": 5, "f": 1}, ("x", "y"): {"x": 1, "y": 1},
    }


def test_betweenness_of_a_large_tree_and_a_long_path(spark):
    n = 30_000
    path = [(f"p{i:05}", f"p{i + 1:05}", 1.0) for i in range(n - 1)]
    nodes, edges = frames(spark, path)
    got = {r.a: r.betweenness for r in graph.edge_betweenness(nodes, edges).collect()}
    assert got == pytest.approx({a: 2 * (i + 1) * (n - 1 - i) / (n * (n - 1)) for i, (a, _, _) in enumerate(path)})
