"""Hop labels, output slices, wave fronts and the rule for seeds of undirected walks."""

import random

import pytest

from loomgraph.errors import GraphError
from loomgraph.graph import Graph
from loomgraph.plans import ops as O

CHAIN = [("a", "b"), ("b", "c"), ("c", "d")]
BRANCHES = [("a", "b1"), ("b1", "c1"), ("c1", "d1"), ("d1", "e1"), ("a", "b2"), ("b2", "c2")]


def graph(spark, edges):
    return Graph(edges=spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "eid long, s string, d string"), src="s", dst="d", edge="eid")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def shape(out, node=None, edge=None):
    nodes = {r.id: r[node] if node else None for r in out.nodes.collect()}
    edges = {(r.s, r.d): r[edge] if edge else None for r in out.edges.collect()}
    return (nodes if node else set(nodes)), (edges if edge else set(edges))


def test_labels(spark):
    g, at = graph(spark, CHAIN), seeds(spark, "a")
    labels = {"label_node_hops": "hop", "label_edge_hops": "edge_hop"}
    walked = {("a", "b"): 1, ("b", "c"): 2, ("c", "d"): 3}
    assert shape(g.hop(at, min_hops=1, max_hops=3, label_seeds=True, **labels), "hop", "edge_hop") == ({"a": 0, "b": 1, "c": 2, "d": 3}, walked)
    assert shape(g.hop(at, min_hops=3, max_hops=3, output_min_hops=1, label_seeds=True, **labels), "hop", "edge_hop") == ({"a": 0, "b": 1, "c": 2, "d": 3}, walked)
    assert shape(g.hop(at, hops=2, **labels), "hop", "edge_hop") == ({"a": None, "b": 1, "c": 2}, {("a", "b"): 1, ("b", "c"): 2})
    assert shape(g.hop(at, min_hops=2, max_hops=4, output_min_hops=3, output_max_hops=4, label_seeds=True, **labels), "hop", "edge_hop") == ({"a": 0, "c": 2, "d": 3}, {("c", "d"): 3})
    assert shape(g.hop(at, to_fixed_point=True, **labels), "hop", "edge_hop") == ({"a": None, "b": 1, "c": 2, "d": 3}, walked)
    assert shape(graph(spark, [("a", "b"), ("b", "c"), ("c", "a")]).hop(at, min_hops=2, max_hops=3, **labels), "hop", "edge_hop") == ({"a": 3, "b": 1, "c": 2}, {("a", "b"): 1, ("b", "c"): 2, ("c", "a"): 3})
    named = g.with_nodes().replace(nodes=g.with_nodes().nodes.selectExpr("id", "'keep' AS hop"))
    assert {"hop", "hop_1"} <= set(named.hop(at, hops=2, label_node_hops="hop").nodes.columns)


def test_slices(spark):
    g, at = graph(spark, BRANCHES), seeds(spark, "a")
    assert shape(g.hop(at, min_hops=2, max_hops=4, output_min_hops=3, output_max_hops=4, label_edge_hops="h"), None, "h") == ({"c1", "d1", "e1"}, {("c1", "d1"): 3, ("d1", "e1"): 4})
    assert shape(g.hop(at, min_hops=2, max_hops=3, output_min_hops=3, output_max_hops=3)) == ({"c1", "d1"}, {("c1", "d1")})
    assert shape(g.chain([O.n({"id": "a"}), O.e_forward(min_hops=3, max_hops=3, prune_to_endpoints=True), O.n()])) == ({"a", "d1"}, {("a", "b1"), ("b1", "c1"), ("c1", "d1")})
    wire = O.to_json([O.n({"id": "a"}), O.e_forward(min_hops=2, max_hops=2, output_max_hops=5, label_edge_hops="h"), O.n()])
    assert shape(g.chain(wire), None, "h")[1] == {("a", "b1"): 1, ("b1", "c1"): 2, ("a", "b2"): 1, ("b2", "c2"): 2}
    for bad in ({"output_min_hops": 4}, {"output_max_hops": 1}, {"output_min_hops": 3, "output_max_hops": 2}):
        with pytest.raises(GraphError):
            g.hop(at, min_hops=2, max_hops=3, **bad)


def test_wave_fronts(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    front = lambda *s, **k: {r.id for r in g.hop(seeds(spark, *s), return_as_wave_front=True, **k).nodes.collect()}
    assert front("a", hops=2) == {"b", "c"} and front("a", hops=2, direction="undirected") == {"b", "c"}
    assert front("a", "b", hops=1, direction="undirected") == {"a", "b", "c"}
    assert shape(g.hop(seeds(spark, "a"), hops=3, target_wave_front=seeds(spark, "c")))[1] == {("a", "b"), ("b", "c")}


@pytest.mark.parametrize("seed", range(3))
def test_undirected_seeds_by_walks(spark, seed):
    """Seeds that a walk without a repeated edge comes back to, by trying all walks."""
    from loomgraph.plans.traverse import unseen_seeds

    r = random.Random(seed)
    edges = [(r.randrange(8), r.randrange(8)) for _ in range(r.randrange(4, 9))]
    start = set(r.sample(range(8), r.randrange(1, 4)))
    met = set()

    def walk(at, used):
        for i, (u, v) in enumerate(edges):
            if i not in used and at in (u, v):
                to = v if at == u else u
                if to in start:
                    met.add(to)
                walk(to, used | {i})

    for s in start:
        walk(s, frozenset())
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "eid long, u long, v long")
    got = {x.id for x in unseen_seeds(df, spark.createDataFrame([(s,) for s in start], "id long")).collect()}
    assert got == start - met
