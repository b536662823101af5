"""Chains on small random graphs against an enumeration of walks in plain Python."""

import random

import pytest

from loomgraph.functions import predicates as P
from loomgraph.graph import Graph
from loomgraph.plans import ops as O


def brute(nodes, edges, steps):
    """Edge ids and node ids of all matching paths; steps: (test, direction, low, high, test)."""
    first, rest = steps[0], steps[1:]
    keep_nodes, keep_edges = set(), set()

    def out(v, direction):
        for eid, (s, d) in edges.items():
            if direction != "reverse" and s == v:
                yield eid, d
            if direction != "forward" and d == v and (direction == "reverse" or s != d):
                yield eid, s

    def go(v, left, seen_nodes, seen_edges):
        if not left:
            keep_nodes.update(seen_nodes)
            keep_edges.update(seen_edges)
            return
        direction, low, high, test = left[0]
        walks = [(v, (), ())]
        for h in range(high + 1):
            for at, es, vs in walks:
                if h >= low and test(nodes[at]):
                    go(at, left[1:], seen_nodes | set(vs) | {at}, seen_edges | set(es))
            walks = [(d, (*es, e), (*vs, at)) for at, es, vs in walks for e, d in out(at, direction)]

    for v, value in nodes.items():
        if first(value):
            go(v, rest, {v}, set())
    return keep_nodes, keep_edges


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = {i: r.randrange(4) for i in range(7)}
    edges = {i: (r.randrange(7), r.randrange(7)) for i in range(11)}
    g = Graph(nodes=spark.createDataFrame(list(nodes.items()), "id long, v long"), edges=spark.createDataFrame([(k, *e) for k, e in edges.items()], "eid long, src long, dst long"), edge="eid")
    make = {"forward": O.e_forward, "reverse": O.e_reverse, "undirected": O.e_undirected}
    for direction, low, high in (("forward", 1, 1), ("reverse", 1, 2), ("undirected", 1, 1), ("forward", 2, 3)):
        chain = [O.n({"v": P.gt(0)}), make[direction](min_hops=low, max_hops=high), O.n({"v": P.le(2)})]
        out = g.chain(chain)
        want = brute(nodes, edges, [lambda v: v > 0, (direction, low, high, lambda v: v <= 2)])
        assert ({x.id for x in out.nodes.collect()}, {x.eid for x in out.edges.collect()}) == want, (direction, low, high)


def test_names_wire_form_and_rows(spark):
    g = Graph(edges=spark.createDataFrame([("a", "b"), ("b", "c"), ("a", None)], "src string, dst string"))
    ops = [O.n({"id": "a"}), O.e_forward(name="first"), O.n(name="end"), O.rows(source="end"), O.select([("x", "id")])]
    assert O.to_json(O.from_json(O.to_json(ops))) == O.to_json(ops)
    assert [r.x for r in g.chain(O.to_json(ops)).collect()] == ["b"]
    assert g.prune_self_edges().edges.count() == 3
