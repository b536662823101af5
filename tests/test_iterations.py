"""Iterative queries run until they have settled, or say that they haven't."""

from collections import Counter, defaultdict

import pytest

from loomgraph import queries as graph
from loomgraph.graph import Graph
from loomgraph.operators import algorithms

DATA = "/root/testdata/sf0.001"


def links(spark, edges):
    return Graph(edges=spark.createDataFrame(edges, "src string, dst string"))


def test_hits_equal_plain_iteration(spark):
    edges = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "z"), ("c", "w"), ("d", "w")]
    hub = dict.fromkeys("abcdxyzw", 1 / 8)
    for _ in range(100):
        last, auth, new = hub, Counter(), Counter()
        for u, v in edges:
            auth[v] += hub[u]
        for u, v in edges:
            new[u] += auth[v] / sum(auth.values())
        hub = {k: new[k] / sum(new.values()) for k in hub}
        if sum(abs(hub[k] - last[k]) for k in hub) < 1e-8:
            break
    got = {r[0]: r.hub for r in algorithms.hits(links(spark, edges)).collect()}
    assert all(abs(got[k] - hub[k]) < 1e-9 for k in hub)


def test_rounds_that_run_out_are_reported(spark):
    with pytest.warns(RuntimeWarning, match="hits"):
        algorithms.hits(links(spark, [("a", "x"), ("a", "y"), ("b", "y")]), most=2)
    with pytest.warns(RuntimeWarning, match="pagerank"):
        algorithms.pagerank(links(spark, [("a", "x"), ("x", "y"), ("y", "a"), ("b", "a")]), most=1)


def test_communities_settle(spark):
    near, g = defaultdict(set), graph._nations(spark, DATA)
    label = {r[0]: r.community for r in graph.QUERIES["communities"](spark, DATA).collect()}
    for u, v in algorithms.pairs(g, False, False).collect():
        near[u].add(v)
    for u, others in near.items():
        votes = Counter(label[v] for v in others)
        assert votes[label[u]] == max(votes.values())
