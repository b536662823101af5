"""Row calls with patterns, graphs in query texts, calls by name, inputs of other forms, and validation."""

import math

import pandas as pd
import pyarrow as pa
import pytest

from loomgraph.errors import GraphError
from loomgraph.functions import predicates as P
from loomgraph.graph import Graph
from loomgraph.operators import algorithms as A
from loomgraph.operators import registry
from loomgraph.plans import ops as O
from loomgraph.sources import frames

NODES = [{"id": i, "kind": "ab"[i % 2], "v": i} for i in range(6)]
EDGES = [{"eid": k, "src": a, "dst": b, "w": float(w)} for k, (a, b, w) in enumerate([(0, 1, 1), (1, 2, 2), (2, 0, 1), (3, 4, 5), (4, 5, 1), (2, 3, 1)])]


@pytest.fixture(scope="module")
def g(spark):
    return frames.bind(spark, edges=lambda: EDGES, nodes=pd.DataFrame(NODES), edge="eid")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_pattern_rows(g):
    ab = [O.n(name="a"), O.e_forward(), O.n({"v": P.gt(1)}, name="b")]
    start = O.rows(binding_ops=ab)
    assert rows(g.chain(O.to_json([start])), "a.id", "b.id") == [(1, 2), (2, 3), (3, 4), (4, 5)]
    back = [O.n(name="b"), O.e_forward(), O.n({"kind": "a"}, name="c")]
    want = {(a, b) for a, b in [(1, 2), (2, 3), (3, 4), (4, 5)]}
    onward = {e["src"] for e in EDGES if e["dst"] % 2 == 0}
    assert rows(g.chain([start, O.anti_semi_apply(back, ["b"])]), "a.id", "b.id") == sorted((a, b) for a, b in want if b not in onward)
    assert rows(g.chain([start, O.semi_apply_mark(back, ["b"], "on")]), "a.id", "b.id", "on") == sorted((a, b, b in onward) for a, b in want)
    assert rows(g.chain([start, O.join_apply(back, ["b"])]), "a.id", "b.id", "c.id") == sorted((a, b, e["dst"]) for a, b in want for e in EDGES if e["src"] == b and e["dst"] % 2 == 0)
    assert rows(g.chain([O.rows("edges", alias_endpoints={"s": "src", "t": "dst"}), O.select([("x", "s.v"), ("y", "t.kind")])]), "x", "y") == sorted((e["src"], "ab"[e["dst"] % 2]) for e in EDGES)
    assert rows(g.chain([start, O.order_by([("b.id", "desc")]), O.group_by([], [("all", "collect", "b.id"), ("kinds", "collect_distinct", "b.kind")])]), "all", "kinds") == [([5, 4, 3, 2], ["b", "a"])]


def test_graphs_in_texts(g):
    out = g.query("GRAPH big = GRAPH { MATCH (a)-[r]->(b) WHERE a.v > 0 AND b.v > 0 } USE big MATCH (x)-->(y) RETURN x.id AS x, y.id AS y")
    assert rows(out, "x", "y") == [(1, 2), (2, 3), (3, 4), (4, 5)]
    built = g.query("GRAPH { MATCH (a)-->(b) WHERE a.kind = 'a' CALL graph.degree.write() }")
    assert rows(built.nodes, "id", "degree") == [(0, 2), (1, 1), (2, 2), (3, 1), (4, 1), (5, 1)] and isinstance(built, Graph)
    assert rows(g.query("CALL graph.clusters.write()").nodes, "id", "component") == [(i, 0) for i in range(6)]
    for bad in ("GRAPH { MATCH (a)-->(b) WHERE a.v < b.v }", "GRAPH { MATCH (a) RETURN a }", "GRAPH { CALL graph.degree() }", "USE nowhere MATCH (a) RETURN a.id AS i", "GRAPH { }"):
        with pytest.raises(GraphError):
            g.query(bad)


def test_calls_by_name(g):
    done = g.chain([O.call("compute_igraph", {"alg": "pagerank", "out_col": "pr", "params": {"most": 200}}), O.call("encode_point_color", {"column": "pr", "palette": ["red"]}), O.call("name", {"name": "n"}), O.call("description", {"description": "d"}), O.call("encode_axis", {"rows": [{"r": 1}]})])
    assert "pr" in done.nodes.columns and done.settings == {"encode_point_color": {"column": "pr", "palette": ["red"]}, "name": "n", "description": "d", "axis": [{"r": 1}]}
    with pytest.raises(GraphError):
        g.chain([O.call("encode_edge_size", {"column": "nope"})])
    h = g.chain([O.call("hypergraph", {"entity_types": ["src", "dst"], "event_id": "eid", "opts": {"CATEGORIES": {"n": ["src", "dst"]}}, "drop_edge_attrs": False})])
    assert h.edges.count() == 12 and h.nodes.filter("type = 'n'").count() == 6 and "w" in h.edges.columns
    m = g.chain([O.call("modularity_weighted_layout", {"community_col": "kind"})])
    assert rows(m.edges, "src", "dst", "weight") == sorted((e["src"], e["dst"], 2.0 if (e["src"] - e["dst"]) % 2 == 0 else 0.3) for e in EDGES)
    assert registry.known("fa2") is False


def test_other_forms(spark, g):
    assert rows(frames.table_of(spark, pa.table({"x": [1, 2]})), "x") == [(1,), (2,)]
    nodes, edges = frames.to_arrow(g)
    assert nodes.num_rows == 6 and edges.num_rows == 6

    class Net:
        def nodes(self, data):
            return [("a", {"x": 1}), ("b", {})]

        def edges(self, data):
            return [("a", "b", {"w": 2.0})]

    net = frames.from_networkx(spark, Net())
    assert {r.id: r.x for r in net.nodes.collect()} == {"a": 1, "b": None}
    assert rows(net.edges, "src", "dst", "w") == [("a", "b", 2.0)]


def test_validation(g):
    assert g.validate([O.n({"v": P.gt(1)}), O.e_forward(), O.n()]) == [] and g.validate("MATCH (a) RETURN a.id AS i") == []
    for bad in ([O.n({"nope": 1})], [O.n(), O.n()], [O.e_forward(min_hops=3, max_hops=1)], [O.call("nope")], "MATCH (a RETURN", "CREATE (a)", {"chain": [{"type": "Nope"}]}):
        (problem,) = g.validate(bad)
        assert problem["code"].startswith("E")


def test_paths_and_communities(g):
    n = 6
    near = {i: set() for i in range(n)}
    for e in EDGES:
        near[e["src"]].add(e["dst"])
        near[e["dst"]].add(e["src"])

    def all_shortest(s, t):
        dist, layers = {s: 0}, [[s]]
        while layers[-1]:
            layers.append(sorted({v for u in layers[-1] for v in near[u] if v not in dist}))
            dist |= {v: len(layers) - 1 for v in layers[-1]}
        def back(v):
            return [[v]] if v == s else [[*p, v] for u in near[v] if dist[u] == dist[v] - 1 for p in back(u)]
        return back(t)

    node, edge = dict.fromkeys(range(n), 0.0), {}
    for s in range(n):
        for t in range(s + 1, n):
            paths = all_shortest(s, t)
            for p in paths:
                for v in p[1:-1]:
                    node[v] += 1 / len(paths)
                for a, b in zip(p, p[1:], strict=False):
                    edge[min(a, b), max(a, b)] = edge.get((min(a, b), max(a, b)), 0) + 1 / len(paths)
    got = dict(rows(A.betweenness_centrality(g, "x"), "id", "x"))
    assert all(math.isclose(got[v], node[v] * 2 / 20) for v in node)
    got = {(a, b): x for a, b, x in rows(A.edge_betweenness_centrality(g, "x"), "src", "dst", "x")}
    assert got.keys() == edge.keys() and all(math.isclose(got[e], edge[e] / 15) for e in edge)
    assert rows(A.bfs_edges(g, 0), "src", "dst") == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert rows(A.sssp(g, 0, "w"), "id", "distance") == [(0, 0.0), (1, 1.0), (2, 3.0), (3, 4.0), (4, 9.0), (5, 10.0)]
    weights = {(0, 1): 1, (1, 2): 2, (0, 2): 1, (3, 4): 5, (4, 5): 1, (2, 3): 1}
    w = lambda a, b: weights.get((min(a, b), max(a, b)), 0)
    for r in A.jaccard_w(g, "w").collect():
        low = sum(min(w(r.src, k), w(r.dst, k)) for k in range(n))
        assert math.isclose(r.jaccard_coeff, low / (sum(w(r.src, k) for k in range(n)) + sum(w(r.dst, k) for k in range(n)) - low))
    for run in (A.louvain, A.leiden):
        got = dict(rows(run(g), "id", "community"))
        assert len({got[0], got[1], got[2]}) == 1 and got[3] == got[4] == got[5] != got[0]
    assert A.modularity(g, A.louvain(g)) > 0.3


def test_named_steps_on_the_wire(g):
    wire = {"type": "Let", "bindings": {"late": {"type": "Chain", "chain": [{"type": "Node", "filter_dict": {"v": {"type": "GE", "val": 1}}}, {"type": "Edge", "direction": "forward"}, {"type": "Node"}]}, "ends": {"type": "Ref", "ref": "late", "chain": [{"type": "Node", "filter_dict": {"kind": "a"}}]}}}
    assert rows(g.query(wire).nodes, "id") == [(0,), (2,), (4,)]


def test_policies(g):
    seen = []
    ruled = g.replace(policy={"pre": lambda c: seen.append(c["phase"]), "postchain": lambda c: seen.append(c["phase"])})
    ruled.chain([O.n({"v": 1}), O.rows(), O.limit(1)])
    ruled.query("MATCH (a) RETURN a.id AS i")
    assert seen == ["prechain", "precall", "precall", "postchain", "precompile"]

    def deny(context):
        raise GraphError(f"{context['function']} isn't allowed")

    with pytest.raises(GraphError, match="limit"):
        g.replace(policy={"precall": lambda c: deny(c) if c["function"] == "limit" else None}).chain([O.rows(), O.limit(1)])


def test_conditional_graph(g):
    out = g.chain([O.call("conditional_graph", {"x": "id", "given": "kind"})])
    assert {(r.src, r.dst): round(r.probs, 6) for r in out.edges.collect()} == {("ab"[i % 2], str(i)): round(1 / 3, 6) for i in range(6)}
