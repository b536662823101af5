"""Queries over hubs: no row for each pair that meets at one, and the results of plain enumeration."""

import random
from collections import Counter

import pytest

from loomgraph.graph import Graph
from loomgraph.operators import algorithms as A
from loomgraph.plans import ops as O


def joined_rows(df):
    """Rows that each of the plan's joins made."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    metrics, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(p.plan())
            continue
        if "Join" in name and p.metrics().contains("numOutputRows"):
            metrics.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return metrics


@pytest.fixture(scope="module")
def star(spark):
    """Two hubs with many leaves, loops and parallel edges; ``v`` has nulls."""
    r = random.Random(4)
    ids = [f"a{i}" for i in range(60)] + ["h0", "h1"]
    nodes = [(x, "Hub" if x[0] == "h" else "Leaf", None if r.random() < 0.1 else r.randrange(12)) for x in ids]
    pairs = [(f"a{i}", f"h{i % 2}") for i in range(60)] + [(f"a{i}", "h1") for i in range(0, 20, 3)] * 2 + [("h0", "h0"), ("h0", "h1"), ("a5", "a5"), ("h1", "a7")]
    edges = [(i, *p, "AB"[i % 3 == 0]) for i, p in enumerate(pairs)]
    return Graph(edges=spark.createDataFrame(edges, "eid long, src string, dst string, type string"), nodes=spark.createDataFrame(nodes, "id string, label string, v long"), edge="eid")


def arms(g, first, second):
    """(r1, a, n, r2, b) of all pairs of steps that meet at n and use two edges."""
    kind = {r.id: (r.label, r.v) for r in g.nodes.collect()}
    out = {"->": [], "<-": [], "--": []}
    for e in g.edges.collect():
        out["->"].append((e.src, e, e.dst))
        out["<-"].append((e.dst, e, e.src))
        out["--"] += [(e.src, e, e.dst)] + [(e.dst, e, e.src)] * (e.src != e.dst)
    return kind, [(e, a, n, f, b) for a, e, n in out[first] for m, f, b in out[second] if m == n and e.eid != f.eid]


@pytest.mark.parametrize(("text", "ways", "test", "group"), [
    ("MATCH (a)-->(n)<--(b) RETURN n.id AS k, count(*) AS c", ("->", "<-"), lambda k, e, a, n, f, b: True, lambda k, n: n),
    ("MATCH (a:Leaf)-[r]-(n)-[s:A]-(b) WHERE a.v > 3 AND r.type = 'A' AND b.v < 9 AND n.label = 'Hub' RETURN n.label AS k, count(*) AS c ORDER BY count(*), k", ("--", "--"), lambda k, e, a, n, f, b: k[a][0] == "Leaf" and (k[a][1] or 0) > 3 and e.type == "A" and f.type == "A" and k[b][1] is not None and k[b][1] < 9 and k[n][0] == "Hub", lambda k, n: k[n][0]),
    ("MATCH (a)-->(n)-->(b) RETURN 1 AS k, count(*) AS c", ("->", "->"), lambda k, e, a, n, f, b: True, lambda k, n: 1),
])
def test_two_steps_are_counted_by_arm(star, text, ways, test, group):
    kind, rows = arms(star, *ways)
    want = {}
    for row in rows:
        if test(kind, *row):
            k = group(kind, row[2])
            want[k] = want.get(k, 0) + 1
    df = star.query(text)
    assert {r.k: r.c for r in df.collect()} == want and df.schema["c"].dataType.simpleString() == "bigint"
    assert max(joined_rows(df)) <= 3 * star.edges.count()


def test_counts_of_two_steps_without_a_match(star):
    assert star.query("MATCH (a:Hub)-->(n:Leaf)-->(b:Hub) WHERE a.v > 100 RETURN count(*) AS c").collect()[0].c == 0
    kind, rows = arms(star, "->", "<-")
    got = star.query("MATCH (a)-->(n)<--(b) WITH n, count(*) AS c WHERE c > 5 MATCH (n)-->(x) RETURN n.id AS k, x.id AS x, c * 2 AS c").collect()
    many = {n: sum(r[2] == n for r in rows) for n in kind}
    assert sorted((r.k, r.x, r.c) for r in got) == sorted((e.src, e.dst, 2 * many[e.src]) for e in star.edges.collect() if many[e.src] > 5)


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "==", "!=", None])
@pytest.mark.parametrize(("left", "right"), [("a", "b"), ("b", "a")])
def test_conditions_between_arms(star, op, left, right):
    steps = {"->": O.e_forward, "<-": O.e_reverse, "--": O.e_undirected}
    ways = ("--", "<-") if left == "a" else ("->", "--")
    own = [O.compare(O.col("n", "id"), "!=", O.col("a", "id"))]
    where = own + ([O.compare(O.col(left, "v"), op, O.col(right, "v"))] if op else [])
    out = star.chain([O.n(name="a"), steps[ways[0]](name="r"), O.n(name="n"), steps[ways[1]](name="s"), O.n({"label": "Leaf"}, name="b")], where=where)
    kind, rows = arms(star, *ways)

    def fits(e, a, n, f, b):
        x, y = (kind[a][1], kind[b][1]) if left == "a" else (kind[b][1], kind[a][1])
        known = x is not None and y is not None
        test = {"<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "==": lambda: x == y, "!=": lambda: x != y}
        return n != a and kind[b][0] == "Leaf" and (op is None or known and test[op]())

    rows = [r for r in rows if fits(*r)]
    want = {k: {r[i] for r in rows} for i, k in ((1, "a"), (2, "n"), (4, "b"))} | {"r": {r[0].eid for r in rows}}
    nodes, edges = out.nodes.collect(), out.edges.collect()
    assert {n.id for n in nodes} == want["a"] | want["n"] | want["b"]
    assert {k: {n.id for n in nodes if n[k]} for k in "anb"} == {k: want[k] for k in "anb"}
    assert {e.eid for e in edges} == want["r"] | {r[3].eid for r in rows}
    assert {e.eid for e in edges if e.r} == want["r"] and {e.eid for e in edges if e.s} == {r[3].eid for r in rows}
    if op == "<":
        assert max(joined_rows(out.nodes)) <= 3 * star.edges.count()


@pytest.fixture
def small_classes(monkeypatch):
    monkeypatch.setattr(A, "FEW", 3)
    monkeypatch.setattr(A, "BLOCK", 4)


@pytest.mark.parametrize("seed", range(2))
def test_pairs_of_neighbours_by_class(spark, small_classes, seed):
    """Classes of twins, hubs, parallel edges, loops and weights against plain counting."""
    r = random.Random(seed)
    edges = [(f"n{i:02}", f"h{i % 3}", 1.0) for i in range(24)] + [(f"n{i:02}", "h0", 2.0) for i in range(0, 24, 5)] + [("h0", "h1", 1.0), ("h1", "h1", 1.0)]
    edges += [(f"m{r.randrange(5)}", f"h{r.randrange(4)}", float(r.randrange(1, 3))) for _ in range(14)]
    g = Graph(edges=spark.createDataFrame(edges, "src string, dst string, w double"))
    got = lambda df: sorted((x.src, x.dst, round(x[2], 9)) for x in df.collect())
    ends = sorted({x for e in edges for x in e[:2]})
    for run, way in ((A.bibcoupling, 0), (A.cocitation, 1)):
        of = {x: Counter(e[1 - way] for e in edges if e[way] == x) for x in ends}
        want = [(a, b, sum(of[a][k] * of[b][k] for k in of[a])) for a in ends for b in ends if a < b]
        assert got(run(g)) == [x for x in want if x[2]]
    weight = {x: {} for x in ends}
    for a, b, w in edges:
        if a != b:
            weight[a][b] = max(weight[a].get(b, 0), w)
            weight[b][a] = max(weight[b].get(a, 0), w)
    found = {k: [] for k in ("jaccard", "overlap", "sorensen", "jaccard_w")}
    for a in ends:
        for b in ends:
            x, y = weight[a], weight[b]
            n = len(x.keys() & y.keys())
            if a < b and n:
                low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
                for k, v in (("jaccard", n / len(x.keys() | y.keys())), ("overlap", n / min(len(x), len(y))), ("sorensen", 2 * n / (len(x) + len(y))), ("jaccard_w", low / (sum(x.values()) + sum(y.values()) - low))):
                    found[k].append((a, b, round(v, 9)))
    for k in ("jaccard", "overlap", "sorensen"):
        assert got(getattr(A, k)(g)) == found[k]
    assert got(A.jaccard_w(g, "w")) == found["jaccard_w"]


def test_pairs_at_a_hub_are_not_joined(spark):
    g = Graph(edges=spark.range(900).selectExpr("'s' || id AS src", "'h' || id % 2 AS dst"))
    df = A.bibcoupling(g)
    assert df.count() == 2 * 450 * 449 // 2 and max(joined_rows(df)) < 900


def test_shortest_paths_make_no_pair_without_one(spark):
    """Either end may be bound before, or both."""
    g = Graph(edges=spark.range(800).filter("id % 4 != 3").selectExpr("id AS eid", "id AS src", "id + 1 AS dst"), nodes=spark.range(800).selectExpr("id", "id % 4 AS turn"), edge="eid")
    df = g.query("MATCH p = shortestPath((a {turn: 0})-[*..2]->(b)) RETURN a.id AS a, b.id AS b, length(p) AS hops")
    want = sorted((i, i + h, h) for i in range(0, 800, 4) for h in (1, 2))
    assert sorted(map(tuple, df.collect())) == want and max(joined_rows(df)) <= 3 * 800
    head = "MATCH (b) WHERE b.turn > 0 "
    for text in (head + "MATCH p = shortestPath((a {turn: 0})-[*..2]->(b))", head + "MATCH p = shortestPath((b)<-[*..2]-(a {turn: 0}))"):
        assert sorted(map(tuple, g.query(text + " RETURN a.id AS a, b.id AS b, length(p) AS hops").collect())) == want
    both = g.query("MATCH (a {turn: 0})-->(m)-->(b) MATCH p = shortestPath((a)-[*..3]->(b)) RETURN a.id AS a, b.id AS b, length(p) AS hops")
    assert sorted(map(tuple, both.collect())) == [w for w in want if w[2] == 2]


def test_hits_rounds_run_over_classes(spark, monkeypatch):
    edges = [(f"c{i:03}", f"n{i % 3 // 2}") for i in range(300)] + [("n0", "r0"), ("n1", "r0"), ("c000", "n1"), ("c000", "n1")] + [("r0", f"z{i}") for i in range(300)]
    sizes, plain = [], A.cut
    monkeypatch.setattr(A, "cut", lambda df: sizes.append((out := plain(df)).count()) or out)
    got = {r.id: (r.hub, r.authority) for r in A.hits(Graph(edges=spark.createDataFrame(edges, "src string, dst string"))).collect()}
    assert sum(n > 50 for n in sizes) <= 8
    hub = {k: 1 / len(got) for k in got}
    for _ in range(100):
        last, auth, new = hub, Counter(), Counter()
        for u, v in edges:
            auth[v] += hub[u]
        whole = sum(auth.values())
        for u, v in edges:
            new[u] += auth[v] / whole
        total = sum(new.values())
        hub = {k: new[k] / total for k in got}
        if sum(abs(hub[k] - last[k]) for k in hub) < 1e-8:
            break
    total = sum(auth.values())
    assert all(abs(got[k][0] - hub[k]) < 1e-9 and abs(got[k][1] - auth[k] / total) < 1e-9 for k in got)
    with pytest.warns(RuntimeWarning, match="hits"):
        g = Graph(edges=spark.createDataFrame(edges, "src string, dst string"))
        one = A.hits(g, most=2).collect()
        monkeypatch.setattr(A, "HERE_EDGES", 0)
        two = {r.id: r for r in A.hits(g, most=2).collect()}
    assert all(abs(r.hub - two[r.id].hub) < 1e-12 and abs(r.authority - two[r.id].authority) < 1e-12 for r in one)


@pytest.mark.parametrize("seed", range(6))
def test_peeled_trees_count_as_brandes(spark, seed):
    """Shares of paths with trees peeled off, against plain Brandes without Spark; a tree leaves no source."""
    r = random.Random(seed)
    n = 14
    edges = {(r.randrange(i), i) for i in range(1, n) if i != 9} | {tuple(sorted(r.sample(range(5), 2))) for _ in range(4 * (seed % 3))}
    near = [sorted({b for a, b in edges if a == i} | {a for a, b in edges if b == i}) for i in range(n)]

    def brandes(ahead, weight):
        node, edge = Counter(), Counter()
        for s in range(n):
            if not ahead[s] or not weight[s]:
                continue
            dist, paths, order = {s: 0}, Counter({s: 1}), [s]
            for u in order:
                for v in ahead[u]:
                    if v not in dist:
                        dist[v] = dist[u] + 1
                        order.append(v)
                    if dist[v] == dist[u] + 1:
                        paths[v] += paths[u]
            share = Counter()
            for v in reversed(order):
                for u in ahead[v]:
                    if dist[u] == dist[v] - 1:
                        part = paths[u] / paths[v] * (weight[v] + share[v])
                        share[u] += part
                        edge[u, v] += part * weight[s]
                if v != s:
                    node[v] += share[v] * weight[s]
        return node, edge

    node, edge = brandes(near, [1] * n)
    left = [list(x) for x in near]
    weight, through, along = A._peeled(left)
    if seed % 3 == 0:
        assert not any(left)
    core = brandes(left, weight)
    assert all(abs(core[0][i] + through[i] - node[i]) < 1e-9 for i in range(n))
    for a, b, x in along:
        core[1][a, b] += x
    assert core[1].keys() == edge.keys() and all(abs(core[1][e] - edge[e]) < 1e-9 for e in edge)
    if seed < 2:
        g = Graph(edges=spark.createDataFrame(sorted(edges), "src long, dst long"))
        assert all(abs(x.v - node[x.id] / 2) < 1e-9 for x in A.betweenness_centrality(g, "v", normalized=False).collect())
        assert {(x.src, x.dst): round(x.v, 9) for x in A.edge_betweenness_centrality(g, "v", normalized=False).collect()} == {e: round(edge[e], 9) for e in edges}


def test_label_rounds_move_numbers(spark, monkeypatch):
    tables, plain = [], A.cut
    monkeypatch.setattr(A, "cut", lambda df: tables.append([f.dataType.simpleString() for f in df.schema]) or plain(df))
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")]
    got = {r.id: r.community for r in A.label_propagation(Graph(edges=spark.createDataFrame(edges, "src string, dst string"))).collect()}
    assert len({got[k] for k in "abc"}) == 1 and got["x"] == got["y"] and sum("string" in t for t in tables) == 1
