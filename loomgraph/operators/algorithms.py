"""Graph algorithms as joins and aggregations; loops cut their lineage each round.

Each function takes a graph and gives a DataFrame keyed by its node column, or
(for edge measures) by source and destination, or a graph.
"""

from __future__ import annotations

import math
import warnings
from collections import defaultdict, deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import GraphError, Unsupported
from loomgraph.plans.cypher import multi_source
from loomgraph.plans.storage import cut

#: Edges that an algorithm without a distributed form takes; it runs in one place.
SINGLE_TASK_EDGES = 2_000_000


def pairs(g, directed: bool = True, loops: bool = True) -> DataFrame:
    """(u, v) of all edges; undirected: both ways, once each."""
    one = g.edges.select(F.col(f"`{g.src}`").alias("u"), F.col(f"`{g.dst}`").alias("v"))
    if not loops:
        one = one.filter("u != v")
    return one if directed else one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def vertices(g) -> DataFrame:
    g = g.with_nodes()
    return g.nodes.select(F.col(f"`{g.node}`").alias("id"))


def named(g, df: DataFrame, out: str) -> DataFrame:
    return df.select(F.col("id").alias(g.node), F.col("value").alias(out))


def _unsettled(name: str, most: int) -> None:
    warnings.warn(f"{name}: not converged in {most} rounds; the result is that of the last", RuntimeWarning, stacklevel=3)


def connected_components(g, out: str = "component") -> DataFrame:
    """The least node id of each weakly connected component, by alternating large and small stars."""
    edges = cut(pairs(g, loops=False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        # Stars: each node has one edge to a lesser one, and none leads on from there.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("value"))
    return named(g, vertices(g).join(found, "id", "left").withColumn("value", F.coalesce("value", "id")), out)


def pagerank(g, out: str = "pagerank", alpha: float = 0.85, tol: float = 1e-6, most: int = 100, personalization: DataFrame | None = None, directed: bool = True) -> DataFrame:
    """Power iteration with the mass of nodes without a way out spread by the reset vector; stops at n * tol in L1."""
    nodes = cut(vertices(g))
    n = nodes.count()
    if not n:
        return named(g, nodes.withColumn("value", F.lit(0.0)), out)
    edges = pairs(g, directed)
    degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    edges = cut(edges.join(degree, "u"))
    if personalization is None:
        state = nodes.withColumn("reset", F.lit(1.0 / n))
    else:
        total = personalization.agg(F.sum(personalization.columns[1])).first()[0]
        given = personalization.toDF("id", "w")
        state = nodes.join(given, "id", "left").select("id", (F.coalesce("w", F.lit(0)) / total).alias("reset"))
    state = cut(state.join(degree.select(F.col("u").alias("id"), F.lit(True).alias("out")), "id", "left").withColumn("value", F.lit(1.0 / n)))
    lost = state.filter("out IS NULL").count() / n
    for _ in range(most):
        flow = edges.join(state.select(F.col("id").alias("u"), "value"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("value") / F.col("d")).alias("got"))
        new = alpha * (F.coalesce("got", F.lit(0.0)) + lost * F.col("reset")) + (1 - alpha) * F.col("reset")
        state = cut(state.join(flow, "id", "left").select("id", "reset", "out", F.col("value").alias("old"), new.alias("value")))
        # One pass for the change and for the next round's mass of nodes without a way out.
        change, lost = state.agg(F.sum(F.abs(F.col("value") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("value"))), F.lit(0.0))).first()
        if change < n * tol:
            break
    else:
        _unsettled("pagerank", most)
    return named(g, state, out)


def hits(g, hub: str = "hub", authority: str = "authority", tol: float = 1e-8, most: int = 100) -> DataFrame:
    """Hub and authority scores, each with the sum 1; stops where the hubs change by less than ``tol`` in L1."""
    nodes = vertices(g)
    n = nodes.count() or 1
    # Nodes with equal edges out have equal hub scores, those with equal edges in equal authorities: the rounds run over classes.
    both = pairs(g).filter("v IS NOT NULL").join(nodes.select(F.col("id").alias("u")), "u", "left_semi")
    both = cut(both.groupBy("u", "v").agg(F.count(F.lit(1)).alias("w")))
    heads, tails = twins(both), twins(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    sized = lambda x, end: x.groupBy(F.col("c").alias(end)).agg(F.count(F.lit(1)).alias(f"n{end}"))
    few = both
    for x, end in ((heads, "u"), (tails, "v")):
        few = few.join(sized(x, end), end)
    few = cut(few.select("u", "v", F.col("w").cast("double").alias("w"), "nu", "nv"))
    state, found, settled = (_hits_here if few.count() <= HERE_EDGES else _hits_rounds)(few, n, tol, most)
    if not settled:
        _unsettled("hits", most)
    scores = nodes
    for x, end, column, values in ((heads, "u", "h", state), (tails, "v", "a", found)):
        each = x.join(values.select(F.col(end).alias("c"), column), "c").select(F.col("u").alias("id"), column)
        scores = scores.join(each, "id", "left").withColumn(column, F.coalesce(column, F.lit(0.0)))
    scores = cut(scores)
    sums = scores.agg(F.sum("h"), F.sum("a")).first()
    return scores.select(F.col("id").alias(g.node), (F.col("h") / (sums[0] or 1.0)).alias(hub), (F.col("a") / (sums[1] or 1.0)).alias(authority))


def _hits_here(few: DataFrame, n: int, tol: float, most: int):
    """The rounds of ``hits`` over the edges of few classes (u, v, w, nu, nv), in the driver: (u, h), (v, a), settled."""
    t = few.toArrow()
    (heads, u), (tails, v) = ((x.dictionary, x.indices.to_numpy()) for x in (t[c].combine_chunks().dictionary_encode() for c in "uv"))
    w = t["w"].to_numpy()
    nu, nv = np.zeros(len(heads)), np.zeros(len(tails))
    nu[u], nv[v] = t["nu"].to_numpy(), t["nv"].to_numpy()
    h, a = np.full(len(heads), 1.0 / n), np.zeros(len(tails))
    lost, settled = 1.0 - nu.sum() / n, False
    for _ in range(most):
        a = np.bincount(v, h[u] * w * nu[u], len(tails))
        a = a / ((a * nv).sum() or 1.0)
        new = np.bincount(u, a[v] * w * nv[v], len(heads))
        new = new / ((new * nu).sum() or 1.0)
        change, lost, h = (np.abs(new - h) * nu).sum() + lost, 0.0, new
        if settled := bool(change < tol):
            break
    spark = few.sparkSession
    frame = lambda names, x, column: spark.createDataFrame(pa.table([names, pa.array(x)], names=column), few.select(column[0]).schema.add(column[1], "double"))
    return frame(heads, h, ["u", "h"]), frame(tails, a, ["v", "a"]), settled


def _hits_rounds(few: DataFrame, n: int, tol: float, most: int):
    """As ``_hits_here``, distributed."""
    # ``state`` (u, nu, h): only nodes with an edge out; the others' fall to 0 is part of the first change.
    state = cut(few.select("u", "nu").distinct().withColumn("h", F.lit(1.0 / n)))
    lost = 1.0 - (state.agg(F.sum("nu")).first()[0] or 0) / n
    found = cut(few.select("v", "nv").distinct().withColumn("a", F.lit(0.0)))
    for _ in range(most):
        a = cut(few.join(state.select("u", "h"), "u").groupBy("v", "nv").agg(F.sum(F.col("h") * F.col("w") * F.col("nu")).alias("a")))
        total = a.agg(F.sum(F.col("a") * F.col("nv"))).first()[0] or 1.0
        found = a.withColumn("a", F.col("a") / total)
        h = few.join(found.select("v", "a"), "v").groupBy("u").agg(F.sum(F.col("a") * F.col("w") * F.col("nv")).alias("new"))
        new = cut(state.join(h, "u").select("u", "nu", F.col("h").alias("old"), F.col("new").alias("h")))
        total = new.agg(F.sum(F.col("h") * F.col("nu"))).first()[0] or 1.0
        state = new.withColumn("h", F.col("h") / total)
        change, lost = (state.agg(F.sum(F.abs(F.col("h") - F.col("old")) * F.col("nu"))).first()[0] or 0.0) + lost, 0.0
        if change < tol:
            break
        state = state.select("u", "nu", "h")
    else:
        return state, found, False
    return state, found, True


def _power(g, out, step, most, tol, directed):
    edges, nodes = cut(pairs(g, directed)), vertices(g)
    n = nodes.count() or 1
    state = cut(nodes.withColumn("value", F.lit(1.0 / n)))
    for _ in range(most):
        flow = edges.join(state.select(F.col("id").alias("u"), "value"), "u").groupBy(F.col("v").alias("id")).agg(F.sum("value").alias("got"))
        new = state.join(flow, "id", "left").select("id", F.col("value").alias("old"), step(F.col("value"), F.coalesce("got", F.lit(0.0))).alias("value"))
        norm = math.sqrt(new.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 1.0) if step is not _katz_step else 1.0
        state = cut(new.withColumn("value", F.col("value") / norm))
        if state.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0] < n * tol:
            break
    return state


def eigenvector_centrality(g, out: str = "eigenvector_centrality", most: int = 100, tol: float = 1e-6, directed: bool = False) -> DataFrame:
    return named(g, _power(g, out, lambda old, got: old + got, most, tol, directed), out)


def _katz_step(old, got, alpha=0.1, beta=1.0):
    return got * alpha + beta


def katz_centrality(g, out: str = "katz_centrality", most: int = 1000, tol: float = 1e-6, directed: bool = True) -> DataFrame:
    state = _power(g, out, _katz_step, most, tol, directed)
    norm = math.sqrt(state.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 1.0)
    return named(g, state.withColumn("value", F.col("value") / norm), out)


def degree_centrality(g, out: str = "degree_centrality") -> DataFrame:
    nodes = g.get_degrees("value").nodes
    n = max(1, nodes.count() - 1)
    return nodes.select(F.col(f"`{g.node}`"), (F.col("value") / n).alias(out))


def core_number(g, out: str = "core_number") -> DataFrame:
    """Iterative peeling: for each k the nodes of a lesser degree go, until none does."""
    edges, nodes = cut(pairs(g, False, False)), vertices(g)
    left, done, k = cut(nodes), None, 0
    while not left.isEmpty():
        degree = edges.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("d"))
        now = left.join(degree, "id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
        gone = cut(now.filter(F.col("d") <= k).select("id", F.lit(k).alias("value")))
        if gone.isEmpty():
            k = max(k + 1, now.agg(F.min("d")).first()[0])
            continue
        done = gone if done is None else done.unionByName(gone)
        left = cut(left.join(gone, "id", "left_anti"))
        for end in ("u", "v"):
            edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        edges = cut(edges.select("u", "v"))
    return named(g, done if done is not None else nodes.withColumn("value", F.lit(0)), out)


def k_core(g, k: int = 2):
    chosen = core_number(g, "__core").filter(F.col("__core") >= k).select(g.node)
    return g.keep_nodes(chosen)


def label_propagation(g, out: str = "community", most: int = 100) -> DataFrame:
    """Each node takes its neighbours' most frequent label, its own or else the least of equals, until none would change.

    Each round half of the nodes may change, by hash of id and round: neighbours that change at once swap labels for ever.
    """
    # Numbers in the order of the ids stand for them, so that rounds move numbers; a bit for each round says whose turn it is.
    numbers = cut(vertices(g).orderBy("id").select("id", F.monotonically_increasing_id().alias("k")))
    edges = pairs(g, False, False)
    for end in ("u", "v"):
        edges = edges.join(numbers.select(F.col("id").alias(end), F.col("k").alias(f"k{end}")), end)
    edges = cut(edges.select(F.col("ku").alias("u"), F.col("kv").alias("v")))
    turns = [reduce(Column.bitwiseOR, [F.when(F.xxhash64("id", F.lit(i)) % 2 == 0, F.lit(1 << (i - k)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(k, min(k + 32, most))]).alias(f"t{k}") for k in range(0, most, 32)]
    state = cut(numbers.select("k", F.col("k").alias("value"), *turns))
    masks = state.columns[2:]
    for i in range(most):
        votes = edges.join(state.select(F.col("k").alias("v"), "value"), "v").select("u", "value", F.lit(1).cast("long").alias("n"), F.lit(False).alias("own"))
        votes = votes.unionByName(state.select(F.col("k").alias("u"), "value", F.lit(0).cast("long").alias("n"), F.lit(True).alias("own")))
        votes = votes.groupBy("u", "value").agg(F.sum("n").alias("n"), F.bool_or("own").alias("own"))
        # The greatest count, and of equals the least label.
        won = votes.groupBy(F.col("u").alias("k")).agg(F.max(F.struct("n", (-F.col("value")).alias("label"))).alias("top"), F.max(F.when(F.col("own"), F.col("n"))).alias("mine"))
        won = won.select("k", F.when(F.col("top.n") > F.col("mine"), -F.col("top.label")).alias("new"))
        turn = F.col(masks[i // 32]).bitwiseAND(1 << (i % 32)) != 0
        state = cut(state.select("k", "value", *masks).join(won, "k").select("k", F.when(turn, F.coalesce("new", "value")).otherwise(F.col("value")).alias("value"), *masks, F.col("new").isNotNull().alias("wants")))
        if state.filter("wants").isEmpty():
            break
    else:
        _unsettled("label_propagation", most)
    label = numbers.select(F.col("id").alias("label"), F.col("k").alias("value"))
    return named(g, state.select("k", "value").join(label, "value").join(numbers, "k").select("id", F.col("label").alias("value")), out)


#: Edges between classes at most for rounds in the driver.
HERE_EDGES = 100_000
#: Nodes with so many neighbours at most are grouped by all of them; a node with so many in all makes grouping worth while.
FEW = 64
#: Members of a class in a block, and pairs of a task that puts members together.
BLOCK, TASK_PAIRS = 512, 1 << 21


def twins(near: DataFrame) -> DataFrame:
    """(u, c) of edges (u, v, ...) without repeats: nodes whose rows are alike but for ``u`` have one class, named by the least.

    Exact; a node with more than FEW rows is a class of its own, so that no list is long.
    """
    degree = near.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    rest = [x for x in near.columns if x != "u"]
    light = near.join(degree.filter(F.col("d") <= FEW), "u", "left_semi").groupBy("u").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("all"))
    light = cut(light)
    named_ = light.groupBy("all").agg(F.min("u").alias("c"))
    return cut(light.join(named_, "all").select("u", "c").unionByName(degree.filter(F.col("d") > FEW).select("u", F.col("u").alias("c"))))


def _met(near: DataFrame, combined, size=None, formula=None, out: str = "value", whole=None) -> DataFrame:
    """(a, b, out) of pairs a < b that share a ``v`` of ``near`` (u, v, w): ``combined(wa, wb)`` over these, or ``formula(that, size a, size b)``.

    Nodes with equal neighbours have equal values with all others, so pairs are counted for classes of such nodes and then
    spread to their members, block by block: a pair is then made in one place, and isn't shuffled or aggregated.
    ``whole``: takes repeated (u, v) together, where classes are made.
    """
    hubs = near.groupBy("v").agg(F.count(F.lit(1)).alias("d")).agg(F.max("d"), F.sum(F.col("d").cast("double") * F.col("d"))).first()
    grouped = (hubs[0] or 0) > FEW
    near = cut(whole(near)) if grouped and whole else near
    members = twins(near) if grouped else None
    few = cut(near.join(members.select(F.col("c").alias("u")).distinct(), "u", "left_semi").select("u", "v", "w")) if grouped else near
    sides = [few.select(F.col("u").alias(x), "v", F.col("w").alias(f"w{x}")) for x in "ab"]
    found = sides[0].join(sides[1], "v").filter("a <= b" if grouped else "a < b").groupBy("a", "b").agg(combined(F.col("wa"), F.col("wb")).alias(out))
    if formula is not None:
        sizes = few.groupBy("u").agg(size.alias("s"))
        found = found.join(sizes.select(F.col("u").alias("a"), F.col("s").alias("sa")), "a").join(sizes.select(F.col("u").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", formula(F.col(out), F.col("sa"), F.col("sb")).alias(out))
    if not grouped:
        return found
    many = cut(members.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    marks = {x: many.select(F.col("c").alias(x), F.col("n").alias(f"n{x}")) for x in "ab"}
    found = cut(found.join(marks["a"], "a", "left").join(marks["b"], "b", "left").filter("a != b OR na > 1"))
    lone = found.filter("na IS NULL AND nb IS NULL").select("a", "b", out)
    block = F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / BLOCK)).alias("k")
    blocks = cut(members.join(many, "c", "left").select("u", "c", F.coalesce(block, F.lit(0)).alias("k")).groupBy("c", "k").agg(F.collect_list("u").alias("us")))
    one, two = (blocks.select(F.col("c").alias(x), F.col("k").alias(f"k{x}"), F.col("us").alias(f"u{x}")) for x in "ab")
    tasks = max(1, min(4096, math.ceil((hubs[1] or 0) / 2 / TASK_PAIRS)))
    both = found.filter("na IS NOT NULL OR nb IS NOT NULL").join(one, "a").join(two, "b").filter("a != b OR ka <= kb").repartition(tasks, "a", "b", "ka", "kb")
    spread = both.select("a", "b", "ka", "kb", out, "ub", F.explode("ua").alias("x")).select("a", "b", "ka", "kb", out, "x", F.explode("ub").alias("y"))
    # Two of one class once: within a block the lesser first; of two blocks, all.
    spread = spread.filter("a != b OR ka != kb OR x < y")
    return lone.unionByName(spread.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), out))


def _similarity(formula, name):
    def run(g, out: str = name, directed: bool = False, digits: int | None = None) -> DataFrame:
        shape = formula if digits is None else lambda n, a, b: F.round(formula(n, a, b), digits)
        near = cut(pairs(g, directed, False).distinct().withColumn("w", F.lit(1)))
        return _met(near, lambda a, b: F.count(F.lit(1)), F.count(F.lit(1)), shape, out).select(F.col("a").alias(g.src), F.col("b").alias(g.dst), out)

    run.__doc__ = f"{name} of the neighbourhoods of all node pairs that share a neighbour (source < destination); ``digits``: rounded."
    return run


jaccard = _similarity(lambda n, a, b: n / (a + b - n), "jaccard_coeff")
overlap = _similarity(lambda n, a, b: n / F.least(a, b), "overlap_coeff")
sorensen = _similarity(lambda n, a, b: 2 * n / (a + b), "sorensen_coeff")


def _coupled(g, u: str, v: str, out: str) -> DataFrame:
    near = pairs(g).filter("u IS NOT NULL AND v IS NOT NULL").select(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(1).cast("long").alias("w"))
    return _met(near, lambda a, b: F.sum(a * b), out=out, whole=lambda e: e.groupBy("u", "v").agg(F.sum("w").alias("w"))).select(F.col("a").alias(g.src), F.col("b").alias(g.dst), out)


def cocitation(g, out: str = "cocitation") -> DataFrame:
    """Node pairs and how many nodes point to both."""
    return _coupled(g, "v", "u", out)


def bibcoupling(g, out: str = "bibcoupling") -> DataFrame:
    """Node pairs and how many nodes both point to."""
    return _coupled(g, "u", "v", out)


def bfs(g, start, out: str = "distance", directed: bool = True, most: int | None = None) -> DataFrame:
    """Hops from one node; nodes out of reach are absent."""
    seeds = vertices(g).filter(F.col("id") == F.lit(start)).select(F.col("id").alias("s"))
    found = multi_source(pairs(g, directed).distinct(), seeds, most)
    return named(g, found.select("id", F.col("hops").cast("long").alias("value")), out)


def sssp(g, start, weight: str, out: str = "distance", directed: bool = True) -> DataFrame:
    """Least weight from one node, by relaxation of the edges of nodes that improved, until none does; weights mustn't be negative."""
    e = g.edges.select(F.col(f"`{g.src}`").alias("u"), F.col(f"`{g.dst}`").alias("v"), F.col(f"`{weight}`").cast("double").alias("w"))
    e = e if directed else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    e = cut(e.groupBy("u", "v").agg(F.min("w").alias("w")))
    if not e.filter("w < 0").isEmpty():
        raise GraphError(f"a weight in {weight!r} is negative")
    best = cut(vertices(g).filter(F.col("id") == F.lit(start)).withColumn("value", F.lit(0.0)))
    front = best
    while True:
        offers = front.join(e, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min(F.col("value") + F.col("w")).alias("offer"))
        front = cut(offers.join(best, "id", "left").filter(F.col("value").isNull() | (F.col("offer") < F.col("value"))).select("id", F.col("offer").alias("value")))
        if front.isEmpty():
            break
        best = cut(best.join(front.select("id"), "id", "left_anti").unionByName(front))
    return named(g, best, out)


def _all_distances(g, directed: bool = False) -> DataFrame:
    return multi_source(pairs(g, directed).distinct(), vertices(g).select(F.col("id").alias("s")), None).filter("hops > 0")


def closeness_centrality(g, out: str = "closeness_centrality", directed: bool = False) -> DataFrame:
    """Wasserman-Faust form: (r / total) * (r / (n - 1)) for r nodes that reach a node."""
    n = max(1, vertices(g).count() - 1)
    d = _all_distances(g, directed).groupBy("id").agg(F.count(F.lit(1)).alias("r"), F.sum("hops").alias("t"))
    return named(g, vertices(g).join(d, "id", "left").select("id", F.coalesce(F.col("r") / F.col("t") * F.col("r") / n, F.lit(0.0)).alias("value")), out)


def harmonic_centrality(g, out: str = "harmonic_centrality", directed: bool = False) -> DataFrame:
    n = max(1, vertices(g).count() - 1)
    d = _all_distances(g, directed).groupBy("s").agg(F.sum(1 / F.col("hops")).alias("t"))
    return named(g, vertices(g).join(d.withColumnRenamed("s", "id"), "id", "left").select("id", (F.coalesce("t", F.lit(0.0)) / n).alias("value")), out)


def eccentricity(g, out: str = "eccentricity", directed: bool = False) -> DataFrame:
    d = _all_distances(g, directed).groupBy("s").agg(F.max("hops").cast("long").alias("t"))
    return named(g, vertices(g).join(d.withColumnRenamed("s", "id"), "id", "left").select("id", F.coalesce("t", F.lit(0)).alias("value")), out)


def strongly_connected_components(g, out: str = "component") -> DataFrame:
    """The least node id of each strong component, by colouring: least ids run forward, then back within a colour."""
    edges, left, done = cut(pairs(g, True, False).distinct()), cut(vertices(g)), None
    while not left.isEmpty():
        state = left.select("id", F.col("id").alias("c"))
        while True:
            offer = edges.join(state.select(F.col("id").alias("u"), "c"), "u").groupBy(F.col("v").alias("id")).agg(F.min("c").alias("m"))
            new = cut(state.join(offer, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
            state = new.select("id", "c")
            if new.filter("old != c").isEmpty():
                break
        inside = cut(edges.join(state.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(state.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").filter("cu = cv").select("u", "v"))
        got = cut(state.filter("id = c"))
        front = got
        while True:
            front = cut(inside.join(front.select(F.col("id").alias("v"), "c"), "v").select(F.col("u").alias("id"), "c").distinct().join(got, "id", "left_anti"))
            if front.isEmpty():
                break
            got = cut(got.unionByName(front))
        part = got.select("id", F.col("c").alias("value"))
        done = part if done is None else done.unionByName(part)
        left = cut(left.join(got, "id", "left_anti"))
        for end in ("u", "v"):
            edges = edges.join(got.select(F.col("id").alias(end)), end, "left_anti")
        edges = cut(edges.select("u", "v"))
    return named(g, done if done is not None else vertices(g).select("id", F.col("id").alias("value")), out)


def minimum_spanning_tree(g, weight: str | None = None):
    """Borůvka rounds: each component takes its lightest edge out; ties by edge id."""
    g = g.with_nodes().with_edge_ids()
    e = g.edges.select(F.col(f"`{g.edge}`").alias("eid"), F.col(f"`{g.src}`").alias("u"), F.col(f"`{g.dst}`").alias("v"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w")).filter("u != v")
    e = cut(e)
    label = cut(vertices(g).select("id", F.col("id").alias("c")))
    chosen = None
    while True:
        lab = lambda end, name: label.select(F.col("id").alias(end), F.col("c").alias(name))  # noqa: B023, E731
        cross = e.join(lab("u", "cu"), "u").join(lab("v", "cv"), "v").filter("cu != cv")
        both = cross.select("eid", "w", F.col("cu").alias("a"), F.col("cv").alias("b")).unionByName(cross.select("eid", "w", F.col("cv").alias("a"), F.col("cu").alias("b")))
        best = cut(both.groupBy("a").agg(F.min(F.struct("w", "eid", "b")).alias("m")).select("a", "m.eid", "m.b"))
        if best.isEmpty():
            break
        new = best.select("eid").distinct()
        chosen = new if chosen is None else chosen.unionByName(new).distinct()
        merged = connected_components(type(g)(edges=best.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "m")
        label = cut(label.join(merged.withColumnRenamed("id", "c"), "c", "left").select("id", F.coalesce("m", "c").alias("c")))
    keep = chosen.select(F.col("eid").alias(g.edge)) if chosen is not None else g.edges.select(g.edge).limit(0)
    return g.replace(edges=g.edges.join(keep, g.edge, "left_semi"))


def constraint(g, out: str = "constraint") -> DataFrame:
    """Burt's constraint: sum over neighbours j of (p_ij + sum_q p_iq p_qj) squared."""
    near = pairs(g, False, False)
    degree = near.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    p = near.join(degree, "u").select("u", "v", (1 / F.col("d")).alias("p"))
    two = p.select("u", F.col("v").alias("q"), F.col("p").alias("p1")).join(p.select(F.col("u").alias("q"), "v", F.col("p").alias("p2")), "q").filter("u != v").groupBy("u", "v").agg(F.sum(F.col("p1") * F.col("p2")).alias("t"))
    each = p.join(two, ["u", "v"], "left").select("u", F.pow(F.col("p") + F.coalesce("t", F.lit(0.0)), 2).alias("c"))
    return named(g, vertices(g).join(each.groupBy(F.col("u").alias("id")).agg(F.sum("c").alias("value")), "id", "left"), out)


def ego_graph(g, start, radius: int = 1, directed: bool = False):
    return g.keep_nodes(bfs(g, start, "__d", directed, radius).select(g.node))


def _adjacency(g, directed: bool):
    n = g.edges.count()
    if n > SINGLE_TASK_EDGES:
        raise Unsupported(f"this algorithm runs in one place, for at most {SINGLE_TASK_EDGES} edges; there are {n}")
    near = defaultdict(list)
    found = pairs(g, directed, False).distinct().toArrow()
    for u, v in zip(found["u"].to_pylist(), found["v"].to_pylist(), strict=True):
        near[u].append(v)
    return near, vertices(g).toArrow()["id"].to_pylist()


def _peeled(ahead: list[list[int]]) -> tuple[list[int], list[float], list[tuple[int, int, float]]]:
    """Of an undirected graph: how many nodes each stands for, itself included (0: peeled off), and what peeling settles:
    the ordered pairs of ends whose paths pass through each node and over each edge.  Empties the lists of peeled nodes, in place.

    A node with one neighbour left is put on that neighbour, until there is none: all paths between
    what it stands for and the rest of its component take its one edge.
    """
    n = len(ahead)
    part, size = [-1] * n, []
    for s in range(n):
        if part[s] < 0:
            part[s], stack = len(size), [s]
            size.append(0)
            while stack:
                u = stack.pop()
                size[-1] += 1
                for v in ahead[u]:
                    if part[v] < 0:
                        part[v] = part[u]
                        stack.append(v)
    left, weight, branches, squares, along = [set(x) for x in ahead], [1] * n, [0] * n, [0] * n, []
    todo = [u for u in range(n) if len(left[u]) == 1]
    while todo:
        u = todo.pop()
        if len(left[u]) != 1:
            continue
        v, b = left[u].pop(), weight[u]
        left[v].discard(u)
        weight[v] += b
        weight[u] = 0
        rest = size[part[u]] - b
        along += [(u, v, float(b * rest)), (v, u, float(b * rest))]
        for x, k in ((v, b), (u, rest)):
            branches[x] += k
            squares[x] += k * k
        if len(left[v]) == 1:
            todo.append(v)
    through = []
    for u in range(n):
        whole = size[part[u]] - 1
        rest = whole - branches[u]  # what lies in the part that isn't peeled off
        through.append(float(branches[u] * whole - squares[u] + rest * branches[u]))
        ahead[u] = [v for v in ahead[u] if v in left[u]]
    return weight, through, along


def _paths_between(g, directed: bool) -> DataFrame:
    """(a, b, value): the shares of shortest paths through node ``a`` (b null) or edge a -> b, over all sources.

    Brandes' algorithm from each source; sources are dealt to tasks, each with the edges, whose number is checked.
    Undirected: trees are peeled off first, in time that grows with the edges, and what is left counts for them.
    """
    near, nodes = _adjacency(g, directed)
    number = {v: i for i, v in enumerate(nodes)}
    spark = g.edges.sparkSession
    ahead = [[number[v] for v in near.get(u, ())] for u in nodes]
    weight, settled, bridges = ([1] * len(nodes), [], []) if directed else _peeled(ahead)
    sources = [i for i, x in enumerate(ahead) if x]
    shared = spark.sparkContext.broadcast((ahead, weight, sources))

    def run(batches):
        ahead, weight, sources = shared.value
        through, along = defaultdict(float), defaultdict(float)
        for batch in batches:
            for s in (sources[i] for i in batch.column("id").to_pylist()):
                order, before, paths, dist, queue = [], defaultdict(list), defaultdict(float), {s: 0}, deque([s])
                paths[s] = 1.0
                while queue:
                    u = queue.popleft()
                    order.append(u)
                    for v in ahead[u]:
                        if v not in dist:
                            dist[v] = dist[u] + 1
                            queue.append(v)
                        if dist[v] == dist[u] + 1:
                            paths[v] += paths[u]
                            before[v].append(u)
                share = defaultdict(float)
                for v in reversed(order):
                    for u in before[v]:
                        part = paths[u] / paths[v] * (weight[v] + share[v])
                        share[u] += part
                        along[u, v] += part * weight[s]
                    if v != s:
                        through[v] += share[v] * weight[s]
        rows = [(a, None, x) for a, x in through.items()] + [(*e, x) for e, x in along.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "value"])

    kind = g.with_nodes().nodes.select(g.node).schema[0].dataType
    numbers, shares = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.float64())]), "a long, b long, value double"
    known = [(a, None, x) for a, x in enumerate(settled) if x] + bridges
    local = spark.createDataFrame(pa.table([pa.array(x, f.type) for x, f in zip(zip(*known, strict=True), numbers, strict=True)], schema=numbers)) if known else spark.createDataFrame([], shares)
    sums = spark.range(len(sources)).mapInArrow(run, shares).unionByName(local).groupBy("a", "b").agg(F.sum("value").alias("value"))
    table = spark.createDataFrame(pa.table([pa.array(range(len(nodes)), pa.int64()), pa.array(nodes)], names=["a", "id"])).select("a", F.col("id").cast(kind).alias("id")) if nodes else spark.createDataFrame([], f"a long, id {kind.simpleString()}")
    found = sums.join(table.withColumnRenamed("id", "from"), "a").join(table.withColumnsRenamed({"a": "b", "id": "to"}), "b", "left")
    return cut(found.select("from", "to", "value"))


def betweenness_centrality(g, out: str = "betweenness_centrality", directed: bool = False, normalized: bool = True) -> DataFrame:
    found = _paths_between(g, directed).filter("to IS NULL").select(F.col("from").alias("id"), "value")
    n = vertices(g).count()
    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else (1.0 if directed else 0.5)
    return named(g, vertices(g).join(found, "id", "left").select("id", (F.coalesce("value", F.lit(0.0)) * scale).alias("value")), out)


def edge_betweenness_centrality(g, out: str = "betweenness_centrality", directed: bool = False, normalized: bool = True) -> DataFrame:
    """Shares of shortest paths over each pair of neighbours; undirected: source <= destination."""
    found = _paths_between(g, directed).filter("to IS NOT NULL")
    n = vertices(g).count()
    if not directed:
        found = found.groupBy(F.least("from", "to").alias("from"), F.greatest("from", "to").alias("to")).agg((F.sum("value") / 2).alias("value"))
    scale = (1 / (n * (n - 1) / (1 if directed else 2)) if n > 1 else 1.0) if normalized else 1.0
    return found.select(F.col("from").alias(g.src), F.col("to").alias(g.dst), (F.col("value") * scale).alias(out))


def bfs_edges(g, start, directed: bool = True, most: int | None = None) -> DataFrame:
    """The edges of a breadth-first tree: each node that is reached, from its least neighbour one step nearer."""
    far = cut(bfs(g, start, "d", directed, most).select(F.col(g.node).alias("id"), "d"))
    e = pairs(g, directed, False).distinct()
    tree = e.join(far.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(far.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v").filter("dv = du + 1")
    return tree.groupBy("v").agg(F.min("u").alias("u")).select(F.col("u").alias(g.src), F.col("v").alias(g.dst))


def _weighted(formula, name):
    def run(g, weight: str, out: str = name, directed: bool = False) -> DataFrame:
        one = g.edges.select(F.col(f"`{g.src}`").alias("u"), F.col(f"`{g.dst}`").alias("v"), F.col(f"`{weight}`").cast("double").alias("w")).filter("u != v")
        near = one if directed else one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        near = cut(near.groupBy("u", "v").agg(F.max("w").alias("w")))
        return _met(near, lambda a, b: F.sum(F.least(a, b)), F.sum("w"), formula, out).select(F.col("a").alias(g.src), F.col("b").alias(g.dst), out)

    run.__doc__ = f"{name} of weighted neighbourhoods: shared weight is the sum of the lesser weights."
    return run


jaccard_w = _weighted(lambda n, a, b: n / (a + b - n), "jaccard_coeff")
overlap_w = _weighted(lambda n, a, b: n / F.least(a, b), "overlap_coeff")
sorensen_w = _weighted(lambda n, a, b: 2 * n / (a + b), "sorensen_coeff")


def _moved(edges: DataFrame, state: DataFrame, m2: float, most: int) -> DataFrame:
    """(id, c): nodes change to the neighbouring community of greatest modularity gain, half of them a round, until none gains."""
    degree = edges.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    state = cut(state.join(degree, "id", "left").select("id", "c", F.coalesce("k", F.lit(0.0)).alias("k")))
    plain = edges.filter("u != v")
    for i in range(most):
        total = state.groupBy("c").agg(F.sum("k").alias("t"))
        to = plain.join(state.select(F.col("id").alias("v"), "c"), "v").groupBy(F.col("u").alias("id"), "c").agg(F.sum("w").alias("inside"))
        offers = state.select("id", F.col("c").alias("own"), "k").join(to.unionByName(state.select("id", "c", F.lit(0.0).alias("inside"))).groupBy("id", "c").agg(F.max("inside").alias("inside")), "id").join(total, "c")
        rest = F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))
        gain = F.round(F.col("inside") - rest * F.col("k") / m2, 9)
        best = offers.groupBy("id").agg(F.max(F.struct(gain.alias("gain"), (F.col("c") == F.col("own")).alias("stay"))).alias("top"), F.first("own").alias("own"))
        won = offers.withColumn("gain", gain).join(best.select("id", F.col("top.gain").alias("most"), F.col("top.stay").alias("stay")), "id").filter("gain = most")
        won = won.groupBy("id").agg(F.when(~F.bool_or("stay"), F.min("c")).alias("new"))
        turn = F.xxhash64("id", F.lit(i)) % 2 == 0
        state = cut(state.select("id", "c", "k").join(won, "id", "left").select("id", F.when(turn, F.coalesce("new", "c")).otherwise(F.col("c")).alias("c"), "k", F.col("new").isNotNull().alias("wants")))
        if state.filter("wants").isEmpty():
            break
    else:
        _unsettled("modularity", most)
    return state.select("id", "c")


def modularity(g, community: DataFrame, weight: str | None = None) -> float:
    """Of communities (node, community), over undirected edges."""
    e = _undirected(g, weight)
    c = community.toDF("id", "c")
    m2 = e.agg(F.sum("w")).first()[0] or 1.0
    inside = e.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v").filter("cu = cv").agg(F.sum("w")).first()[0] or 0.0
    total = e.join(c.toDF("u", "cu"), "u").groupBy("cu").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inside / m2 - total / m2**2


def _undirected(g, weight: str | None) -> DataFrame:
    one = g.edges.select(F.col(f"`{g.src}`").alias("u"), F.col(f"`{g.dst}`").alias("v"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def louvain(g, out: str = "community", weight: str | None = None, most: int = 60, refine: bool = False) -> DataFrame:
    """Communities of high modularity: nodes move, communities become nodes of a lesser graph, until none moves.

    ``refine``: communities are cut into their connected parts before they become nodes.  Named by the least node.
    """
    edges = cut(_undirected(g, weight))
    m2 = edges.agg(F.sum("w")).first()[0] or 1.0
    of = cut(vertices(g).select("id", F.col("id").alias("c")))
    while True:
        moved = _moved(edges, edges.select(F.col("u").alias("id")).distinct().select("id", F.col("id").alias("c")), m2, most)
        if refine:
            ends = edges.filter("u != v").join(moved.toDF("u", "cu"), "u").join(moved.toDF("v", "cv"), "v").filter("cu = cv")
            parts = connected_components(type(g)(edges=ends.select(F.col("u").alias("src"), F.col("v").alias("dst"))), "part")
            moved = moved.join(parts, "id", "left").select("id", F.coalesce("part", "id").alias("c"))
        least = moved.groupBy("c").agg(F.min("id").alias("name"))
        moved = cut(moved.join(least, "c").select("id", F.col("name").alias("c")))
        if moved.filter("id != c").isEmpty():
            break
        of = cut(of.join(moved.toDF("c", "new"), "c", "left").select("id", F.coalesce("new", "c").alias("c")))
        edges = cut(edges.join(moved.toDF("u", "cu"), "u").join(moved.toDF("v", "cv"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    return named(g, of.withColumnRenamed("c", "value"), out)


def leiden(g, out: str = "community", weight: str | None = None, most: int = 60) -> DataFrame:
    """As ``louvain``, with communities that are connected."""
    return louvain(g, out, weight, most, refine=True)


def articulation_points(g, out: str = "articulation_point") -> DataFrame:
    """Nodes whose removal splits their component, by one depth-first search in one place."""
    near, nodes = _adjacency(g, False)
    low, depth, found = {}, {}, set()
    for root in nodes:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        children, stack = 0, [(root, None, iter(near[root]))]
        while stack:
            u, parent, rest = stack[-1]
            for v in rest:
                if v not in depth:
                    depth[v] = low[v] = depth[u] + 1
                    stack.append((v, u, iter(near[v])))
                    break
                if v != parent:
                    low[u] = min(low[u], depth[v])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if parent == root:
                        children += 1
                    elif low[u] >= depth[parent]:
                        found.add(parent)
        if children > 1:
            found.add(root)
    kind = g.with_nodes().nodes.schema[g.node].dataType.simpleString()
    return g.edges.sparkSession.createDataFrame([(n, n in found) for n in nodes], f"`{g.node}` {kind}, `{out}` boolean")


NODE = {
    "pagerank": pagerank, "connected_components": connected_components, "clusters": connected_components, "strongly_connected_components": strongly_connected_components, "core_number": core_number, "coreness": core_number,
    "hits": hits, "community_label_propagation": label_propagation, "label_propagation": label_propagation, "eigenvector_centrality": eigenvector_centrality, "katz_centrality": katz_centrality, "degree_centrality": degree_centrality,
    "closeness": closeness_centrality, "closeness_centrality": closeness_centrality, "harmonic_centrality": harmonic_centrality, "eccentricity": eccentricity, "betweenness": betweenness_centrality, "betweenness_centrality": betweenness_centrality,
    "louvain": louvain, "community_multilevel": louvain, "leiden": leiden, "community_leiden": leiden, "shortest_path": bfs,
    "articulation_points": articulation_points, "constraint": constraint, "bfs": bfs, "shortest_path_length": bfs, "sssp": sssp, "personalized_pagerank": pagerank,
    "hub_score": lambda g, out="hub_score": hits(g, hub=out).drop("authority"), "authority_score": lambda g, out="authority_score": hits(g, authority=out).drop("hub"),
}
EDGE = {"jaccard": jaccard, "overlap": overlap, "overlap_coefficient": overlap, "sorensen": sorensen, "sorensen_coefficient": sorensen, "cocitation": cocitation, "bibcoupling": bibcoupling,
        "jaccard_w": jaccard_w, "overlap_w": overlap_w, "sorensen_w": sorensen_w, "edge_betweenness": edge_betweenness_centrality, "edge_betweenness_centrality": edge_betweenness_centrality, "bfs_edges": lambda g, out=None, **k: bfs_edges(g, **k)}
GRAPH = {"k_core": k_core, "minimum_spanning_tree": minimum_spanning_tree, "spanning_tree": minimum_spanning_tree, "ego_graph": ego_graph}
