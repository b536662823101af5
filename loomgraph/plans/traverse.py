"""Traversal plans: forward semi-joins, then backward ones, so that only whole paths stay.

All is one lazy plan; only closures without a bound run a loop of jobs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import GraphError
from loomgraph.functions import expressions
from loomgraph.functions.predicates import filter_by_dict
from loomgraph.plans.ops import EdgeOp, NodeOp
from loomgraph.plans.storage import cut

MOST_ROUNDS = 1000
#: Quoted texts and names, each whole, and the stretches between them.
QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|[^'"`]+|['"`]""")
OPERATORS = re.compile(r"=~|==|&&?|\|\|?|~|\bTrue\b|\bFalse\b|\bNone\b|\bnot\s+in\b", re.I)
SPELLINGS = {"==": "=", "&": " and ", "&&": " and ", "|": " or ", "||": " or ", "~": " not ", "none": "null"}


def query_filter(df: DataFrame, query: str | None) -> DataFrame:
    """Rows for which a query string holds; Python spellings of operators are taken too."""
    if not query:
        return df
    text = "".join(part if part[0] in "'\"`" else _spelled(part) for part in QUOTED.findall(query))
    return df.filter(F.coalesce(expressions.column(text, expressions.Scope(df)).cast("boolean"), F.lit(False)))


def _spelled(text: str) -> str:
    """A stretch of a query string without quotes, in the spelling of the expression language."""
    return OPERATORS.sub(lambda m: SPELLINGS.get(m[0].lower(), m[0]), text)


def oriented(g, op: EdgeOp) -> DataFrame:
    """Matching edges as (eid, u, v) in the direction of travel."""
    edges = query_filter(filter_by_dict(g.edges, op.edge_match), op.edge_query)
    one = edges.select(F.col(f"`{g.edge}`").alias("eid"), F.col(f"`{g.src}`").alias("u"), F.col(f"`{g.dst}`").alias("v"))
    back = one.select("eid", F.col("v").alias("u"), F.col("u").alias("v"))
    out = {"forward": lambda: one, "reverse": lambda: back, "undirected": lambda: one.unionByName(back.filter("u != v"))}[op.direction]()
    for key, filters, query in (("u", op.source_node_match, op.source_node_query), ("v", op.destination_node_match, op.destination_node_query)):
        if filters or query:
            out = out.join(ids(query_filter(filter_by_dict(g.nodes, filters), query), g.node, key), key, "left_semi")
    return out


def ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    return df.select(F.col(f"`{column}`").alias(name))


def reached(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(id, hops): nodes in reach of ``seeds`` (id) and the least number of steps, 0 for seeds."""
    seen = cut(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    front, step = seen, 0
    while most is None or step < most:
        step += 1
        if step > MOST_ROUNDS:
            raise GraphError(f"no end after {MOST_ROUNDS} rounds")
        front = cut(edges.join(ids(front, "id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = cut(seen)
    return seen


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def traverse(g, ops: list[Any]):
    """The subgraph of all paths that match; a boolean column for each name."""
    g = g.with_nodes().with_edge_ids()
    steps: list[Any] = []
    for op in ops:
        if isinstance(op, EdgeOp) and (not steps or isinstance(steps[-1], EdgeOp)):
            steps.append(NodeOp())
        if isinstance(op, NodeOp) and steps and isinstance(steps[-1], NodeOp):
            raise GraphError("two node matchers follow each other")
        steps.append(op)
    if not steps or isinstance(steps[-1], EdgeOp):
        steps.append(NodeOp())
    match = lambda op: ids(query_filter(filter_by_dict(g.nodes, op.filter_dict), op.query), g.node) if op.filter_dict or op.query else None
    front = match(steps[0])
    front = ids(g.nodes, g.node) if front is None else front
    plans: list[Any] = []
    for i in range(1, len(steps), 2):
        edges, target = oriented(g, steps[i]), match(steps[i + 1])
        low, high = steps[i].bounds()
        layers, arrive = [], [front] if low == 0 else []
        if high is None:
            far = reached(edges, front)
            layers = [edges.join(far.select(F.col("id").alias("u"), (F.col("hops") + 1).alias("hop")), "u")]
            arrive.append(ids(layers[0], "v"))
        else:
            at = front
            for h in range(1, high + 1):
                layer = edges.join(ids(at, "id", "u"), "u", "left_semi").withColumn("hop", F.lit(h))
                if h == high and target is not None:
                    layer = layer.join(ids(target, "id", "v"), "v", "left_semi")
                layers.append(layer)
                at = ids(layer, "v").distinct()
                if h >= low:
                    arrive.append(at)
        after = union(arrive).distinct() if len(arrive) > 1 else arrive[0].distinct()
        if target is not None:
            after = after.join(target, "id", "left_semi")
        home = None
        if steps[i].direction == "undirected" and high != 1 and low > 0 and (i > 1 or match(steps[0]) is not None):
            home = cut(unseen_seeds(union(layers).select("eid", "u", "v"), front))
            after = after.join(home, "id", "left_anti")
        plans.append((front, edges, layers, low, high, home))
        front = after
    keep_nodes, keep_edges, back = {len(steps) - 1: front}, {}, front
    for i in range(len(steps) - 2, 0, -2):
        start, edges, layers, low, high, home = plans[i // 2]
        kept, zero, ends = [], [back.join(start, "id", "left_semi")] if low == 0 else [], back
        if high is None:
            flipped = edges.select("eid", F.col("v").alias("u"), F.col("u").alias("v"))
            able = reached(flipped, back)
            kept.append(layers[0].join(ids(able, "id", "v"), "v", "left_semi"))
        else:
            at = back
            for h in range(high, 0, -1):
                layer = layers[h - 1].join(ids(at, "id", "v"), "v", "left_semi")
                kept.append(layer)
                at = ids(layer, "u").distinct()
                if low <= h - 1 and h > 1:
                    at = at.unionByName(back).distinct()
        walked, op = union(kept), steps[i]
        several = op.sliced or op.prune_to_endpoints or op.label_node_hops or op.label_edge_hops
        if several:  # read several times below
            walked = cut(walked)
        first = ids(walked.filter("hop = 1") if several else kept[-1], "u")
        if high is None:
            first = first.join(start, "id", "left_semi")
        back = union([first, *zero]).distinct()
        back = cut(back) if several else back
        keep_edges[i] = Walked(op, walked, high == 1, back, ends, home)
        keep_nodes[i - 1] = back
    inner = {i for i, w in keep_edges.items() if w.op.sliced}
    # A sliced step brings its own ends; its neighbours' nodes come with their other steps, if there are any.
    every = [part for k, part in keep_nodes.items() if not inner or not {k - 1, k + 1} & set(keep_edges) <= inner]
    for w in keep_edges.values():
        every += w.nodes()
    nodes = g.nodes.join(ids(union(every).distinct(), "id", g.node), g.node, "left_semi")
    if keep_edges:
        eids = union([w.edges().select(F.col("eid").alias(g.edge)) for w in keep_edges.values()]).distinct()
        edges = g.edges.join(eids, g.edge, "left_semi")
    else:
        edges = g.edges.limit(0)
    for i, op in enumerate(steps):
        if op.name:
            if isinstance(op, NodeOp):
                nodes = flagged(nodes, g.node, ids(keep_nodes[i], "id", g.node), op.name)
            else:
                edges = flagged(edges, g.edge, keep_edges[i].edges().select(F.col("eid").alias(g.edge)), op.name)
    for w in keep_edges.values():
        if w.op.label_node_hops:
            nodes = nodes.join(w.node_hops().select(F.col("id").alias(g.node), F.col("hop").alias(unused(nodes, w.op.label_node_hops))), g.node, "left")
        if w.op.label_edge_hops:
            edges = edges.join(w.edge_hops().select(F.col("eid").alias(g.edge), F.col("hop").alias(unused(edges, w.op.label_edge_hops))), g.edge, "left")
    return g.replace(nodes=nodes, edges=edges)


@dataclass(frozen=True)
class Walked:
    """What a step kept: its edges (eid, u, v, hop), the nodes that it began and ended at, and the seeds it didn't truly return to."""

    op: EdgeOp
    layers: DataFrame
    single: bool
    seeds: DataFrame
    ends: DataFrame
    home: DataFrame | None

    def edge_hops(self) -> DataFrame:
        return self.layers.groupBy("eid").agg(F.min("hop").alias("hop"))

    def edges(self) -> DataFrame:
        """Edges (eid, u, v) of the steps that are put out."""
        if not self.op.sliced:
            return self.layers
        low, high = self.op.output_min_hops or 0, self.op.output_max_hops
        inside = (F.col("hop") >= low) & (F.lit(True) if high is None else F.col("hop") <= high)
        return self.layers.join(self.edge_hops().filter(inside), ["eid", "hop"], "left_semi")

    def nodes(self) -> list[DataFrame]:
        if self.op.prune_to_endpoints and not self.op.sliced:
            return [self.seeds, self.ends]
        if self.single and not self.op.sliced:
            return []
        kept = self.edges()
        return [ids(kept, "u"), ids(kept, "v"), *([self.seeds] if self.op.sliced and self.op.label_seeds else [])]

    def node_hops(self) -> DataFrame:
        """Least steps to the nodes that were reached, 0 for seeds if they are labelled."""
        found = self.layers.select(F.col("v").alias("id"), "hop")
        if self.home is not None:
            found = found.join(self.home, "id", "left_anti")
        if self.op.label_seeds:
            found = found.unionByName(self.seeds.select("id", F.lit(0).alias("hop")))
        return found.groupBy("id").agg(F.min("hop").alias("hop"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with a number behind it where the table has such a column."""
    k = 0
    while (f"{name}_{k}" if k else name) in df.columns:
        k += 1
    return f"{name}_{k}" if k else name


def unseen_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Of ``seeds`` (id) those that no undirected walk over ``edges`` (eid, u, v) comes back to without using an edge twice.

    A walk comes back from another seed of the same component, or around a
    cycle: by a self-loop, or within what is left when nodes of one edge are peeled off.
    """
    from loomgraph.graph import Graph
    from loomgraph.operators.algorithms import connected_components

    edges = cut(edges.groupBy("eid").agg(F.min(F.struct(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).alias("e")).select("eid", "e.*"))
    parts = connected_components(Graph(edges=edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))), "part")
    mine = parts.join(seeds.distinct(), "id", "left_semi")
    shared = mine.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = ids(mine.join(shared, "part", "left_semi"), "id").unionByName(ids(edges.filter("u = v"), "u"))
    core = cut(edges.filter("u != v"))
    while True:
        ends = ids(core, "u").unionByName(ids(core, "v")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        leaves = cut(ends.filter("n = 1").select("id"))
        if leaves.isEmpty():
            break
        core = cut(core.join(ids(leaves, "id", "u"), "u", "left_anti").join(ids(leaves, "id", "v"), "v", "left_anti"))
    met = met.unionByName(ids(core, "u")).unionByName(ids(core, "v")).distinct()
    return seeds.select("id").distinct().join(met, "id", "left_anti")


def flagged(df: DataFrame, key: str, chosen: DataFrame, name: str) -> DataFrame:
    marks = chosen.distinct().withColumn("__mark", F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce("__mark", F.lit(False))).drop("__mark")


def compared(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
