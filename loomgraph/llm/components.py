"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

EDGE = "u long, v long"


def forest(batches):
    """Union-find over each batch of edges: the same components from at most one edge a node."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x):
            at = x
            while (up := parent.setdefault(at, at)) != at:  # noqa: B023
                at = up
            while x != at:
                parent[x], x = at, parent[x]  # noqa: B023
            return at

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        edges = [(x, root(x)) for x in parent]
        edges = [e for e in edges if e[0] != e[1]]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], names=["u", "v"])


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component) with the component's least node; nodes without a link are absent.

    Union-find shrinks each task's edges to a forest, then large-star and
    small-star steps alternate until every edge leads to its component's least node;
    each step's lineage is cut.  Links of a null end or of a node to itself are
    left out, repeated links count once, an empty table gives no rows.  The edges
    of a node that holds many of them stay in their tasks when its least
    neighbour is joined to them.
    """
    edges = common.cut(edges.filter("u != v").mapInArrow(forest, EDGE).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("size")))
        hot = common.hot_keys(least, "u")
        edges = common.joined_by_hot_key(both, least.drop("size"), "u", hot).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        low = common.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        # A large-star step leaves a node few greater neighbours' worth of edges; what is hot here was hot above.
        stars = common.joined_by_hot_key(low, low.groupBy("u").agg(F.min("v").alias("m")), "u", hot)
        edges = common.cut(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        # Stars: each node has one edge to a lesser one, and none leads on from there.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
