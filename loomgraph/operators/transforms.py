"""Graph transforms: hypergraphs, topological levels, collapse, conditional probabilities, layouts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.errors import GraphError
from loomgraph.graph import Graph
from loomgraph.operators.algorithms import connected_components, pairs, vertices
from loomgraph.plans.storage import cut


def hypergraph(events: DataFrame, entity_types: list[str], event_id: str | None = None, direct: bool = False, drop_na: bool = True) -> Graph:
    """Events to entity nodes ``column::value`` and edges from events to entities, or (``direct``) between an event's entities."""
    if event_id is None:
        events, event_id = cut(events.withColumn("EventID", F.concat(F.lit("event_id::"), F.monotonically_increasing_id()))), "EventID"
    named = [F.struct(F.lit(c).alias("type"), F.col(f"`{c}`").cast("string").alias("value")) for c in entity_types]
    entity = lambda x: F.concat(x["type"], F.lit("::"), x["value"])
    long = events.withColumn("__e", F.explode(F.array(*named)))
    long = long.filter("__e.value IS NOT NULL") if drop_na else long.withColumn("__e", F.struct(F.col("__e.type").alias("type"), F.coalesce("__e.value", F.lit("null")).alias("value")))
    nodes = long.select(entity(F.col("__e")).alias("nodeID"), F.col("__e.type").alias("type"), F.col("__e.value").alias("nodeTitle")).distinct()
    event = F.col(f"`{event_id}`").cast("string")
    if direct:
        sides = [(a, b) for i, a in enumerate(entity_types) for b in entity_types[i + 1 :]]
        pair = F.explode(F.array(*(F.struct(F.concat(F.lit(f"{a}::"), F.col(f"`{a}`").cast("string")).alias("s"), F.concat(F.lit(f"{b}::"), F.col(f"`{b}`").cast("string")).alias("d"), F.lit(f"{a}::{b}").alias("t")) for a, b in sides)))
        edges = events.withColumn("__p", pair).filter("__p.s IS NOT NULL AND __p.d IS NOT NULL").select(F.col("__p.s").alias("src"), F.col("__p.d").alias("dst"), F.col("__p.t").alias("edgeType"), event.alias("EventID"))
    else:
        nodes = nodes.unionByName(events.select(event.alias("nodeID"), F.lit("EventID").alias("type"), event.alias("nodeTitle")).distinct())
        edges = long.select(event.alias("src"), entity(F.col("__e")).alias("dst"), F.col("__e.type").alias("edgeType"), event.alias("EventID"))
    return Graph(edges=edges, nodes=nodes, src="src", dst="dst", node="nodeID")


def hypergraph_of(g, entity_types: list[str] | None = None, from_edges: bool = True, event_id: str | None = None, opts: dict | None = None, drop_edge_attrs: bool = True, **options) -> Graph:
    """The hypergraph of a graph's edge rows, or of its node rows.

    ``opts``: ``SKIP`` names columns that are no entities, ``CATEGORIES`` maps a category to the columns whose values
    are one entity whichever of them holds it; ``drop_edge_attrs=False`` keeps the event's columns on its edges.
    """
    events, opts = g.edges if from_edges else g.with_nodes().nodes, opts or {}
    chosen = [c for c in (entity_types or events.columns) if c not in opts.get("SKIP", ()) and c != event_id]
    category = {c: name for name, columns in (opts.get("CATEGORIES") or {}).items() for c in columns}
    out = hypergraph(events, chosen, event_id, **options)
    if category:
        lookup = F.create_map(*(F.lit(x) for kv in category.items() for x in kv))
        renamed = lambda c: F.coalesce(F.concat(F.try_element_at(lookup, F.substring_index(c, "::", 1)), F.lit("::"), F.expr(f"substring({c}, instr({c}, '::') + 2)")), F.col(c))
        kind = F.coalesce(F.try_element_at(lookup, F.col("type")), F.col("type"))
        out = out.replace(nodes=out.nodes.withColumns({"nodeID": renamed("nodeID"), "type": kind}).distinct(), edges=out.edges.withColumns({k: renamed(k) for k in ("src", "dst")}))
    if not drop_edge_attrs and event_id:
        own = events.withColumn("EventID", F.col(f"`{event_id}`").cast("string")).drop(event_id, "src", "dst", "edgeType")
        out = out.replace(edges=out.edges.join(own, "EventID", "left"))
    return out


def modularity_weighted_layout(g, community_col: str | None = None, community_alg: str = "community_multilevel", community_params: dict | None = None, same_community_weight: float = 2.0, cross_community_weight: float = 0.3, **_) -> Graph:
    """Edges with ``same_community`` and a ``weight`` that draws communities together."""
    from loomgraph.operators.algorithms import NODE

    g = g.with_nodes()
    if community_col is None:
        community_col = community_alg
        found = NODE[community_alg](g, **({"out": community_alg} | (community_params or {})))
        g = g.replace(nodes=g.nodes.drop(community_alg).join(found, g.node, "left"))
    of = g.nodes.select(F.col(f"`{g.node}`").alias("__id"), F.col(f"`{community_col}`").alias("__c"))
    edges = g.edges
    for end, name in ((g.src, "__a"), (g.dst, "__b")):
        edges = edges.join(of.toDF("__id", name), F.col(f"`{end}`") == F.col("__id"), "left").drop("__id")
    same = F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))
    return g.replace(edges=edges.withColumns({"same_community": same, "weight": F.when(same, same_community_weight).otherwise(cross_community_weight)}).drop("__a", "__b"))


def topological_levels(g, level: str = "level", allow_cycles: bool = True, remove_self_loops: bool = True) -> Graph:
    """Peels nodes without an edge in; on a cycle the node of greatest degree (least id of equals) goes."""
    g = g.with_nodes()
    edges, left, done, k = cut(pairs(g, True, not remove_self_loops)), cut(vertices(g)), None, 0
    while not left.isEmpty():
        roots = cut(left.join(edges.select(F.col("v").alias("id")), "id", "left_anti"))
        if roots.isEmpty():
            if not allow_cycles:
                raise GraphError("the graph has a cycle")
            ends = edges.select(F.explode(F.array("u", "v")).alias("id"))
            roots = cut(ends.groupBy("id").count().orderBy(F.desc("count"), "id").limit(1).select("id"))
        part = roots.withColumn(level, F.lit(k))
        done, k = part if done is None else done.unionByName(part), k + 1
        left = cut(left.join(roots, "id", "left_anti"))
        edges = edges.join(roots.select(F.col("id").alias("u")), "u", "left_anti")
        edges = cut(edges.join(roots.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v"))
    nodes = g.nodes.drop(level)
    return g.replace(nodes=nodes.join(done.withColumnRenamed("id", g.node), g.node, "left") if done is not None else nodes.withColumn(level, F.lit(0)))


def collapse(g, node, attribute, column: str, self_edges: bool = False) -> Graph:
    """Merges directed neighbours that both have ``attribute`` in ``column`` and that ``node`` reaches; adds *_final columns and keeps the originals.

    A merged node's name lists its members in order.
    """
    g = g.with_nodes()
    far = g.reachable(g.nodes.filter(F.col(f"`{g.node}`") == F.lit(node)).select(g.node)).select(F.col(g.node).alias("id"))
    has = g.nodes.filter(F.col(f"`{column}`") == F.lit(attribute)).select(F.col(f"`{g.node}`").alias("id")).join(far, "id", "left_semi")
    inner = pairs(g, True, False).join(has.withColumnRenamed("id", "u"), "u", "left_semi").join(has.withColumnRenamed("id", "v"), "v", "left_semi")
    parts = connected_components(Graph(edges=inner.select(F.col("u").alias("src"), F.col("v").alias("dst"))), "c")
    names = parts.groupBy("c").agg(F.array_join(F.sort_array(F.collect_list(F.col("id").cast("string"))), " ").alias("name"))
    label = parts.join(names, "c").select("id", "name")
    to = lambda df, key, out: df.join(label.select(F.col("id").alias(key), F.col("name").alias(out)), key, "left").withColumn(out, F.coalesce(out, F.col(f"`{key}`").cast("string")))
    edges = to(to(g.edges, g.src, f"{g.src}_final"), g.dst, f"{g.dst}_final")
    if not self_edges:
        edges = edges.filter(F.col(f"`{g.src}_final`") != F.col(f"`{g.dst}_final`"))
    return g.replace(nodes=to(g.nodes, g.node, f"{g.node}_final"), edges=edges)


def conditional_probs(df: DataFrame, x: str, given: str) -> DataFrame:
    """p(x | given) for each pair of values, as (x, given, probs)."""
    counts = df.groupBy(x, given).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("probs", F.col("n") / F.sum("n").over(Window.partitionBy(given))).drop("n")


def conditional_graph(g, x: str, given: str, kind: str = "nodes") -> Graph:
    """A graph of values: an edge given -> x for each pair of values of two columns, with p(x | given)."""
    table = g.with_nodes().nodes if kind == "nodes" else g.edges
    probs = conditional_probs(table, x, given).filter(F.col(f"`{x}`").isNotNull() & F.col(f"`{given}`").isNotNull())
    edges = probs.select(F.col(f"`{given}`").cast("string").alias("src"), F.col(f"`{x}`").cast("string").alias("dst"), "probs")
    return Graph(edges=edges).materialize_nodes()


def drop_orphans(g) -> Graph:
    ends = pairs(g).select(F.explode(F.array("u", "v")).alias(g.node)).distinct()
    return g.replace(nodes=g.with_nodes().nodes.join(ends, g.node, "left_semi"))


# Layouts: arithmetic on columns


def _ranked(df: DataFrame, order: list) -> DataFrame:
    """(rank from 0, n): ranks over all rows from sums of sorted ranges, without one task for all rows."""
    ordered = cut(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = sorted((r["__p"], r["count"]) for r in ordered.groupBy("__p").count().collect())
    rows, at = [], 0
    for p, size in sizes:
        rows.append((p, at))
        at += size
    base = df.sparkSession.createDataFrame(rows or [(0, 0)], "__p int, __base long")
    out = ordered.join(F.broadcast(base), "__p")  # a row for each partition
    return out.withColumn("__rank", F.col("__base") + F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)).withColumn("__n", F.lit(at)).drop("__p", "__i", "__base")


def circle_layout(g, radius: float = 100.0, by: str | None = None) -> Graph:
    g = g.with_nodes()
    ranked = _ranked(g.nodes, [F.col(f"`{by or g.node}`"), F.col(f"`{g.node}`")])
    angle = 2 * math.pi * F.col("__rank") / F.col("__n")
    return g.replace(nodes=ranked.withColumns({"x": radius * F.cos(angle), "y": radius * F.sin(angle)}).drop("__rank", "__n"))


def ring_continuous_layout(g, ring_col: str, min_r: float = 100.0, max_r: float = 1000.0) -> Graph:
    """The radius follows a number, the angle the node's hash."""
    g = g.with_nodes()
    low, high = g.nodes.agg(F.min(ring_col), F.max(ring_col)).first()
    span = float((high or 0) - (low or 0)) or 1.0
    r = min_r + (F.col(f"`{ring_col}`") - F.lit(low)) / span * (max_r - min_r)
    angle = F.pmod(F.xxhash64(F.col(f"`{g.node}`")), F.lit(1 << 20)) / float(1 << 20) * 2 * math.pi
    return g.replace(nodes=g.nodes.withColumns({"r": r, "x": r * F.cos(angle), "y": r * F.sin(angle)}))


def ring_categorical_layout(g, ring_col: str, min_r: float = 100.0, step: float = 100.0) -> Graph:
    g = g.with_nodes()
    kinds = g.nodes.select(ring_col).distinct()
    ranks = _ranked(kinds, [F.col(f"`{ring_col}`")]).select(ring_col, (min_r + F.col("__rank") * step).alias("r"))
    angle = F.pmod(F.xxhash64(F.col(f"`{g.node}`")), F.lit(1 << 20)) / float(1 << 20) * 2 * math.pi
    nodes = g.nodes.join(ranks, ring_col, "left")
    return g.replace(nodes=nodes.withColumns({"x": F.col("r") * F.cos(angle), "y": F.col("r") * F.sin(angle)}))


def time_ring_layout(g, time_col: str, min_r: float = 100.0, max_r: float = 1000.0) -> Graph:
    g = g.with_nodes()
    timed = g.replace(nodes=g.nodes.withColumn("__t", F.unix_micros(F.col(f"`{time_col}`").cast("timestamp"))))
    out = ring_continuous_layout(timed, "__t", min_r, max_r)
    return out.replace(nodes=out.nodes.drop("__t"))


def mercator_layout(g, latitude: str = "latitude", longitude: str = "longitude", scale: float = 6378137.0) -> Graph:
    g = g.with_nodes()
    lat = F.radians(F.least(F.greatest(F.col(f"`{latitude}`"), F.lit(-85.05112878)), F.lit(85.05112878)))
    return g.replace(nodes=g.nodes.withColumns({"x": scale * F.radians(F.col(f"`{longitude}`")), "y": scale * F.log(F.tan(F.lit(math.pi / 4) + lat / 2))}))


def tree_layout(g, level: str = "level", width: float = 100.0, height: float = 100.0) -> Graph:
    out = topological_levels(g, level)
    place = F.row_number().over(Window.partitionBy(level).orderBy(F.col(f"`{g.node}`"))) - 1
    return out.replace(nodes=out.nodes.withColumns({"x": place * width, "y": -F.col(level) * height}))


def rotate(g, degrees: float) -> Graph:
    a = math.radians(degrees)
    return g.replace(nodes=g.nodes.withColumns({"x": F.col("x") * math.cos(a) - F.col("y") * math.sin(a), "y": F.col("x") * math.sin(a) + F.col("y") * math.cos(a)}))


def encoded(df: DataFrame, column: str, mapping: dict, out: str, default=None) -> DataFrame:
    """A visual encoding as a column: a lookup of values."""
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(f"`{column}`")), F.lit(default)))
