"""The closed set of callable operators, and procedures of query texts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import Unsupported
from loomgraph.graph import Graph
from loomgraph.operators import algorithms as A
from loomgraph.operators import transforms as T
from loomgraph.operators.encodings import ENCODINGS

METHODS = ("get_degrees", "get_indegrees", "get_outdegrees", "filter_nodes_by_dict", "filter_edges_by_dict", "materialize_nodes", "hop", "prune_self_edges", "drop_nodes", "keep_nodes", "search_nodes", "search_edges")
LAYOUTS = {f.__name__: f for f in (T.circle_layout, T.ring_continuous_layout, T.ring_categorical_layout, T.time_ring_layout, T.mercator_layout, T.tree_layout)}
#: Engines that algorithms are asked of by name; all run here.
ENGINES = ("compute", "compute_igraph", "compute_cugraph", "compute_networkx")
GRAPHS = {"get_topological_levels": lambda g, level_col="level", **k: T.topological_levels(g, level_col, **k), "collapse": T.collapse, "hypergraph": lambda g, entity_types=None, **k: T.hypergraph_of(g, entity_types, **k), "conditional_graph": T.conditional_graph, "modularity_weighted_layout": T.modularity_weighted_layout, **LAYOUTS, **ENCODINGS}


def known(function: str) -> bool:
    return function in METHODS or function in GRAPHS or function in ENGINES


def requested(alg: str | None = None, algorithm: str | None = None, out_col: str | None = None, out: str | None = None, params: dict[str, Any] | None = None, kind: str | None = None, use_vids: bool = False, **rest: Any) -> dict[str, Any]:
    """Arguments of ``compute`` from any of the spellings; ``kind`` and ``use_vids`` change nothing here."""
    return {"algorithm": alg or algorithm, "out": out_col or out, **(params or {}), **{k: v for k, v in rest.items() if v is not None}}


def compute(g: Graph, algorithm: str, out: str | None = None, **params: Any) -> Graph:
    """Runs an algorithm and adds its columns to the nodes, or makes its pairs the edges, or gives its graph."""
    if algorithm in A.NODE:
        found = A.NODE[algorithm](g, **({"out": out} if out else {}), **params)
        g = g.with_nodes()
        fresh = [c for c in found.columns if c != g.node]
        return g.replace(nodes=g.nodes.drop(*fresh).join(found, g.node, "left"))
    if algorithm in A.EDGE:
        return g.replace(edges=A.EDGE[algorithm](g, **({"out": out} if out else {}), **params), edge=None)
    if algorithm in A.GRAPH:
        return A.GRAPH[algorithm](g, **params)
    raise Unsupported(f"there is no algorithm {algorithm!r}")


def run(g: Graph, function: str, params: dict[str, Any]) -> Graph:
    """A graph call of a chain."""
    if function in METHODS:
        return getattr(g, function)(**params)
    if function in GRAPHS:
        return GRAPHS[function](g, **params)
    if function in ENGINES:
        return compute(g, **requested(**params))
    raise Unsupported(f"there is no call {function!r}")


def procedure(g: Graph, name: str, params: dict[str, Any] | None = None) -> DataFrame:
    """Rows of ``CALL <prefix>.<algorithm>(...)``: nodeId and values, or source, destination and values."""
    kind = name.rpartition(".")[2]
    if kind == "degree":
        return g.get_degrees().nodes.select(F.col(f"`{g.node}`").alias("nodeId"), "degree", "degree_in", "degree_out")
    if kind in A.NODE:
        return A.NODE[kind](g, **(params or {})).withColumnRenamed(g.node, "nodeId")
    if kind in A.EDGE:
        return A.EDGE[kind](g, **(params or {})).withColumnsRenamed({g.src: "source", g.dst: "destination"})
    if kind in A.GRAPH:
        raise Unsupported(f"{name} gives a graph, not rows; write {name}.write()")
    raise Unsupported(f"there is no procedure {name!r}")


def written(g: Graph, name: str, params: dict[str, Any] | None = None) -> Graph:
    """The graph of ``CALL <prefix>.<algorithm>.write(...)``: values as columns of its nodes, pairs as its edges."""
    kind = name.removesuffix(".write").rpartition(".")[2]
    return g.get_degrees() if kind == "degree" else compute(g, kind, **(params or {}))
