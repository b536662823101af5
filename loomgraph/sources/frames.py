"""Graphs from and to pandas, Arrow, lists of records and other graph objects."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.errors import SchemaProblem
from loomgraph.graph import Graph


def table_of(spark: SparkSession, data: Any) -> DataFrame | None:
    """A Spark table from one, from pandas, Arrow, anything that tells its Arrow form (as Polars does), records, or a function that gives one of these."""
    if data is None or isinstance(data, DataFrame):
        return data
    if isinstance(data, (pa.Table, pa.RecordBatch)):
        return spark.createDataFrame(pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data)
    if type(data).__module__.partition(".")[0] == "pandas":
        return spark.createDataFrame(pa.Table.from_pandas(data, preserve_index=False))
    if hasattr(data, "__arrow_c_stream__"):
        return spark.createDataFrame(pa.table(data))
    if hasattr(data, "to_arrow"):
        return spark.createDataFrame(data.to_arrow())
    if isinstance(data, (list, tuple)):
        return spark.createDataFrame(pa.Table.from_pylist(list(data)))
    if callable(data):
        return table_of(spark, data())
    raise SchemaProblem(f"a {type(data).__name__} isn't a table")


def bind(spark: SparkSession, edges: Any = None, nodes: Any = None, **names: Any) -> Graph:
    """A graph of tables of any of these forms; ``names`` are the bindings of ``Graph``."""
    return Graph(edges=table_of(spark, edges), nodes=table_of(spark, nodes), **names)


def to_arrow(g: Graph) -> tuple[pa.Table | None, pa.Table]:
    """(nodes, edges) as Arrow tables of this process: for graphs of a size that it can hold."""
    return None if g.nodes is None else g.nodes.toArrow(), g.edges.toArrow()


def from_networkx(spark: SparkSession, graph: Any) -> Graph:
    """Nodes (id and attributes) and edges (src, dst and attributes) of a graph object with ``nodes(data=True)`` and ``edges(data=True)``."""
    nodes = [{"id": n, **data} for n, data in graph.nodes(data=True)]
    edges = [{"src": u, "dst": v, **data} for u, v, data in graph.edges(data=True)]
    return bind(spark, _even(edges, ("src", "dst")), _even(nodes, ("id",)))


def from_igraph(spark: SparkSession, graph: Any) -> Graph:
    """Nodes and edges of a graph object with ``vs`` and ``es``, whose items have ``attributes()``; ids are names, else numbers."""
    name = [v.attributes().get("name", v.index) for v in graph.vs]
    nodes = [{"id": name[v.index], **{k: x for k, x in v.attributes().items() if k != "name"}} for v in graph.vs]
    edges = [{"src": name[e.source], "dst": name[e.target], **e.attributes()} for e in graph.es]
    return bind(spark, _even(edges, ("src", "dst")), _even(nodes, ("id",)))


def _even(rows: list[dict[str, Any]], first: tuple[str, ...]) -> list[dict[str, Any]]:
    """Rows that all have all columns."""
    columns = dict.fromkeys(first) | dict.fromkeys(k for r in rows for k in r)
    return [{k: r.get(k) for k in columns} for r in rows]
