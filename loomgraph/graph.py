"""A property graph held as two DataFrames with bound columns."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import GraphError, SchemaProblem
from loomgraph.functions.predicates import filter_by_dict
from loomgraph.plans import ops as O
from loomgraph.plans import rows as R
from loomgraph.plans.storage import cut
from loomgraph.plans.traverse import ids, query_filter, reached, traverse

EDGE_ID = "__eid"


@dataclass(frozen=True)
class Graph:
    """``nodes`` may be absent and is then made of the edges' ends; every method returns a new graph or DataFrame, lazily."""

    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    src: str = "src"
    dst: str = "dst"
    node: str = "id"
    edge: str | None = None
    settings: dict[str, Any] | None = None
    policy: dict[str, Callable] | None = None

    def checked(self, phase: str, **context: Any) -> None:
        """Calls the policy's function for a phase (``prechain``, ``postcall`` and so on), or that for its ``pre`` or ``post``; one that raises stops the query."""
        for name in (phase, "pre" if phase.startswith("pre") else "post"):
            if self.policy and name in self.policy:
                self.policy[name]({"phase": phase, "graph": self, **context})
                return

    def replace(self, **changes) -> Graph:
        return dataclasses.replace(self, **changes)

    bind = replace

    def pipe(self, fn: Callable, *args, **options):
        return fn(self, *args, **options)

    def materialize_nodes(self) -> Graph:
        """Nodes from the ends of edges, where there are none."""
        if self.nodes is not None:
            return self
        both = ids(self.edges, self.src, self.node).unionByName(ids(self.edges, self.dst, self.node))
        return self.replace(nodes=both.filter(F.col(self.node).isNotNull()).distinct())

    with_nodes = materialize_nodes

    def with_edge_ids(self) -> Graph:
        """An edge id where none is bound, made once and kept by a checkpoint, as it wouldn't survive recomputation."""
        if self.edges is None:
            raise GraphError("the graph has no edges")
        return self if self.edge else self.replace(edges=cut(self.edges.withColumn(EDGE_ID, F.monotonically_increasing_id())), edge=EDGE_ID)

    # Degrees

    def get_indegrees(self, col: str = "degree_in") -> Graph:
        return self._degree(self.dst, col)

    def get_outdegrees(self, col: str = "degree_out") -> Graph:
        return self._degree(self.src, col)

    def _degree(self, end: str, col: str) -> Graph:
        g = self.with_nodes()
        counts = g.edges.groupBy(F.col(f"`{end}`").alias(g.node)).agg(F.count(F.lit(1)).cast("int").alias(col))
        return g.replace(nodes=g.nodes.drop(col).join(counts, g.node, "left").withColumn(col, F.coalesce(col, F.lit(0))))

    def get_degrees(self, col: str = "degree", degree_in: str = "degree_in", degree_out: str = "degree_out") -> Graph:
        """All three in one pass over the edges; a self-loop counts twice in ``col``."""
        g = self.with_nodes()
        ends = g.edges.select(F.explode(F.array(F.struct(F.col(f"`{g.src}`").alias("k"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(f"`{g.dst}`").alias("k"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        counts = ends.groupBy(F.col("k").alias(g.node)).agg(F.sum("i").cast("int").alias(degree_in), F.sum("o").cast("int").alias(degree_out))
        nodes = g.nodes.drop(col, degree_in, degree_out).join(counts, g.node, "left")
        zero = {c: F.coalesce(c, F.lit(0)) for c in (degree_in, degree_out)}
        return g.replace(nodes=nodes.withColumns(zero).withColumn(col, F.col(degree_in) + F.col(degree_out)))

    # Subgraphs

    def filter_nodes_by_dict(self, filter_dict: dict[str, Any]) -> Graph:
        return self.replace(nodes=filter_by_dict(self.with_nodes().nodes, filter_dict))

    def filter_edges_by_dict(self, filter_dict: dict[str, Any]) -> Graph:
        return self.replace(edges=filter_by_dict(self.edges, filter_dict))

    def _chosen(self, nodes) -> DataFrame:
        g = self.with_nodes()
        if isinstance(nodes, DataFrame):
            return nodes.select(F.col(nodes.columns[0]).alias(g.node)).distinct()
        if isinstance(nodes, dict):
            return ids(filter_by_dict(g.nodes, nodes), g.node, g.node)
        return g.nodes.filter(F.col(f"`{g.node}`").isin(list(nodes))).select(g.node)

    def keep_nodes(self, nodes) -> Graph:
        """The subgraph that ids (a list, a filter dict or a DataFrame) induce."""
        g, chosen = self.with_nodes(), self._chosen(nodes)
        edges = g.edges
        for end in (g.src, g.dst):
            edges = edges.join(ids(chosen, g.node, end), end, "left_semi")
        return g.replace(nodes=g.nodes.join(chosen, g.node, "left_semi"), edges=edges.select(*g.edges.columns))

    def drop_nodes(self, nodes) -> Graph:
        """Without some nodes and the edges that touch them."""
        g, chosen = self.with_nodes(), self._chosen(nodes)
        edges = g.edges
        for end in (g.src, g.dst):
            edges = edges.join(ids(chosen, g.node, end), end, "left_anti")
        return g.replace(nodes=g.nodes.join(chosen, g.node, "left_anti"), edges=edges.select(*g.edges.columns))

    def prune_self_edges(self) -> Graph:
        return self.replace(edges=self.edges.filter(F.coalesce(F.col(f"`{self.src}`") != F.col(f"`{self.dst}`"), F.lit(True))))

    def search_nodes(self, term: str, columns=None, case_sensitive: bool = False, regex: bool = False) -> Graph:
        g = self.with_nodes()
        return g.replace(nodes=g.nodes.filter(R.searched(g.nodes, term, columns, case_sensitive, regex)))

    def search_edges(self, term: str, columns=None, case_sensitive: bool = False, regex: bool = False) -> Graph:
        return self.replace(edges=self.edges.filter(R.searched(self.edges, term, columns, case_sensitive, regex)))

    # Traversal

    def hop(self, nodes: DataFrame | None = None, return_as_wave_front: bool = False, target_wave_front: DataFrame | None = None, **options) -> Graph:
        """Edges walked from ``nodes`` (default: all) and the nodes at their ends; options as for an edge matcher, and ``direction``.

        ``return_as_wave_front``: only nodes that were reached, so not those it began at unless walked back to;
        ``target_wave_front``: nodes that the last step must end at.
        """
        g = self.with_nodes().with_edge_ids()
        op = O.EdgeOp(**options)
        marks = {"__seed": nodes, "__target": target_wave_front}
        for name, chosen in marks.items():
            if chosen is not None:
                g = g.replace(nodes=g.nodes.join(chosen.select(F.col(chosen.columns[0]).alias(g.node)).distinct().withColumn(name, F.lit(True)), g.node, "left"))
        ends = [O.NodeOp({name: True} if chosen is not None else None) for name, chosen in marks.items()]
        if return_as_wave_front:
            label = op.label_node_hops or "__hop"
            out = traverse(g, [ends[0], O.replaced(op, label_node_hops=label), ends[1]])
            kept = out.nodes.filter(F.col(f"`{[c for c in out.nodes.columns if c not in g.nodes.columns][0]}`").isNotNull())
            return out.replace(nodes=kept.drop("__seed", "__target", "__hop"))
        out = traverse(g, [ends[0], op, ends[1]])
        return out.replace(nodes=out.nodes.drop("__seed", "__target"))

    def reachable(self, nodes: DataFrame, most: int | None = None, direction: str = "forward") -> DataFrame:
        """(node id, hops) in breadth-first order of distance."""
        from loomgraph.plans.traverse import oriented

        g = self.with_edge_ids()
        return reached(oriented(g, O.EdgeOp(direction)), ids(nodes, nodes.columns[0]), most).withColumnRenamed("id", g.node)

    def chain(self, ops: list[Any] | dict[str, Any], where: list[O.Compare] | None = None):
        """Runs a chain: traversal first, then row calls; a graph without row calls, else a DataFrame."""
        from loomgraph.plans.bindings import same_path

        ops = O.from_json(ops) if isinstance(ops, dict) else list(ops)
        self.checked("prechain", ops=ops)
        split = next((i for i, op in enumerate(ops) if isinstance(op, O.Call)), len(ops))
        steps, calls = ops[:split], ops[split:]
        g = (same_path(self, steps, where) if where else traverse(self, steps)) if steps else self
        frame: DataFrame | None = None
        for call in calls:
            if not isinstance(call, O.Call):
                raise GraphError("a matcher can't follow a row call")
            self.checked("precall", function=call.function, params=call.params)
            if call.function == "rows":
                frame = self._rows(g, call.params)
                if source := call.params.get("source"):
                    frame = frame.filter(F.col(f"`{source}`"))
            elif call.function in R.APPLIES and "binding_ops" in call.params:
                frame = R.applied(call.function, frame if frame is not None else g.with_nodes().nodes, self, call.params)
            elif call.function in R.CALLS:
                frame = R.apply(g.with_nodes().nodes if frame is None else frame, call.function, call.params)
            else:
                from loomgraph.operators.registry import run

                g = run(g, call.function, call.params)
            self.checked("postcall", function=call.function, result=g if frame is None else frame)
        out = g if frame is None else frame
        self.checked("postchain", result=out)
        return out

    def _rows(self, g: Graph, params: dict[str, Any]) -> DataFrame:
        """The table that a ``rows`` call begins: nodes or edges, bindings of matchers, or edges with the nodes at their ends."""
        from loomgraph.plans.bindings import bound_rows, endpoint_rows

        if params.get("binding_ops"):
            frame = bound_rows(self, O.from_json({"chain": params["binding_ops"]}))
        elif params.get("alias_endpoints"):
            frame = endpoint_rows(g, params["alias_endpoints"])
        else:
            return g.with_nodes().nodes if params.get("table", "nodes") == "nodes" else g.edges
        for alias, filters in (params.get("alias_prefilters") or {}).items():
            frame = filter_by_dict(frame, {f"{alias}.{k}": v for k, v in filters.items()})
        return frame

    def query(self, text: str | list | dict, params: dict[str, Any] | None = None, where=None):
        """A chain, named steps (``{"type": "Let", ...}``), or a query text (``MATCH ... RETURN ...``) to its rows."""
        if isinstance(text, dict) and text.get("type") == "Let":
            return self.let({name: O.step_from_json(step) for name, step in text["bindings"].items()}, text.get("output"))
        if not isinstance(text, str):
            return self.chain(text, where)
        from loomgraph.plans.cypher import run

        self.checked("precompile", text=text)
        out = run(self, text, params)
        self.checked("postcompile", result=out)
        return out

    def validate(self, query: str | list | dict, params: dict[str, Any] | None = None, strict: bool = True) -> list[dict[str, str]]:
        """The problems of a chain or a query text, without running it: code and message of each; ``strict``: unknown columns too."""
        from loomgraph.plans.cypher import parse_query

        try:
            if isinstance(query, str):
                parse_query(query, params)
            ops = [] if isinstance(query, str) else O.from_json(query) if isinstance(query, dict) else list(query)
            O.check(ops, self if strict else None)
        except (GraphError, KeyError, TypeError) as problem:
            return [{"code": getattr(problem, "code", "E105"), "message": str(problem)}]
        return []

    def explain(self, text, params: dict[str, Any] | None = None) -> str:
        """The formatted physical plan of a query."""
        out = self.query(text, params)
        df = out if isinstance(out, DataFrame) else out.edges
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def let(self, bindings: dict[str, Any], output: str | None = None):
        """Named steps: each is a chain, ``("ref", name, chain)`` on an earlier step, or a function of (results); lazily, in order of need."""
        self.checked("prelet", bindings=bindings)
        done: dict[str, Any] = {}

        def need(name: str, above: tuple[str, ...] = ()):
            if name in above:
                raise GraphError(f"steps refer to each other: {' -> '.join([*above, name])}")
            if name not in bindings:
                raise SchemaProblem(f"no step is called {name!r}")
            if name not in done:
                step = bindings[name]
                if isinstance(step, tuple) and step[0] == "ref":
                    base = need(step[1], (*above, name))
                    done[name] = base.query(step[2])
                else:
                    done[name] = step(lambda other: need(other, (*above, name))) if callable(step) else self.query(step)
            return done[name]

        for name in bindings:
            need(name)
        out = done[output or list(bindings)[-1]]
        self.checked("postlet", result=out)
        return out

    def node_query(self, query: str) -> Graph:
        return self.replace(nodes=query_filter(self.with_nodes().nodes, query))
