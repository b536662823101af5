"""Pattern matching to rows: one row for each match, columns ``alias.field``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import GraphError, SchemaProblem, Unsupported
from loomgraph.functions import expressions as X
from loomgraph.functions.predicates import condition
from loomgraph.plans.ops import Compare, EdgeOp, NodeOp
from loomgraph.plans.storage import cut
from loomgraph.plans.traverse import compared, flagged, query_filter

#: Steps of an unbounded pattern at most; walks without a repeated relationship may be exponentially many.
MOST_STEPS = 30


@dataclass(frozen=True)
class NodePattern:
    alias: str
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, X.Node], ...] = ()
    filters: dict[str, Any] | None = None
    query: str | None = None


@dataclass(frozen=True)
class RelPattern:
    alias: str
    types: tuple[str, ...] = ()
    direction: str = "forward"
    props: tuple[tuple[str, X.Node], ...] = ()
    low: int = 1
    high: int | None = 1
    filters: dict[str, Any] | None = None
    query: str | None = None

    @property
    def many(self) -> bool:
        return (self.low, self.high) != (1, 1)


@dataclass
class Rows:
    """A frame and its entities: alias to {"id", "hidden", "kind"}."""

    df: DataFrame
    entities: dict[str, dict[str, Any]] = field(default_factory=dict)

    def scope(self) -> X.Scope:
        return X.Scope(self.df, self.entities)


def key(alias: str, name: str) -> Column:
    return F.col(f"`{alias}.{name}`")


def prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns))


def _matching(df: DataFrame, p, entity: dict[str, Any]) -> DataFrame:
    """A table's rows that fit a pattern's own conditions, with prefixed columns."""
    if p.filters or p.query:
        df = query_filter(df.filter(condition(df, p.filters)), p.query)
    out = prefixed(df, p.alias)
    scope = X.Scope(out, {p.alias: entity})
    for label in getattr(p, "labels", ()):
        out = out.filter(X.label_test(scope, p.alias, label))
    if types := getattr(p, "types", ()):
        if f"{p.alias}.type" not in scope.kinds:
            raise Unsupported("relationship types need a column 'type'")
        out = out.filter(key(p.alias, "type").isin(list(types)))
    for name, value in p.props:
        out = out.filter(F.coalesce(X.compile_(X.Node("=", (X.Node("prop", (X.Node("name", (p.alias,)), name)), value)), scope)[0], F.lit(False)))
    return out


class Matcher:
    """Matches of comma patterns over one graph; relationships of one clause are distinct."""

    def __init__(self, g):
        self.g = g.with_nodes().with_edge_ids()
        self.used: list[tuple[str, bool]] = []
        #: Conditions between aliases; each holds from the step that binds its last alias.
        self.where: list[Compare] = []

    def node_entity(self) -> dict[str, Any]:
        return {"id": self.g.node, "hidden": {self.g.node} if self.g.node.startswith("__") else set(), "kind": "node"}

    def rel_entity(self) -> dict[str, Any]:
        return {"id": self.g.edge, "hidden": {x for x in (self.g.edge,) if x.startswith("__")}, "kind": "rel"}

    def nodes(self, p: NodePattern) -> DataFrame:
        return _matching(self.g.nodes, p, self.node_entity())

    def start(self, rows: Rows | None, p: NodePattern, alone: bool) -> Rows:
        entity = self.node_entity()
        if rows is None:
            return Rows(self.nodes(p), {p.alias: entity})
        if p.alias in rows.entities:
            return self.bound(rows, p)
        if not alone and any(e["kind"] == "node" for e in rows.entities.values()):
            raise Unsupported("patterns that aren't connected; only lone nodes may be combined freely")
        return Rows(rows.df.crossJoin(self.nodes(p)), rows.entities | {p.alias: entity})

    def bound(self, rows: Rows, p: NodePattern) -> Rows:
        scope, out = rows.scope(), rows.df
        for label in p.labels:
            out = out.filter(X.label_test(scope, p.alias, label))
        for name, value in p.props:
            out = out.filter(F.coalesce(X.compile_(X.Node("=", (X.Node("prop", (X.Node("name", (p.alias,)), name)), value)), scope)[0], F.lit(False)))
        return Rows(out, rows.entities)

    def path(self, rows: Rows | None, elements: list[Any]) -> Rows:
        """Adds a path (node, rel, node, ...) to the rows."""
        if rows is not None and len(elements) > 1 and elements[0].alias not in rows.entities:
            bound = next((i for i in range(0, len(elements), 2) if elements[i].alias in rows.entities), None)
            if bound is not None:
                # Walk from the bound node in both directions.
                flip = {"forward": "reverse", "reverse": "forward", "undirected": "undirected"}
                left = [replace(e, direction=flip[e.direction]) if isinstance(e, RelPattern) else e for e in elements[bound::-1]]
                rows = self.path(rows, left)
                return self.path(rows, elements[bound:]) if bound < len(elements) - 1 else rows
        rows = self.held(self.start(rows, elements[0], len(elements) == 1))
        for i in range(1, len(elements), 2):
            rows = self.held(self.step(rows, elements[i - 1].alias, elements[i], elements[i + 1]))
        return rows

    def held(self, rows: Rows) -> Rows:
        """The rows for which the conditions hold whose aliases are all bound by now."""
        df, later = rows.df, []
        for c in self.where:
            if {c.left[0], c.right[0]} <= rows.entities.keys():
                df = df.filter(F.coalesce(compared(c.op, key(*c.left), key(*c.right)), F.lit(False)))
            else:
                later.append(c)
        self.where = later
        return Rows(df, rows.entities)

    def edges(self, r: RelPattern) -> list[tuple[DataFrame, str, str]]:
        """(edges, column of the near end, of the far end) for each way."""
        e, s, d = _matching(self.g.edges, r, self.rel_entity()), f"{r.alias}.{self.g.src}", f"{r.alias}.{self.g.dst}"
        ends = lambda df, a, b: df.withColumns({"__near": F.col(f"`{a}`"), "__far": F.col(f"`{b}`")})
        one, back = ends(e, s, d), ends(e, d, s)
        return {"forward": lambda: one, "reverse": lambda: back, "undirected": lambda: one.unionByName(back.filter("__near != __far"))}[r.direction]()

    def step(self, rows: Rows, near: str, r: RelPattern, p: NodePattern) -> Rows:
        if r.alias in rows.entities:
            raise Unsupported(f"relationship {r.alias!r} is bound twice")
        near_id = key(near, self.g.node)
        out = self.steps(rows.df, near_id, r) if r.many else rows.df.join(self.edges(r), near_id == F.col("__near"), "inner")
        for other, many in self.used:
            mine = key(r.alias, "__trail") if r.many else key(r.alias, self.g.edge)
            theirs = key(other, "__trail") if many else key(other, self.g.edge)
            if r.many and many:
                out = out.filter(~F.arrays_overlap(mine, theirs))
            elif r.many or many:
                out = out.filter(~(F.array_contains(mine, theirs) if r.many else F.array_contains(theirs, mine)))
            else:
                out = out.filter(mine != theirs)
        self.used.append((r.alias, r.many))
        entities = rows.entities | ({} if r.many else {r.alias: self.rel_entity()})
        if p.alias in rows.entities:
            out = out.filter(F.col("__far") == key(p.alias, self.g.node))
            return self.bound(Rows(out.drop("__near", "__far"), entities), p)
        out = out.join(self.nodes(p), F.col("__far") == key(p.alias, self.g.node), "inner").drop("__near", "__far")
        return Rows(out, entities | {p.alias: self.node_entity()})

    def steps(self, df: DataFrame, near_id: Column, r: RelPattern) -> DataFrame:
        """``df`` with __near, __far and the trail of relationship ids of each walk that repeats none."""
        trail, edge = f"{r.alias}.__trail", self.g.edge
        kind = self.g.edges.schema[edge].dataType.simpleString()
        hop = self.edges(r).select("__near", F.col("__far").alias("__to"), key(r.alias, edge).alias("__e"))
        at = df.withColumns({"__near": near_id, "__far": near_id, trail: F.array().cast(f"array<{kind}>")})
        parts, h = ([at] if r.low == 0 else []), 0
        while r.high is None or h < r.high:
            h += 1
            if r.high is None and h > MOST_STEPS:
                raise GraphError(f"an unbounded pattern goes on after {MOST_STEPS} steps; give it a bound")
            joined = at.join(hop.withColumnRenamed("__near", "__from"), F.col("__far") == F.col("__from"))
            at = joined.filter(~F.coalesce(F.array_contains(F.col(f"`{trail}`"), F.col("__e")), F.lit(False))).withColumns({trail: F.array_append(F.col(f"`{trail}`"), F.col("__e")), "__far": F.col("__to")}).drop("__from", "__to", "__e")
            if r.high is None:
                at = cut(at)
                if at.isEmpty():
                    break
            if h >= r.low:
                parts.append(at)
        return reduce(DataFrame.unionByName, parts) if parts else at.limit(0)


def pattern_of(ops: list[Any]) -> list[Any]:
    """A chain as a path pattern; matchers without a name get one."""
    out: list[Any] = []
    for i, op in enumerate(ops):
        if isinstance(op, NodeOp):
            out.append(NodePattern(op.name or f"__n{i}", filters=op.filter_dict, query=op.query))
        else:
            if not out or isinstance(out[-1], RelPattern):
                out.append(NodePattern(f"__s{i}"))
            low, high = op.bounds()
            if op.source_node_match or op.destination_node_match or op.source_node_query or op.destination_node_query:
                raise Unsupported("end conditions of an edge beside conditions between aliases")
            out.append(RelPattern(op.name or f"__r{i}", direction=op.direction, low=low, high=high, filters=op.edge_match, query=op.edge_query))
    if not out or isinstance(out[-1], RelPattern):
        out.append(NodePattern("__last"))
    return out


def bindings(g, ops: list[Any]) -> Rows:
    """A row for each match of a chain, with all columns of each alias."""
    return Matcher(g).path(None, pattern_of(ops))


def bound_rows(g, ops: list[Any], neq: list[str] | None = None) -> DataFrame:
    """The rows of ``bindings`` without the columns of unnamed matchers; ``neq``: two aliases whose nodes must differ."""
    rows = bindings(g, ops)
    df = rows.df
    if neq:
        a, b = (key(x, g.node) for x in neq)
        df = df.filter(a != b)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("__") and not c.partition(".")[2].startswith("__")))


def endpoint_rows(g, endpoints: dict[str, str]) -> DataFrame:
    """A row for each edge, with the columns of the node at its ``src`` or ``dst`` end under each alias."""
    g = g.with_nodes()
    out = g.edges
    for alias, end in endpoints.items():
        column = {"src": g.src, "dst": g.dst}.get(end)
        if column is None:
            raise SchemaProblem(f"an edge has no end {end!r}")
        out = out.join(prefixed(g.nodes, alias), F.col(f"`{column}`") == key(alias, g.node))
    return out


def same_path(g, ops: list[Any], where: list[Compare]):
    """The subgraph of the matches for which conditions between aliases hold, with a boolean column for each name."""
    matcher = Matcher(g)
    pattern = pattern_of(ops)
    known = {p.alias for p in pattern if not getattr(p, "many", False)}
    if unknown := sorted({x for c in where for x in (c.left[0], c.right[0])} - known):
        raise SchemaProblem(f"no matcher is called {', '.join(unknown)}")
    found = arms(matcher, pattern, list(where))
    if found is None:
        matcher.where = list(where)
        rows = matcher.path(None, pattern).df
        found = {p.alias: rows for p in pattern}
    g = kept(matcher, found, pattern)
    nodes, edges = g.nodes, g.edges
    for p in pattern:
        if not p.alias.startswith("__"):
            if isinstance(p, NodePattern):
                nodes = flagged(nodes, g.node, found[p.alias].select(key(p.alias, g.node).alias(g.node)), p.alias)
            elif not p.many:
                edges = flagged(edges, g.edge, found[p.alias].select(key(p.alias, g.edge).alias(g.edge)), p.alias)
    return g.replace(nodes=nodes, edges=edges)


def arms(matcher: Matcher, pattern: list[Any], where: list[Compare]) -> dict[str, DataFrame] | None:
    """Of two single steps that meet at a node, with at most one condition between them: by alias, rows of its arm that are in a match.

    A row is in one if the other arm's extreme value at the node, over the edges but the row's own, fits the condition;
    so there is no row for each match.  None for other patterns.
    """
    if len(pattern) != 5 or len({p.alias for p in pattern}) < 5 or any(p.many for p in pattern[1::2]):
        return None
    sides = ({p.alias for p in pattern[:3]}, {p.alias for p in pattern[2:]})
    across = [c for c in where if not any({c.left[0], c.right[0]} <= s for s in sides)]
    if len(across) > 1:
        return None
    g, middle, rels = matcher.g, pattern[2].alias, (pattern[1].alias, pattern[3].alias)
    ends = [F.lit(1), F.lit(1)]
    way = "<="
    if across:
        c, way = across[0], across[0].op
        ends = [key(*c.left), key(*c.right)]
        if c.left[0] not in sides[0]:
            ends, way = ends[::-1], {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(way, way)
    parts = []
    for side, steps, rel, value in zip(sides, (pattern[:3], pattern[2:]), rels, ends, strict=True):
        one = Matcher(g)
        one.where = [c for c in where if {c.left[0], c.right[0]} <= side]
        df = one.path(None, steps).df
        parts.append(df.withColumns({"__m": key(middle, g.node), "__e": key(rel, g.edge), "__x": value}).filter("__e IS NOT NULL AND __x IS NOT NULL"))
    flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    left, right = able(parts[0], parts[1], way), able(parts[1], parts[0], flip.get(way, way))
    return {p.alias: left if i < 3 else right for i, p in enumerate(pattern)}


def able(mine: DataFrame, theirs: DataFrame, way: str) -> DataFrame:
    """Rows (__m, __e, __x, ...) of ``mine`` with a row of ``theirs`` at the same node, of another edge, for which mine ``way`` theirs."""
    if way == "==":
        seen = theirs.groupBy("__m", "__x").agg(F.min("__e").alias("__lo"), F.max("__e").alias("__hi"))
        return mine.join(seen, ["__m", "__x"]).filter("__lo != __hi OR __lo != __e")
    each = theirs.groupBy("__m", "__e").agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    first = each.groupBy("__m").agg(F.min(F.struct("lo", "__e")).alias("lo1"), F.max(F.struct("hi", "__e")).alias("hi1"))
    rest = each.join(first, "__m")
    second = rest.groupBy("__m").agg(F.min(F.when(F.col("__e") != F.col("lo1.__e"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("__e") != F.col("hi1.__e"), F.col("hi"))).alias("hi2"))
    out = mine.join(first.join(second, "__m"), "__m")
    low = F.when(F.col("__e") == F.col("lo1.__e"), F.col("lo2")).otherwise(F.col("lo1.lo"))
    high = F.when(F.col("__e") == F.col("hi1.__e"), F.col("hi2")).otherwise(F.col("hi1.hi"))
    x = F.col("__x")
    fits = {"<": x < high, "<=": x <= high, ">": x > low, ">=": x >= low, "!=": (x < high) | (x > low)}[way]
    return out.filter(F.coalesce(fits, F.lit(False))).drop("lo1", "lo2", "hi1", "hi2")


def kept(matcher: Matcher, rows: DataFrame | dict[str, DataFrame], pattern: list[Any]):
    """The graph of the nodes and edges of some matches: rows of them all, or those of each alias."""
    g = matcher.g
    of = rows if isinstance(rows, dict) else {p.alias: rows for p in pattern}
    node_ids = [of[p.alias].select(key(p.alias, g.node).alias(g.node)) for p in pattern if isinstance(p, NodePattern)]
    edge_ids = [of[p.alias].select((F.explode(key(p.alias, "__trail")) if p.many else key(p.alias, g.edge)).alias(g.edge)) for p in pattern if isinstance(p, RelPattern)]
    edges = g.edges.join(reduce(DataFrame.unionByName, edge_ids).distinct(), g.edge, "left_semi") if edge_ids else g.edges.limit(0)
    if any(p.many for p in pattern if isinstance(p, RelPattern)):
        node_ids += [edges.select(F.col(f"`{x}`").alias(g.node)) for x in (g.src, g.dst)]
    nodes = g.nodes.join(reduce(DataFrame.unionByName, node_ids).distinct(), g.node, "left_semi")
    return g.replace(nodes=nodes, edges=edges)
