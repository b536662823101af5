"""The chain algebra: node and edge matchers, row calls, and their JSON form."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from dataclasses import replace as replaced
from typing import Any

from loomgraph.errors import SchemaProblem, Unsupported
from loomgraph.functions import predicates


@dataclass(frozen=True)
class NodeOp:
    filter_dict: dict[str, Any] | None = None
    name: str | None = None
    query: str | None = None


@dataclass(frozen=True)
class EdgeOp:
    """``min_hops`` to ``max_hops`` steps (``hops``: exactly up to it from 1); ``to_fixed_point``: any number.

    ``output_min_hops`` and ``output_max_hops`` keep the edges of these steps, and their ends; ``label_node_hops`` and
    ``label_edge_hops`` name columns for the least step that reached a node or walked an edge, 0 for seeds
    where ``label_seeds`` is set; ``prune_to_endpoints`` leaves out the nodes between the first and the last.
    """

    direction: str = "forward"
    edge_match: dict[str, Any] | None = None
    hops: int | None = 1
    min_hops: int | None = None
    max_hops: int | None = None
    to_fixed_point: bool = False
    source_node_match: dict[str, Any] | None = None
    destination_node_match: dict[str, Any] | None = None
    source_node_query: str | None = None
    destination_node_query: str | None = None
    edge_query: str | None = None
    name: str | None = None
    output_min_hops: int | None = None
    output_max_hops: int | None = None
    label_node_hops: str | None = None
    label_edge_hops: str | None = None
    label_seeds: bool = False
    prune_to_endpoints: bool = False
    include_zero_hop_seed: bool = False

    def bounds(self) -> tuple[int, int | None]:
        """(least, most) hops; most None: no bound."""
        low = 1 if self.min_hops is None else self.min_hops
        high = None if self.to_fixed_point else self.max_hops if self.max_hops is not None else self.hops
        if low < 0 or (high is not None and (high < 0 or low > high)):
            raise SchemaProblem(f"hops from {low} to {high} aren't a range")
        first, last = self.output_min_hops, self.output_max_hops
        if first is not None and (first < 0 or last is not None and first > last):
            raise SchemaProblem(f"output_min_hops ({first}) cannot exceed output_max_hops ({last}) or be negative")
        if first is not None and high is not None and first > high:
            raise SchemaProblem(f"output_min_hops ({first}) cannot exceed max_hops ({high})")
        if last is not None and last < low:
            raise SchemaProblem(f"output_max_hops ({last}) cannot be below min_hops ({low})")
        return low, high

    @property
    def sliced(self) -> bool:
        return self.output_min_hops is not None or self.output_max_hops is not None


@dataclass(frozen=True)
class Call:
    function: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Compare:
    """A condition between two aliases of one path: ``left`` and ``right`` are (alias, column)."""

    left: tuple[str, str]
    op: str
    right: tuple[str, str]


def n(filter_dict=None, name=None, query=None) -> NodeOp:
    return NodeOp(filter_dict, name, query)


def e_forward(edge_match=None, **options) -> EdgeOp:
    return EdgeOp("forward", edge_match, **options)


def e_reverse(edge_match=None, **options) -> EdgeOp:
    return EdgeOp("reverse", edge_match, **options)


def e_undirected(edge_match=None, **options) -> EdgeOp:
    return EdgeOp("undirected", edge_match, **options)


e = e_undirected


def call(function: str, params: dict[str, Any] | None = None) -> Call:
    return Call(function, params or {})


def rows(table: str = "nodes", source: str | None = None, alias_endpoints=None, binding_ops=None, alias_prefilters=None) -> Call:
    """The table that row calls work on; ``binding_ops`` are matchers, or their wire form."""
    params = {"table": table, "source": source, "alias_endpoints": alias_endpoints, "binding_ops": _wired(binding_ops), "alias_prefilters": alias_prefilters}
    return Call("rows", {k: v for k, v in params.items() if v is not None})


def _wired(ops) -> list[dict[str, Any]] | None:
    return None if ops is None else [op if isinstance(op, dict) else to_json([op])["chain"][0] for op in ops]


def anti_semi_apply(binding_ops, join_aliases, neq=None) -> Call:
    return Call("anti_semi_apply", {"binding_ops": _wired(binding_ops), "join_aliases": join_aliases, "neq": neq})


def semi_apply_mark(binding_ops, join_aliases, out_col: str, neq=None) -> Call:
    return Call("semi_apply_mark", {"binding_ops": _wired(binding_ops), "join_aliases": join_aliases, "out_col": out_col, "neq": neq})


def join_apply(binding_ops, join_aliases, how: str = "inner") -> Call:
    return Call("join_apply", {"binding_ops": _wired(binding_ops), "join_aliases": join_aliases, "how": how})


def search_any(term: str, **options) -> Call:
    return Call("search_any", {"term": term, **options})


def fill_empty_row() -> Call:
    return Call("fill_empty_row", {})


def count_table(alias: str = "count") -> Call:
    return Call("count_table", {"alias": alias})


def select(items) -> Call:
    return Call("select", {"items": items})


return_ = select


def with_(items, extend: bool = False) -> Call:
    return Call("with_", {"items": items, "extend": extend})


def where_rows(filter_dict=None, expr=None) -> Call:
    return Call("where_rows", {"filter_dict": filter_dict, "expr": expr})


def group_by(keys, aggregations) -> Call:
    return Call("group_by", {"keys": keys, "aggregations": aggregations})


def order_by(keys) -> Call:
    return Call("order_by", {"keys": keys})


def skip(count) -> Call:
    return Call("skip", {"count": count})


def limit(count) -> Call:
    return Call("limit", {"count": count})


def distinct() -> Call:
    return Call("distinct", {})


def unwind(expr, as_) -> Call:
    return Call("unwind", {"expr": expr, "as_": as_})


def drop_cols(cols) -> Call:
    return Call("drop_cols", {"cols": cols})


def col(alias: str, column: str) -> tuple[str, str]:
    return alias, column


def compare(left, op: str, right) -> Compare:
    if op not in ("==", "!=", "<", "<=", ">", ">="):
        raise SchemaProblem(f"no comparison is written {op!r}")
    return Compare(left, op, right)


def _plain(value):
    if isinstance(value, predicates.Predicate):
        return value.to_json()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _read(value):
    if isinstance(value, dict) and value.get("type") in predicates.READ:
        return predicates.from_json(value)
    return {k: _read(v) for k, v in value.items()} if isinstance(value, dict) else value


def to_json(ops: list[Any]) -> dict[str, Any]:
    kinds = {NodeOp: "Node", EdgeOp: "Edge", Call: "Call"}
    raw = lambda op: {k: getattr(op, k) for k in asdict(op)}  # noqa: E731  keeps predicates
    return {"type": "Chain", "chain": [{"type": kinds[type(op)], **_plain(raw(op))} for op in ops]}


def from_json(data: dict[str, Any]) -> list[Any]:
    out = []
    for item in data["chain"]:
        args = {k: _read(v) for k, v in item.items() if k != "type"}
        kind = {"Node": NodeOp, "Edge": EdgeOp, "Call": Call}.get(item["type"])
        if kind is None:
            raise SchemaProblem(f"no operation is called {item['type']!r}")
        out.append(kind(**args))
    return out


def step_from_json(data: dict[str, Any]) -> Any:
    """A named step: a chain, one operation, or (``Ref``) a chain on an earlier step's graph."""
    if data["type"] == "Ref":
        return "ref", data["ref"], from_json({"chain": data.get("chain", [])})
    return from_json(data if data["type"] == "Chain" else {"chain": [data]})


def check(ops: list[Any], g=None) -> None:
    """Raises for a chain that can't run: unknown calls, bounds that aren't ranges, adjacent matchers, and columns that ``g`` lacks."""
    from loomgraph.operators.registry import known
    from loomgraph.plans.rows import APPLIES, CALLS

    called = False
    for i, op in enumerate(ops):
        if isinstance(op, Call):
            called = True
            if op.function != "rows" and op.function not in CALLS and op.function not in APPLIES and not known(op.function):
                raise Unsupported(f"there is no call {op.function!r}")
            continue
        if not isinstance(op, (NodeOp, EdgeOp)):
            raise SchemaProblem(f"{op!r} is no step of a chain")
        if called:
            raise SchemaProblem("a matcher can't follow a row call")
        if isinstance(op, NodeOp) and i and isinstance(ops[i - 1], NodeOp):
            raise SchemaProblem("two node matchers follow each other")
        if isinstance(op, EdgeOp):
            op.bounds()
        if g is not None:
            tables = {"filter_dict": g.with_nodes().nodes} if isinstance(op, NodeOp) else {"edge_match": g.edges, "source_node_match": g.with_nodes().nodes, "destination_node_match": g.with_nodes().nodes}
            for name, table in tables.items():
                predicates.condition(table, {k: v for k, v in (getattr(op, name) or {}).items() if not (isinstance(v, predicates.Predicate) and v.name == "duplicated")})
