"""The query language: a read-only subset of openCypher, parsed here and translated to DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import SchemaProblem, SyntaxProblem, Unsupported
from loomgraph.functions import expressions as X
from loomgraph.plans.bindings import kept, Matcher, NodePattern, RelPattern, Rows, key
from loomgraph.plans.rows import sort_key, whole_number

CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "UNION", "ORDER", "SKIP", "LIMIT", "CALL", "YIELD", ""}
WRITES = {"CREATE", "DELETE", "SET", "MERGE", "REMOVE", "DETACH", "FOREACH", "LOAD", "DROP"}


@dataclass
class Match:
    paths: list[tuple[str | None, str | None, list[Any]]]  # (path name, shortest kind, elements)
    optional: bool = False
    where: X.Node | None = None


@dataclass
class Unwind:
    expr: X.Node
    name: str


@dataclass
class CallProcedure:
    name: str
    args: tuple[X.Node, ...]
    columns: list[tuple[str, str]]


@dataclass
class Project:
    items: list[tuple[str, X.Node]]
    star: bool = False
    distinct: bool = False
    order: list[tuple[X.Node, str]] = field(default_factory=list)
    skip: X.Node | None = None
    limit: X.Node | None = None
    where: X.Node | None = None
    last: bool = False


@dataclass
class GraphBody:
    use: str | None
    clauses: list[Any]


@dataclass
class Program:
    named: list[tuple[str, GraphBody]]
    use: str | None
    graph: GraphBody | None
    branches: list[list[Any]]
    every: list[bool]


class QueryParser(X.Parser):
    fresh = 0

    def anonymous(self, kind: str) -> str:
        self.fresh += 1
        return f"__{kind}{self.fresh}"

    def program(self) -> Program:
        """Named graphs, the graph that is used, and a query or a graph."""
        named = []
        while self.peek() == "GRAPH" and self.kind(1) == "name":
            self.next()
            name = self.name()
            self.expect("=")
            named.append((name, self.graph()))
        use = self.name() if self.accept("USE") else None
        if self.peek() == "GRAPH" and self.peek(1) == "{":
            out = Program(named, use, self.graph(), [], [])
            self.accept(";")
            if self.i < len(self.tokens):
                raise SyntaxProblem(f"unexpected {self.peek()!r}")
            return out
        return Program(named, use, None, *self.query())

    def graph(self) -> GraphBody:
        """``GRAPH { [USE name] MATCH ... [WHERE ...] | CALL name.write(...) }``: what matches, or what a call makes."""
        self.expect("GRAPH")
        self.expect("{")
        body = GraphBody(self.name() if self.accept("USE") else None, [])
        while not self.accept("}"):
            if self.peek() == "MATCH":
                body.clauses.append(self.match())
            elif self.accept("CALL"):
                call = self.procedure()
                if not call.name.endswith(".write") or call.columns:
                    raise Unsupported(f"CALL {call.name} gives rows; inside GRAPH it is written {call.name}.write()")
                body.clauses.append(call)
            else:
                raise Unsupported(f"{self.peek() or 'the end'} inside GRAPH, which takes MATCH and CALL only")
        if not body.clauses:
            raise SyntaxProblem("GRAPH { } is empty")
        return body

    def query(self) -> tuple[list[list[Any]], list[bool]]:
        """Branches of a union, and whether each union keeps duplicates."""
        branches, every = [self.single()], []
        while self.accept("UNION"):
            every.append(self.accept("ALL"))
            branches.append(self.single())
        self.accept(";")
        if self.i < len(self.tokens):
            raise SyntaxProblem(f"unexpected {self.peek()!r}")
        return branches, every

    def single(self) -> list[Any]:
        out: list[Any] = []
        while self.peek() not in ("", "UNION", ";"):
            word = self.peek()
            if word in WRITES:
                raise Unsupported(f"{word}: queries only read")
            if word in ("MATCH", "OPTIONAL"):
                out.append(self.match())
            elif self.accept("UNWIND"):
                expr = self.expression()
                self.expect("AS")
                out.append(Unwind(expr, self.name()))
            elif self.accept("CALL"):
                out.append(self.procedure())
            elif self.accept("WITH"):
                out.append(self.projection(False))
            elif self.accept("RETURN"):
                out.append(self.projection(True))
            else:
                raise SyntaxProblem(f"no clause begins with {word!r}")
        if not out or not (isinstance(out[-1], Project) and out[-1].last) and not isinstance(out[-1], CallProcedure):
            raise SyntaxProblem("a query ends with RETURN")
        return out

    def match(self) -> Match:
        optional = self.accept("OPTIONAL")
        self.expect("MATCH")
        paths = [self.path()]
        while self.accept(","):
            paths.append(self.path())
        return Match(paths, optional, self.expression() if self.accept("WHERE") else None)

    def procedure(self) -> CallProcedure:
        name = self.name()
        while self.accept("."):
            name += "." + self.name()
        args = self._list(")") if self.accept("(") else ()
        columns = []
        if self.accept("YIELD"):
            while True:
                column = self.name()
                columns.append((column, self.name() if self.accept("AS") else column))
                if not self.accept(","):
                    break
        return CallProcedure(name, args, columns)

    def path(self):
        name = None
        if self.kind() == "name" and self.peek(1) == "=":
            name = self.name()
            self.next()
        if self.peek() in ("SHORTESTPATH", "ALLSHORTESTPATHS") and self.peek(1) == "(":
            kind = self.next().key
            self.expect("(")
            elements = self.elements()
            self.expect(")")
            return name, kind, elements
        return name, None, self.elements()

    def elements(self) -> list[Any]:
        out = [self.node_pattern()]
        while self.peek() in ("-", "<-", "->", "<"):
            out += [self.rel_pattern(), self.node_pattern()]
        return out

    def node_pattern(self) -> NodePattern:
        self.expect("(")
        alias = self.name() if self.kind() == "name" else self.anonymous("n")
        labels = []
        while self.accept(":"):
            labels.append(self.name())
        props = self.props()
        self.expect(")")
        return NodePattern(alias, tuple(labels), props)

    def props(self):
        return tuple(self._atom().args) if self.peek() == "{" else ()

    def rel_pattern(self) -> RelPattern:
        left = self.accept("<-") or self.accept("<", "-")
        if not left and not self.accept("-"):
            raise SyntaxProblem(f"a relationship can't begin with {self.peek()!r}")
        alias, types, props, low, high = self.anonymous("r"), [], (), 1, 1
        if self.accept("["):
            if self.kind() == "name":
                alias = self.name()
            if self.accept(":"):
                types.append(self.name())
                while self.accept("|"):
                    self.accept(":")
                    types.append(self.name())
            if self.accept("*"):
                low, high = 1, None
                if self.kind() == "number":
                    # "1..3" may be read as numbers with points.
                    low = high = int(self.next().text)
                if self.accept(".."):
                    high = int(self.next().text) if self.kind() == "number" else None
            props = self.props()
            self.expect("]")
        right = self.accept("->") or self.accept("-", ">")
        if not right:
            self.expect("-")
        direction = "undirected" if left == right else "reverse" if left else "forward"
        return RelPattern(alias, tuple(types), direction, props, low, high)

    def projection(self, last: bool) -> Project:
        out = Project([], distinct=self.accept("DISTINCT"), last=last)
        while True:
            if self.accept("*"):
                out.star = True
            else:
                begin = self.tokens[self.i].at if self.i < len(self.tokens) else 0
                expr = self.expression()
                end = self.tokens[self.i].at if self.i < len(self.tokens) else len(self.text)
                out.items.append((self.name() if self.accept("AS") else self.text[begin:end].strip(), expr))
            if not self.accept(","):
                break
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                expr = self.expression()
                word = self.next().key if self.peek() in ("ASC", "DESC", "ASCENDING", "DESCENDING") else "ASC"
                out.order.append((expr, word))
                if not self.accept(","):
                    break
        if self.accept("SKIP") or self.accept("OFFSET"):
            out.skip = self.expression()
        if self.accept("LIMIT"):
            out.limit = self.expression()
        if self.accept("WHERE"):
            if last:
                raise SyntaxProblem("WHERE can't follow RETURN")
            out.where = self.expression()
        return out

    def _atom(self):
        # Pattern predicates: EXISTS { (a)-->(b) }, exists((a)-->(b)), and (a)-->(b) itself.
        if self.peek() == "EXISTS" and self.peek(1) in ("{", "("):
            saved = self.i
            self.next()
            end = "}" if self.next().text == "{" else ")"
            self.accept("MATCH")
            elements = self.elements()
            where = self.expression() if self.accept("WHERE") else None
            if not self.accept(end):
                self.i = saved
                raise Unsupported("EXISTS takes one pattern")
            return X.Node("pattern", (tuple(elements), where))
        if self.peek() == "(":
            saved, fresh = self.i, self.fresh
            try:
                elements = self.elements()
                if len(elements) > 1:
                    return X.Node("pattern", (tuple(elements), None))
            except SyntaxProblem:
                pass
            self.i, self.fresh = saved, fresh
        return super()._atom()


@lru_cache(256)
def _parsed(text: str):
    return QueryParser(text).program()


def parse(text: str, params: dict[str, Any] | None = None):
    return QueryParser(text, params).program() if params else _parsed(text)


parse_query = parse


def conjuncts(node: X.Node | None) -> list[X.Node]:
    if node is None:
        return []
    return [c for a in node.args for c in conjuncts(a)] if node.op == "AND" else [node]


def run(g, text: str, params: dict[str, Any] | None = None):
    """Rows of a query over a graph, or the graph of ``GRAPH { }`` or ``CALL name.write(...)``."""
    program, graphs = parse(text, params), {}

    def used(name: str | None, otherwise):
        if name is None:
            return otherwise
        if name not in graphs:
            raise SchemaProblem(f"no graph is called {name!r}")
        return graphs[name]

    for name, body in program.named:
        graphs[name] = constructed(used(body.use, g), body)
    g = used(program.use, g)
    if program.graph is not None:
        return constructed(used(program.graph.use, g), program.graph)
    if len(program.branches) == 1 and len(program.branches[0]) == 1 and isinstance(only := program.branches[0][0], CallProcedure) and only.name.endswith(".write"):
        return called(g, only)
    frames = [Translator(g).branch(b) for b in program.branches]
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise SchemaProblem("branches of a union have the same columns")
    out = frames[0]
    for frame, keep in zip(frames[1:], program.every, strict=True):
        out = out.unionByName(frame)
        out = out if keep else out.distinct()
    return out


def called(g, clause: CallProcedure):
    from loomgraph.operators.registry import written

    args = [a.args[0] if a.op == "lit" else {k: v.args[0] for k, v in a.args} for a in clause.args]
    return written(g, clause.name, *args)


def constructed(g, body: GraphBody):
    """The graph of a body: each MATCH keeps the nodes and edges of its matches, each CALL adds its results."""
    for clause in body.clauses:
        if isinstance(clause, CallProcedure):
            g = called(g, clause)
            continue
        tests = conjuncts(clause.where)
        matcher, rows = Matcher(g), None
        for _, shortest, elements in clause.paths:
            if shortest:
                raise Unsupported("a shortest path inside GRAPH")
            rows = matcher.path(rows, elements)
        for test in tests:
            if any(n.op == "pattern" for n in X.walk(test)) or len({n.args[0] for n in X.walk(test) if n.op == "name" and n.args[0] in rows.entities}) > 1:
                raise Unsupported("a condition inside GRAPH is on one node or relationship")
        df = rows.df
        for test in tests:
            df = df.filter(F.coalesce(X.compile_(test, rows.scope())[0].cast("boolean"), F.lit(False)))
        g = kept(matcher, df, [e for _, _, elements in clause.paths for e in elements])
    return g


class Translator:
    def __init__(self, g):
        self.g = g.with_nodes().with_edge_ids() if g.edges is not None else g
        self.rows: Rows | None = None

    def branch(self, clauses: list[Any]) -> DataFrame:
        for clause in self.counted(clauses):
            getattr(self, f"do_{type(clause).__name__.lower()}")(clause)
        return self.rows.df

    def counted(self, clauses: list[Any]) -> list[Any]:
        """The clauses still to do.  Where a query begins with two relationships that meet at a node and only counts its matches
        by that node, each arm is counted by itself: the matches are the product of the two less those that use one relationship
        in both, so none of them is a row.
        """
        if len(clauses) < 2 or not isinstance(clauses[0], Match) or not isinstance(clauses[1], Project):
            return clauses
        clause, project = clauses[:2]
        if clause.optional or len(clause.paths) != 1 or clause.paths[0][0] or clause.paths[0][1] or len(clause.paths[0][2]) != 5 or project.star:
            return clauses
        a, r, n, s, b = clause.paths[0][2]
        sides = {n.alias: [], a.alias: [], b.alias: []}
        home = {n.alias: n.alias, a.alias: a.alias, r.alias: a.alias, b.alias: b.alias, s.alias: b.alias}
        if r.many or s.many or len(home) < 5:
            return clauses
        names = lambda x: {y.args[0] for y in X.walk(x) if y.op == "name"} & home.keys()
        for test in conjuncts(clause.where):
            touched = {home[x] for x in names(test)}
            if len(touched) > 1 or any(y.op == "pattern" for y in X.walk(test)):
                return clauses
            sides[min(touched, default=n.alias)].append(test)
        exprs = [e for _, e in project.items] + [e for e, _ in project.order]
        count = X.Node("call", ("count", False, ()))
        if not any(map(X.is_aggregate, exprs)) or any(names(e) - {n.alias} for e in exprs) or any(y.op == "call" and y.args[0] in X.AGGREGATES and y != count or y.op == "pattern" for e in exprs for y in X.walk(e)):
            return clauses
        flip = {"forward": "reverse", "reverse": "forward", "undirected": "undirected"}
        matcher, arms = Matcher(self.g), []
        node, edge = matcher.g.node, matcher.g.edge
        holds = lambda rows, tests: reduce(lambda df, t: df.filter(F.coalesce(X.compile_(t, rows.scope())[0].cast("boolean"), F.lit(False))), tests, rows.df)
        for rel, far in ((replace(r, direction=flip[r.direction]), a), (s, b)):
            arm = Rows(matcher.edges(rel).join(matcher.nodes(far), F.col("__far") == key(far.alias, node)), {rel.alias: matcher.rel_entity(), far.alias: matcher.node_entity()})
            arms.append(holds(arm, sides[far.alias]).select(F.col("__near").alias("m"), key(rel.alias, edge).alias("e")).filter("e IS NOT NULL"))
        once = F.count(F.lit(1))
        left, right = (x.groupBy("m").agg(once.alias(c)) for x, c in zip(arms, "xy", strict=True))
        each = [x.groupBy("m", "e").agg(once.alias(c)) for x, c in zip(arms, "xy", strict=True)]
        both = each[0].join(each[1], ["m", "e"]).groupBy("m").agg(F.sum(F.col("x") * F.col("y")).alias("z"))
        sums = left.join(right, "m").join(both, "m", "left").select("m", (F.col("x") * F.col("y") - F.coalesce("z", F.lit(0))).alias("__matches")).filter("__matches > 0")
        middle = Rows(matcher.nodes(n), {n.alias: matcher.node_entity()})
        self.rows = Rows(holds(middle, sides[n.alias]).join(sums, key(n.alias, node) == F.col("m")).drop("m"), middle.entities)
        total = X.Node("call", ("sum", False, (X.Node("name", ("__matches",)),)))
        counts = lambda x: total if x == count else X.Node(x.op, tuple(map(counts, x.args))) if isinstance(x, X.Node) else tuple(map(counts, x)) if isinstance(x, tuple) else x
        return [replace(project, items=[(alias, counts(e)) for alias, e in project.items], order=[(counts(e), way) for e, way in project.order]), *clauses[2:]]

    # MATCH

    def do_match(self, clause: Match) -> None:
        if clause.optional:
            self.optional(clause)
            return
        matcher = Matcher(self.g)
        for name, shortest, elements in clause.paths:
            if shortest:
                self.shortest(name, elements)
            else:
                self.rows = matcher.path(self.rows, elements)
                if name:
                    self.name_path(name, elements)
        self.where(clause.where)

    def name_path(self, name: str, elements: list[Any]) -> None:
        length = sum((F.size(key(e.alias, "__trail")).cast("long") if e.many else F.lit(1).cast("long") for e in elements if isinstance(e, RelPattern)), F.lit(0).cast("long"))
        self.rows = Rows(self.rows.df.withColumn(f"{name}.__length", length), self.rows.entities)

    def shortest(self, name: str | None, elements: list[Any]) -> None:
        """Adds the least number of hops between two nodes; pairs without a path have no row."""
        if len(elements) != 3 or not name:
            raise Unsupported("a shortest path is named and has one relationship")
        a, r, b = elements
        matcher, known = Matcher(self.g), self.rows.entities if self.rows is not None else {}
        if a.alias not in known and b.alias in known:
            a, b, r = b, a, replace(r, direction={"forward": "reverse", "reverse": "forward"}.get(r.direction, r.direction))
        self.rows = matcher.bound(self.rows, a) if a.alias in known else matcher.start(self.rows, a, True)
        node = matcher.g.node
        hop = matcher.edges(r).select(F.col("__near").alias("u"), F.col("__far").alias("v")).distinct()
        far = multi_source(hop, self.rows.df.select(key(a.alias, node).alias("s")).distinct(), r.high).filter(F.col("hops") >= r.low)
        df = self.rows.df.join(far, key(a.alias, node) == F.col("s"))
        if b.alias in self.rows.entities:
            self.rows = matcher.bound(Rows(df.filter(key(b.alias, node) == F.col("id")), self.rows.entities), b)
        else:
            # The far end comes after the hops: no row for each pair of nodes.
            self.rows = Rows(df.join(matcher.nodes(b), key(b.alias, node) == F.col("id")), self.rows.entities | {b.alias: matcher.node_entity()})
        self.rows = Rows(self.rows.df.withColumn(f"{name}.__length", F.col("hops").cast("long")).drop("s", "id", "hops"), self.rows.entities)

    def optional(self, clause: Match) -> None:
        """A left join with the arm's own matches; its WHERE is part of the join's condition."""
        if self.rows is None:
            self.rows = Rows(self.g.edges.sparkSession.range(1).select(F.lit(1).alias("__one")))
        bound = self.rows.entities
        shared: list[tuple[str, str]] = []
        paths = []
        for _, shortest, elements in clause.paths:
            if shortest:
                raise Unsupported("an optional shortest path")
            own = []
            for e in elements:
                if isinstance(e, NodePattern) and e.alias in bound:
                    inner = f"__o_{e.alias}"
                    if (e.alias, inner) not in shared:
                        shared.append((e.alias, inner))
                    e = NodePattern(inner, e.labels, e.props)
                own.append(e)
            paths.append(own)
        matcher, arm = Matcher(self.g), None
        for own in paths:
            arm = matcher.path(arm, own)
        node = matcher.g.node
        tests = [key(outer, node) == key(inner, node) for outer, inner in shared]
        new = {a: e for a, e in arm.entities.items() if not a.startswith("__")}
        keep = [c for c in arm.df.columns if not c.startswith("__o_") or any(c == f"{inner}.{node}" for _, inner in shared)]
        right = arm.df.select(*(F.col(f"`{c}`") for c in keep))
        if clause.where is not None:
            both = X.Scope.__new__(X.Scope)
            both.df, both.entities, both.strict, both.local = self.rows.df, bound | new, False, {}
            both.kinds = {f.name: f.dataType for f in [*self.rows.df.schema, *right.schema]}
            tests.append(F.coalesce(X.compile_(clause.where, both)[0].cast("boolean"), F.lit(False)))
        df = self.rows.df.join(right, reduce(lambda x, y: x & y, tests) if tests else F.lit(True), "left")
        self.rows = Rows(df.drop(*(f"{inner}.{node}" for _, inner in shared), "__one"), bound | new)

    # WHERE

    def where(self, node: X.Node | None) -> None:
        """Top-level pattern predicates become semi or anti joins, others a mark."""
        for c in conjuncts(node):
            negated = c.op == "NOT" and c.args[0].op == "pattern"
            if c.op == "pattern" or negated:
                self.exists(c.args[0] if negated else c, "left_anti" if negated else "left_semi")
            else:
                if any(n.op == "pattern" for n in X.walk(c)):
                    c = self.marked(c)
                test = X.compile_(c, self.rows.scope())[0]
                self.rows = Rows(self.rows.df.filter(F.coalesce(test.cast("boolean"), F.lit(False))), self.rows.entities)

    def matches(self, node: X.Node) -> tuple[DataFrame, list[tuple[str, str]]]:
        elements, where = node.args
        shared, own = [], []
        for e in elements:
            if isinstance(e, NodePattern) and e.alias in self.rows.entities:
                inner = f"__x_{e.alias}"
                shared.append((e.alias, inner))
                e = NodePattern(inner, e.labels, e.props)
            own.append(e)
        if not shared:
            raise Unsupported("a pattern predicate that shares no node with the rows")
        arm = Matcher(self.g).path(None, own)
        if where is not None:
            names = {a: i for a, i in shared}
            rename = lambda n: n if not isinstance(n, X.Node) else X.Node(n.op, tuple(names.get(x, x) if n.op == "name" else tuple(map(rename, x)) if isinstance(x, tuple) else rename(x) for x in n.args))
            arm = Rows(arm.df.filter(F.coalesce(X.compile_(rename(where), arm.scope())[0], F.lit(False))), arm.entities)
        return arm.df.select(*(key(i, self.g.node).alias(f"{i}.__id") for _, i in dict(shared).items())).distinct(), list(dict(shared).items())

    def exists(self, node: X.Node, how: str) -> None:
        keys, shared = self.matches(node)
        test = reduce(lambda a, b: a & b, [key(outer, self.g.node) == key(inner, "__id") for outer, inner in shared])
        self.rows = Rows(self.rows.df.join(keys, test, how), self.rows.entities)

    def marked(self, node: X.Node) -> X.Node:
        """Pattern predicates below OR, XOR and NOT become boolean columns."""
        if node.op == "pattern":
            keys, shared = self.matches(node)
            name = f"__mark{len(self.rows.df.columns)}"
            test = reduce(lambda a, b: a & b, [key(outer, self.g.node) == key(inner, "__id") for outer, inner in shared])
            df = self.rows.df.join(keys.withColumn(name, F.lit(True)), test, "left").withColumn(name, F.coalesce(name, F.lit(False)))
            self.rows = Rows(df.drop(*(f"{i}.__id" for _, i in shared)), self.rows.entities)
            return X.Node("name", (name,))
        return X.Node(node.op, tuple(self.marked(a) if isinstance(a, X.Node) else a for a in node.args))

    # UNWIND, CALL

    def do_unwind(self, clause: Unwind) -> None:
        if self.rows is None:
            self.rows = Rows(self.g.edges.sparkSession.range(1).select(F.lit(1).alias("__one")))
        c, kind = X.compile_(clause.expr, self.rows.scope())
        if isinstance(kind, X.T.ArrayType):
            df = self.rows.df.select("*", F.explode(c).alias(clause.name))
        else:
            df = self.rows.df.withColumn(clause.name, c).filter(F.col(f"`{clause.name}`").isNotNull())
        self.rows = Rows(df.drop("__one"), self.rows.entities)

    def do_callprocedure(self, clause: CallProcedure) -> None:
        from loomgraph.operators.registry import procedure

        if self.rows is not None:
            raise Unsupported("CALL after another clause")
        args = [a.args[0] if a.op == "lit" else {k: v.args[0] for k, v in a.args} for a in clause.args]
        df = procedure(self.g, clause.name, *args)
        if clause.columns:
            df = df.select(*(F.col(f"`{c}`").alias(a) for c, a in clause.columns))
        self.rows = Rows(df)

    # WITH, RETURN

    def do_project(self, clause: Project) -> None:
        if self.rows is None:
            self.rows = Rows(self.g.edges.sparkSession.range(1).select(F.lit(1).alias("__one")))
        items = list(clause.items)
        if clause.star:
            plain = [c for c in self.rows.df.columns if "." not in c and not c.startswith("__")]
            items = [(a, X.Node("name", (a,))) for a in [*(a for a in self.rows.entities if not a.startswith("__")), *plain]] + items
        if len({a for a, _ in items}) < len(items):
            raise SchemaProblem("two results have one name")
        rows, before = self.rows, self.rows
        if any(X.is_aggregate(e) for _, e in items):
            rows = self.aggregated(items)
            order_scope = rows.scope()
        else:
            columns, entities = [], {}
            for alias, expr in items:
                columns += self.projected(before, alias, expr, entities)
            extra = {}
            for i, (expr, _) in enumerate(clause.order):
                # ORDER BY may read what was there before the projection.
                if not self._known(expr, items):
                    extra[f"__order{i}"] = X.compile_(expr, before.scope())[0]
            rows = Rows(before.df.select(*columns, *(c.alias(k) for k, c in extra.items())), entities)
            if clause.distinct:
                if extra:
                    raise Unsupported("ORDER BY of what DISTINCT has dropped")
                rows = Rows(rows.df.distinct(), entities)
            order_scope = rows.scope()
        if clause.order:
            keys = []
            for i, (expr, way) in enumerate(clause.order):
                if f"__order{i}" in rows.df.columns:
                    c = F.col(f"__order{i}")
                else:
                    same = next((a for a, e in items if e == expr), None)
                    c = F.col(f"`{same}`") if same in rows.df.columns else X.compile_(expr, order_scope)[0]
                keys.append(sort_key(c, way))
            rows = Rows(rows.df.orderBy(*keys), rows.entities)
        for expr, fn in ((clause.skip, DataFrame.offset), (clause.limit, DataFrame.limit)):
            if expr is not None:
                rows = Rows(fn(rows.df, whole_number(self._constant(expr))), rows.entities)
        rows = Rows(rows.df.drop(*(c for c in rows.df.columns if c.startswith("__order"))), rows.entities)
        self.rows = rows
        self.where(clause.where)
        if clause.last:
            hidden = [c for c in self.rows.df.columns if c.startswith("__") or ".__" in c]
            self.rows = Rows(self.rows.df.drop(*hidden), self.rows.entities)

    @staticmethod
    def _constant(expr: X.Node) -> Any:
        if expr.op == "lit":
            return expr.args[0]
        if expr.op in ("+", "-", "*"):
            a, b = (Translator._constant(x) for x in expr.args)
            return {"+": a + b, "-": a - b, "*": a * b}[expr.op]
        if expr.op == "call" and expr.args[0] == "tointeger":
            return int(Translator._constant(expr.args[2][0]))
        raise SchemaProblem("SKIP and LIMIT take constants")

    @staticmethod
    def _known(expr: X.Node, items) -> bool:
        if any(e == expr for _, e in items):
            return True
        names = {n.args[0] for n in X.walk(expr) if n.op == "name"}
        return names <= {a for a, _ in items}

    def projected(self, rows: Rows, alias: str, expr: X.Node, entities: dict[str, Any]):
        if expr.op == "name" and expr.args[0] in rows.entities:
            old = expr.args[0]
            entities[alias] = rows.entities[old]
            return [F.col(f"`{c}`").alias(alias + c[len(old) :]) for c in rows.df.columns if c.startswith(old + ".")]
        return [self.value(expr, rows).alias(alias)]

    def value(self, expr: X.Node, rows: Rows):
        return X.compile_(self.lengths(expr, rows), rows.scope())[0]

    @staticmethod
    def lengths(expr: X.Node, rows: Rows) -> X.Node:
        """length(p) of a named path is a column."""
        if expr.op == "call" and expr.args[0] == "length" and expr.args[2] and expr.args[2][0].op == "name" and f"{expr.args[2][0].args[0]}.__length" in rows.df.columns:
            return X.Node("prop", (expr.args[2][0], "__length"))
        inside = lambda a: Translator.lengths(a, rows) if isinstance(a, X.Node) else tuple(map(inside, a)) if isinstance(a, tuple) else a
        return X.Node(expr.op, tuple(map(inside, expr.args)))

    def aggregated(self, items) -> Rows:
        """Items without an aggregate are the keys; expressions over aggregates follow the aggregation."""
        rows = self.rows
        scope, keys, aggregates, entities, carried = rows.scope(), [], [], {}, []
        for alias, expr in items:
            if X.is_aggregate(expr):
                continue
            if expr.op == "name" and expr.args[0] in rows.entities:
                old = expr.args[0]
                entities[alias] = rows.entities[old]
                for c in rows.df.columns:
                    if c.startswith(old + "."):
                        name = alias + c[len(old) :]
                        if c == f"{old}.{rows.entities[old]['id']}":
                            keys.append(F.col(f"`{c}`").alias(name))
                        else:  # the id decides all other fields
                            carried.append(F.first(F.col(f"`{c}`")).alias(name))
            else:
                keys.append(self.value(expr, rows).alias(alias))
        found: dict[X.Node, str] = {}

        def lifted(node):
            if isinstance(node, tuple):
                return tuple(map(lifted, node))
            if not isinstance(node, X.Node):
                return node
            for alias, expr in items:
                if expr == node and not X.is_aggregate(expr):
                    return X.Node("name", (alias,))
            if node.op == "call" and node.args[0] in X.AGGREGATES:
                if node not in found:
                    found[node] = f"__agg{len(found)}"
                    aggregates.append(X.aggregate(self.lengths(node, rows), scope)[0].alias(found[node]))
                return X.Node("name", (found[node],))
            return X.Node(node.op, tuple(map(lifted, node.args)))

        after = [(alias, lifted(expr)) for alias, expr in items if X.is_aggregate(expr)]
        df = rows.df.groupBy(*keys).agg(*aggregates, *carried) if keys else rows.df.agg(*aggregates)
        scope = X.Scope(df, entities)
        values = {alias: X.compile_(expr, scope)[0] for alias, expr in after}
        columns = []
        for alias, expr in items:
            if alias in values:
                columns.append(values[alias].alias(alias))
            elif alias in entities:
                columns += [F.col(f"`{c}`") for c in df.columns if c.startswith(alias + ".")]
            else:
                columns.append(F.col(f"`{alias}`"))
        return Rows(df.select(*columns), entities)


def multi_source(hop: DataFrame, sources: DataFrame, most: int | None) -> DataFrame:
    """(s, id, hops): least hops from each source to each node it reaches."""
    from loomgraph.plans.storage import cut

    hop = cut(hop)
    seen = cut(sources.select("s", F.col("s").alias("id"), F.lit(0).alias("hops")))
    front, step = seen, 0
    while most is None or step < most:
        step += 1
        front = cut(front.join(hop, F.col("id") == F.col("u")).select("s", F.col("v").alias("id")).distinct().join(seen, ["s", "id"], "left_anti").withColumn("hops", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


