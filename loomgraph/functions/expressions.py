"""The row expression language: text to an abstract tree, and the tree to a Column.

Types are known from the schema, so operators that depend on them (``+``, ``/``,
comparisons) are chosen at translation, and no valid query trips over ANSI mode.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import SchemaProblem, SyntaxProblem, TypeProblem, Unsupported
from loomgraph.functions import temporal

TOKEN = re.compile(r"""\s*(?:(?P<number>0[xX][0-9a-fA-F]+|0[oO][0-7]+|\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)|\d+|(?<![\w\]\)])\.\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<op><=|>=|<>|!=|=~|->|<-|\.\.|[-+*/%^=<>()\[\]{},.:|;]))""")
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NUMBERS = (*INTEGERS, *FLOATS, T.DecimalType)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def key(self) -> str:
        return self.text.upper() if self.kind == "name" and self.text[0] != "`" else self.text


def tokenize(text: str) -> list[Token]:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S) if "//" in text or "/*" in text else text
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at:at + 20]!r}")
        out.append(Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return out


@dataclass(frozen=True)
class Node:
    """op: lit, name, prop, call, case, list, map, comp, quant, index, slice, pattern, or an operator."""

    op: str
    args: tuple = ()


class Parser:
    """Recursive descent over tokens; the query parser extends it."""

    def __init__(self, text: str, params: dict[str, Any] | None = None):
        self.text, self.tokens, self.i, self.params = text, tokenize(text), 0, params or {}

    def peek(self, ahead: int = 0) -> str:
        i = self.i + ahead
        return self.tokens[i].key if i < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.i + ahead
        return self.tokens[i].kind if i < len(self.tokens) else ""

    def next(self) -> Token:
        if self.i >= len(self.tokens):
            raise SyntaxProblem("unexpected end of text")
        self.i += 1
        return self.tokens[self.i - 1]

    def accept(self, *keys: str) -> bool:
        if all(self.peek(k) == key for k, key in enumerate(keys)):
            self.i += len(keys)
            return True
        return False

    def expect(self, key: str) -> None:
        if not self.accept(key):
            raise SyntaxProblem(f"expected {key!r} at {self.text[self.tokens[self.i].at:][:20]!r}" if self.i < len(self.tokens) else f"expected {key!r} at the end")

    def name(self) -> str:
        t = self.next()
        if t.kind != "name":
            raise SyntaxProblem(f"expected a name, not {t.text!r}")
        return t.text.strip("`")

    def expression(self) -> Node:
        return self._or()

    def _chain(self, below, *words):
        left = below()
        while self.peek() in words:
            op = self.next().key
            left = Node(op, (left, below()))
        return left

    def _or(self):
        return self._chain(self._xor, "OR")

    def _xor(self):
        return self._chain(self._and, "XOR")

    def _and(self):
        return self._chain(self._not, "AND")

    def _not(self):
        return Node("NOT", (self._not(),)) if self.accept("NOT") else self._comparison()

    def _comparison(self):
        left, tests = self._additive(), []
        while True:
            op = self.peek()
            if op in ("=", "<>", "!=", "<", "<=", ">", ">=", "=~"):
                self.next()
                right = self._additive()
                tests.append(Node("<>" if op == "!=" else op, (left, right)))
                left = right
            elif op == "IS":
                self.next()
                negated = self.accept("NOT")
                self.expect("NULL")
                tests.append(Node("IS NOT NULL" if negated else "IS NULL", (left,)))
            elif op == "IN":
                self.next()
                tests.append(Node("IN", (left, self._additive())))
            elif op == "CONTAINS":
                self.next()
                tests.append(Node("CONTAINS", (left, self._additive())))
            elif op in ("STARTS", "ENDS"):
                self.next()
                self.expect("WITH")
                tests.append(Node(f"{op} WITH", (left, self._additive())))
            elif op in ("LIKE", "ILIKE", "BETWEEN"):
                raise Unsupported(f"{op} isn't in the language")
            else:
                return reduce(lambda a, b: Node("AND", (a, b)), tests) if tests else left

    def _additive(self):
        return self._chain(self._times, "+", "-")

    def _times(self):
        return self._chain(self._unary, "*", "/", "%")

    def _unary(self):
        if self.peek() in ("+", "-"):
            return Node("unary" + self.next().text, (self._unary(),))
        left = self._postfix()
        if self.peek() == "^":
            raise Unsupported("^ isn't in the language")
        return left

    def _postfix(self):
        left = self._atom()
        while True:
            if self.peek() == "." and self.kind(1) == "name":
                self.next()
                left = Node("prop", (left, self.name()))
            elif self.accept("["):
                low = None if self.peek() == ".." else self.expression()
                if self.accept(".."):
                    high = None if self.peek() == "]" else self.expression()
                    left = Node("slice", (left, low, high))
                else:
                    left = Node("index", (left, low))
                self.expect("]")
            elif self.peek() == ":" and self.kind(1) == "name" and left.op == "name":
                labels = []
                while self.accept(":"):
                    labels.append(self.name())
                left = Node("labelled", (left, tuple(labels)))
            else:
                return left

    def _list(self, end: str) -> tuple[Node, ...]:
        out = []
        while not self.accept(end):
            out.append(self.expression())
            if not self.accept(","):
                self.expect(end)
                break
        return tuple(out)

    def _atom(self) -> Node:
        t = self.next()
        if t.kind == "number":
            text = t.text.lower()
            if text.startswith(("0x", "0o")):
                return Node("lit", (int(text, 0),))
            return Node("lit", (float(text) if re.search(r"[.e]", text) else int(text),))
        if t.kind == "string":
            return Node("lit", (re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), t.text[1:-1]),))
        if t.kind == "param":
            if t.text[1:] not in self.params:
                raise SchemaProblem(f"parameter {t.text} isn't given")
            return literal(self.params[t.text[1:]])
        if t.text == "(":
            inner = self.expression()
            self.expect(")")
            return inner
        if t.text == "[":
            return self._bracket()
        if t.text == "{":
            items = []
            while not self.accept("}"):
                key = self.next().text.strip("`'\"")
                self.expect(":")
                items.append((key, self.expression()))
                if not self.accept(","):
                    self.expect("}")
                    break
            return Node("map", tuple(items))
        if t.kind != "name":
            raise SyntaxProblem(f"unexpected {t.text!r}")
        word = t.key
        if word in ("TRUE", "FALSE", "NULL"):
            return Node("lit", ({"TRUE": True, "FALSE": False, "NULL": None}[word],))
        if word == "CASE":
            return self._case()
        if word in ("ANY", "ALL", "NONE", "SINGLE") and self.peek() == "(" and self.peek(2) == "IN":
            self.next()
            var = self.name()
            self.expect("IN")
            items = self.expression()
            self.expect("WHERE")
            test = self.expression()
            self.expect(")")
            return Node("quant", (word.lower(), var, items, test))
        path = t.text.strip("`")
        # Dotted function names, as in date.truncate(...).
        if self.peek() == "." and self.kind(1) == "name" and self.peek(2) == "(":
            self.next()
            path += "." + self.name()
        if self.accept("("):
            if self.accept("*"):
                self.expect(")")
                return Node("call", (path.lower(), False, ()))
            distinct = self.accept("DISTINCT")
            return Node("call", (path.lower(), distinct, self._list(")")))
        return Node("name", (path,))

    def _bracket(self) -> Node:
        if self.kind() == "name" and self.peek(1) == "IN":
            saved = self.i
            var = self.name()
            self.next()
            items = self.expression()
            if self.peek() in ("WHERE", "|", "]"):
                test = self.expression() if self.accept("WHERE") else None
                value = self.expression() if self.accept("|") else None
                self.expect("]")
                return Node("comp", (var, items, test, value))
            self.i = saved
        return Node("list", self._list("]"))

    def _case(self) -> Node:
        subject = None if self.peek() == "WHEN" else self.expression()
        whens = []
        while self.accept("WHEN"):
            test = self.expression()
            self.expect("THEN")
            whens.append((test if subject is None else Node("=", (subject, test)), self.expression()))
        other = self.expression() if self.accept("ELSE") else Node("lit", (None,))
        self.expect("END")
        return Node("case", (tuple(whens), other))


def literal(value: Any) -> Node:
    if isinstance(value, (list, tuple)):
        return Node("list", tuple(map(literal, value)))
    if isinstance(value, dict):
        return Node("map", tuple((k, literal(v)) for k, v in value.items()))
    return Node("lit", (value,))


def parse(text: str, params: dict[str, Any] | None = None) -> Node:
    p = Parser(text, params)
    out = p.expression()
    if p.i < len(p.tokens):
        raise SyntaxProblem(f"unexpected {p.peek()!r}")
    return out


AGGREGATES = {"count", "sum", "avg", "mean", "min", "max", "collect", "count_distinct", "collect_distinct"}


def walk(node: Any):
    if isinstance(node, Node):
        yield node
        for a in node.args:
            yield from walk(a)
    elif isinstance(node, tuple):
        for a in node:
            yield from walk(a)


def is_aggregate(node: Node) -> bool:
    return any(n.op == "call" and n.args[0] in AGGREGATES for n in walk(node))


class Scope:
    """Names of a frame: columns, and entities whose fields are columns ``alias.field``."""

    def __init__(self, df: DataFrame, entities: dict[str, dict[str, Any]] | None = None, strict: bool = False):
        self.df, self.entities, self.strict = df, entities or {}, strict
        self.kinds = {f.name: f.dataType for f in df.schema}
        self.local: dict[str, tuple[Column, T.DataType]] = {}

    def with_local(self, name: str, c: Column, kind: T.DataType) -> Scope:
        out = Scope.__new__(Scope)
        out.df, out.entities, out.kinds, out.strict = self.df, self.entities, self.kinds, self.strict
        out.local = self.local | {name: (c, kind)}
        return out

    def fields(self, alias: str) -> list[str]:
        return [k[len(alias) + 1 :] for k in self.kinds if k.startswith(alias + ".")]


Typed = tuple[Column, T.DataType]
NULL = T.NullType()


def compile_(node: Node, scope: Scope) -> Typed:
    """Column and type of an expression without aggregates."""
    if node.op in FOLDED and (value := temporal.fold(node)) is not temporal.NO:
        return _constant(value)
    return _COMPILE.get(node.op, _operator)(node, scope)


#: Nodes that a constant temporal expression may begin with.
FOLDED = {"call", "prop", "unary-", "+", "-", "*", "/", "=", "<>", "<", "<=", ">", ">="}


def _constant(value: Any) -> Typed:
    """A date and a local date and time (an offset of 0 counts as local) are literals, other temporal values their texts."""
    if isinstance(value, temporal.Moment) and value.day is not None and value.nanos is None:
        return F.lit(value.day), T.DateType()
    if isinstance(value, temporal.Moment) and value.day is not None and not value.offset and not value.zone and value.nanos % 1000 == 0:
        at = dt.datetime.combine(value.day, dt.time()) + dt.timedelta(microseconds=value.nanos // 1000)
        return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz"), T.TimestampNTZType()
    if isinstance(value, (temporal.Moment, temporal.Duration)):
        return F.lit(str(value)), T.StringType()
    return _lit(Node("lit", (value,)), None)


def _shifted(node: Node, scope: Scope) -> Typed | None:
    """A date or time column plus or minus a constant duration."""
    sides = [temporal.fold(a) for a in node.args]
    at = next((i for i, v in enumerate(sides) if isinstance(v, temporal.Duration)), None)
    if at is None or node.op == "-" and at == 0:
        return None
    c, kind = compile_(node.args[1 - at], scope)
    d = -sides[at] if node.op == "-" else sides[at]
    if isinstance(kind, T.DateType):
        return F.date_add(F.add_months(c, d.months), d.days + int(d.nanos / temporal.DAY)), kind
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        months = F.make_ym_interval(F.lit(0), F.lit(d.months))
        rest = F.make_dt_interval(F.lit(d.days), F.lit(0), F.lit(0), F.lit(d.nanos / temporal.SECOND).cast("decimal(18,6)"))
        return c + months + rest, kind
    return None


def column(text: str, scope: Scope, params: dict[str, Any] | None = None) -> Column:
    return compile_(parse(text, params), scope)[0]


def _lit(node, scope):
    v = node.args[0]
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): NULL}
    if type(v) not in kinds:
        c = F.lit(v)
        return c, scope.df.select(c.alias("v")).schema[0].dataType
    return (F.lit(v).cast("long") if type(v) is int else F.lit(v)), kinds[type(v)]


def _name(node, scope):
    name = node.args[0]
    if name in scope.local:
        return scope.local[name]
    if name in scope.entities:
        entity = scope.entities[name]
        key = f"{name}.{entity['id']}"
        return F.col(f"`{key}`"), scope.kinds[key]
    if name in scope.kinds:
        return F.col(f"`{name}`"), scope.kinds[name]
    raise SchemaProblem(f"{name!r} isn't known here; known: {', '.join([*scope.entities, *(k for k in scope.kinds if '.' not in k)])}")


def _prop(node, scope):
    base, key = node.args
    if base.op == "name" and base.args[0] not in scope.local:
        full = f"{base.args[0]}.{key}"
        if full in scope.kinds:
            return F.col(f"`{full}`"), scope.kinds[full]
        if base.args[0] in scope.entities:
            if scope.strict:
                raise SchemaProblem(f"{base.args[0]!r} has no property {key!r}")
            return F.lit(None), NULL
    c, kind = compile_(base, scope)
    if isinstance(kind, T.StructType):
        found = {f.name: f.dataType for f in kind}
        return (c.getField(key), found[key]) if key in found else (F.lit(None), NULL)
    if isinstance(kind, T.MapType):
        return c.getItem(key), kind.valueType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "week": F.weekofyear, "dayofweek": lambda x: F.weekday(x) + 1, "ordinalday": F.dayofyear}.get(key.lower())
        if part:
            return part(c).cast("long"), T.LongType()
    if isinstance(kind, T.NullType):
        return F.lit(None), NULL
    raise TypeProblem(f"a {kind.simpleString()} has no property {key!r}")


def common_type(kinds: list[T.DataType]) -> T.DataType:
    known = [k for k in kinds if not isinstance(k, T.NullType)]
    if not known:
        return NULL
    if all(isinstance(k, NUMBERS) for k in known):
        return T.LongType() if all(isinstance(k, INTEGERS) for k in known) else T.DoubleType()
    if len({k.simpleString() for k in known}) == 1:
        return known[0]
    if all(isinstance(k, T.ArrayType) for k in known):
        return T.ArrayType(common_type([k.elementType for k in known]))
    raise TypeProblem(f"values of types {', '.join(sorted({k.simpleString() for k in known}))} can't stand in one list or result")


def _list(node, scope):
    items = [compile_(a, scope) for a in node.args]
    kind = common_type([k for _, k in items])
    out = T.ArrayType(kind)
    if isinstance(kind, T.NullType):
        return F.array(*(F.lit(None) for _ in items)) if items else F.array(), out
    return F.array(*(c.cast(kind) for c, _ in items)), out


def _map(node, scope):
    items = [(k, *compile_(v, scope)) for k, v in node.args]
    return F.struct(*(c.alias(k) for k, c, _ in items)), T.StructType([T.StructField(k, t) for k, _, t in items])


def _case(node, scope):
    whens, other = node.args
    tests = [compile_(t, scope)[0].cast("boolean") for t, _ in whens]
    values = [compile_(v, scope) for _, v in whens] + [compile_(other, scope)]
    kind = common_type([k for _, k in values])
    values = [c if isinstance(kind, T.NullType) else c.cast(kind) for c, _ in values]
    out = F
    for t, v in zip(tests, values, strict=False):
        out = out.when(t, v)
    return out.otherwise(values[-1]), kind


def _items(node, scope):
    c, kind = compile_(node, scope)
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("array<bigint>"), T.ArrayType(T.LongType())
    if not isinstance(kind, T.ArrayType):
        raise TypeProblem(f"a list is needed, not a {kind.simpleString()}")
    return c, kind


def _quant(node, scope):
    which, var, items, test = node.args
    c, kind = _items(items, scope)
    inner = lambda x: compile_(test, scope.with_local(var, x, kind.elementType))[0].cast("boolean")
    if which == "any":
        return F.exists(c, inner), T.BooleanType()
    if which == "all":
        return F.forall(c, inner), T.BooleanType()
    if which == "none":
        return ~F.exists(c, inner), T.BooleanType()
    sure = F.size(F.filter(c, lambda x: F.coalesce(inner(x), F.lit(False))))
    maybe = F.size(F.filter(c, lambda x: inner(x).isNull()))
    return F.when(c.isNull(), None).when(sure > 1, False).when(maybe > 0, None).otherwise(sure == 1), T.BooleanType()


def _comp(node, scope):
    var, items, test, value = node.args
    c, kind = _items(items, scope)
    inside = lambda n: lambda x: compile_(n, scope.with_local(var, x, kind.elementType))[0]
    if test is not None:
        c = F.filter(c, inside(test))
    if value is None:
        return c, kind
    # The type of the result is that of the value for an element.
    sample = compile_(value, scope.with_local(var, F.lit(None).cast(kind.elementType), kind.elementType))[1]
    return F.transform(c, inside(value)), T.ArrayType(sample)


def _index(node, scope):
    (c, kind), (i, ik) = compile_(node.args[0], scope), compile_(node.args[1], scope)
    if isinstance(kind, T.StructType):
        key = node.args[1].args[0]
        return _prop(Node("prop", (node.args[0], key)), scope)
    if isinstance(kind, T.MapType):
        return c.getItem(i), kind.valueType
    if not isinstance(kind, T.ArrayType):
        raise TypeProblem(f"a {kind.simpleString()} has no elements")
    at = i.cast("int")
    return F.get(c, F.when(at < 0, F.size(c) + at).otherwise(at)), kind.elementType


def _slice(node, scope):
    base, low, high = node.args
    c, kind = _items(base, scope)
    n = F.size(c)
    bound = lambda x, other: other if x is None else (lambda v: F.greatest(F.lit(0), F.least(n, F.when(v < 0, n + v).otherwise(v))))(compile_(x, scope)[0].cast("int"))
    a, b = bound(low, F.lit(0)), bound(high, n)
    return F.when(c.isNull() | a.isNull() | b.isNull(), None).otherwise(F.slice(c, a + 1, F.greatest(b - a, F.lit(0)))), kind


def _labelled(node, scope):
    alias, labels = node.args[0].args[0], node.args[1]
    return reduce(lambda a, b: a & b, [label_test(scope, alias, x) for x in labels]), T.BooleanType()


def label_test(scope: Scope, alias: str, label: str) -> Column:
    for key, test in ((f"{alias}.label__{label}", lambda c: c), (f"{alias}.labels", lambda c: F.array_contains(c, label)), (f"{alias}.label", lambda c: c == label), (f"{alias}.type", lambda c: c == label)):
        if key in scope.kinds:
            return F.coalesce(test(F.col(f"`{key}`")), F.lit(False))
    return F.lit(False)


def _equal(a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column:
    """Three-valued equality."""
    if isinstance(ka, T.NullType) or isinstance(kb, T.NullType):
        return F.lit(None).cast("boolean")
    if isinstance(ka, T.ArrayType) and isinstance(kb, T.ArrayType):
        each = F.zip_with(a, b, lambda x, y: _equal(x, ka.elementType, y, kb.elementType))
        whole = F.aggregate(each, F.lit(True), lambda acc, x: acc & x)
        return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), False).otherwise(whole)
    if isinstance(ka, T.StructType) and isinstance(kb, T.StructType):
        if sorted(ka.fieldNames()) != sorted(kb.fieldNames()):
            return F.lit(False)
        return reduce(lambda x, y: x & y, [_equal(a.getField(f.name), f.dataType, b.getField(f.name), kb[f.name].dataType) for f in ka], F.lit(True))
    if not comparable(ka, kb):
        return F.when(a.isNull() | b.isNull(), None).otherwise(F.lit(False))
    out = a == b
    if isinstance(ka, FLOATS) or isinstance(kb, FLOATS):
        out = F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), False).otherwise(out)
    return out


def comparable(ka: T.DataType, kb: T.DataType) -> bool:
    times = (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    if isinstance(ka, T.StringType) and isinstance(kb, T.StringType):
        return True
    return any(isinstance(ka, g) and isinstance(kb, g) for g in (NUMBERS, (T.BooleanType,))) or (isinstance(ka, times) and isinstance(kb, times)) or ka == kb


def _ordered(op: str, a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column:
    if isinstance(ka, T.NullType) or isinstance(kb, T.NullType) or not comparable(ka, kb):
        return F.lit(None).cast("boolean")
    out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if isinstance(ka, FLOATS) or isinstance(kb, FLOATS):
        out = F.when(F.isnan(a.cast("double")) | F.isnan(b.cast("double")), False).otherwise(out)
    return out


def _plus(a, ka, b, kb):
    lists = isinstance(ka, T.ArrayType), isinstance(kb, T.ArrayType)
    if all(lists):
        kind = common_type([ka, kb])
        return F.concat(a.cast(kind), b.cast(kind)), kind
    if lists[0] and not isinstance(kb, T.NullType):
        kind = T.ArrayType(common_type([ka.elementType, kb]))
        return F.concat(a.cast(kind), F.array(b.cast(kind.elementType))), kind
    if lists[1] and not isinstance(ka, T.NullType):
        kind = T.ArrayType(common_type([kb.elementType, ka]))
        return F.concat(F.array(a.cast(kind.elementType)), b.cast(kind)), kind
    if isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
        return F.concat(a.cast("string"), b.cast("string")), T.StringType()
    if isinstance(ka, T.NullType) or isinstance(kb, T.NullType):
        return F.lit(None), NULL
    return _number(a, ka) + _number(b, kb), common_type([ka, kb])


def _number(c, kind):
    if not isinstance(kind, NUMBERS):
        raise TypeProblem(f"a number is needed, not a {kind.simpleString()}")
    return c.cast("long") if isinstance(kind, INTEGERS) else c.cast("double")


def _operator(node, scope):
    op = node.op
    if op in ("+", "-") and (shifted := _shifted(node, scope)):
        return shifted
    parts = [compile_(a, scope) for a in node.args]
    boolean = T.BooleanType()
    if op in ("AND", "OR", "XOR", "NOT"):
        cs = []
        for c, k in parts:
            if not isinstance(k, (T.BooleanType, T.NullType)):
                raise TypeProblem(f"{op} needs booleans, not a {k.simpleString()}")
            cs.append(c.cast("boolean"))
        return {"AND": lambda: cs[0] & cs[1], "OR": lambda: cs[0] | cs[1], "XOR": lambda: cs[0] != cs[1], "NOT": lambda: ~cs[0]}[op](), boolean
    if op == "IS NULL":
        return parts[0][0].isNull(), boolean
    if op == "IS NOT NULL":
        return parts[0][0].isNotNull(), boolean
    (a, ka), (b, kb) = parts[0], parts[-1]
    if op == "=":
        return _equal(a, ka, b, kb), boolean
    if op == "<>":
        return ~_equal(a, ka, b, kb), boolean
    if op in ("<", "<=", ">", ">="):
        return _ordered(op, a, ka, b, kb), boolean
    if op == "IN":
        c, kind = _items(node.args[1], scope)
        if isinstance(kind.elementType, T.NullType):
            return F.when(F.size(c) == 0, False).otherwise(F.lit(None).cast("boolean")), boolean
        return F.when(c.isNull(), None).otherwise(F.exists(c, lambda x: _equal(x, kind.elementType, a, ka))), boolean
    if op in ("CONTAINS", "STARTS WITH", "ENDS WITH", "=~"):
        if not (isinstance(ka, T.StringType) and isinstance(kb, T.StringType)):
            return F.lit(None).cast("boolean"), boolean
        if op == "=~":
            return F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")\\z"))), boolean
        return {"CONTAINS": F.contains, "STARTS WITH": F.startswith, "ENDS WITH": F.endswith}[op](a, b), boolean
    if op == "unary-":
        return -_number(a, ka), common_type([ka])
    if op == "unary+":
        return _number(a, ka), common_type([ka])
    if op == "+":
        return _plus(a, ka, b, kb)
    if isinstance(ka, T.NullType) or isinstance(kb, T.NullType):
        return F.lit(None), NULL
    x, y, kind = _number(a, ka), _number(b, kb), common_type([ka, kb])
    if op == "-":
        return x - y, kind
    if op == "*":
        return x * y, kind
    if isinstance(kind, T.LongType):
        return (F.call_function("div", x, y) if op == "/" else x % y), kind
    x, y = x.cast("double"), y.cast("double")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    if op == "/":
        return F.when(y == 0, F.when(x > 0, inf).when(x < 0, -inf).when(x.isNotNull(), nan)).otherwise(F.try_divide(x, y)), kind
    return F.when(y == 0, F.when(x.isNotNull(), nan)).otherwise(F.try_mod(x, y)), kind


def rounded(x: Column, places: Column | None) -> Column:
    """Ties go up without places, away from zero with them."""
    if places is None:
        return F.floor(x).cast("double") + ((x - F.floor(x)) >= 0.5).cast("double")
    # The nearer of both neighbours, measured in doubles: 2.675 lies below its decimal spelling.
    scale, size = F.pow(F.lit(10.0), places), F.abs(x)
    down, up = F.floor(size * scale) / scale, (F.floor(size * scale) + 1) / scale
    return F.signum(x) * F.when(up - size <= size - down, up).otherwise(down)


def _call(node, scope):
    name, _, args = node.args
    if name in AGGREGATES:
        raise SyntaxProblem(f"{name}() is an aggregate and can't stand here")
    if name in ("keys", "labels", "type", "properties", "id") and args and args[0].op == "name" and args[0].args[0] in scope.entities:
        return _introspect(name, args[0].args[0], scope)
    parts = [compile_(a, scope) for a in args]
    if name not in FUNCTIONS:
        raise Unsupported(f"there is no function {name}()")
    return FUNCTIONS[name](*parts)


def _introspect(name: str, alias: str, scope: Scope) -> Typed:
    fields, entity = scope.fields(alias), scope.entities[alias]
    present = F.col(f"`{alias}.{entity['id']}`").isNotNull()
    own = [f for f in fields if f not in entity["hidden"] and not f.startswith("label__")]
    if name == "id":
        return _name(Node("name", (alias,)), scope)
    if name == "type":
        key = f"{alias}.type"
        return (F.col(f"`{key}`"), scope.kinds[key]) if key in scope.kinds else (F.lit(None), NULL)
    if name == "labels":
        if f"{alias}.labels" in scope.kinds:
            return F.col(f"`{alias}.labels`"), scope.kinds[f"{alias}.labels"]
        flags = [f for f in fields if f.startswith("label__")]
        found = [F.when(F.col(f"`{alias}.{f}`"), F.lit(f[7:])) for f in flags] or [F.col(f"`{alias}.{f}`") for f in ("label", "type") if f in fields][:1]
        return F.when(present, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")), T.ArrayType(T.StringType())
    if name == "keys":
        return F.when(present, F.array_compact(F.array(*(F.when(F.col(f"`{alias}.{f}`").isNotNull(), F.lit(f)) for f in own)))), T.ArrayType(T.StringType())
    return F.when(present, F.to_json(F.struct(*(F.col(f"`{alias}.{f}`").alias(f) for f in own)))), T.StringType()


def _size(x):
    c, k = x
    if isinstance(k, T.StringType):
        return F.length(c).cast("long"), T.LongType()
    if isinstance(k, T.ArrayType):
        return F.when(c.isNotNull(), F.size(c).cast("long")), T.LongType()
    if isinstance(k, T.NullType):
        return F.lit(None).cast("long"), T.LongType()
    raise TypeProblem(f"size() of a {k.simpleString()}")


def _double(f):
    return lambda x, *rest: (f(x[0].cast("double"), *(r[0] for r in rest)), T.DoubleType())


def _string(f):
    return lambda x, *rest: (f(x[0].cast("string"), *(r[0] for r in rest)), T.StringType())


def _tail(x):
    c, k = x
    if isinstance(k, T.StringType):
        return F.substring(c, 2, 1 << 30), k
    return F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1))), k


def _range(a, b, step=None):
    a, b, s = a[0].cast("long"), b[0].cast("long"), F.lit(1).cast("long") if step is None else step[0].cast("long")
    none = F.array().cast("array<bigint>")
    return F.when(s == 0, F.raise_error(F.lit("the step of range() is 0"))).when(((s > 0) & (a <= b)) | ((s < 0) & (a >= b)), F.sequence(a, b, s)).when(a.isNotNull() & b.isNotNull() & s.isNotNull(), none), T.ArrayType(T.LongType())


def _coalesce(*xs):
    kind = common_type([k for _, k in xs])
    return F.coalesce(*(c if isinstance(kind, T.NullType) else c.cast(kind) for c, _ in xs)), kind


def _boolean(x):
    c, k = x
    if isinstance(k, T.BooleanType):
        return x
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "t", "1", "yes", "y"), True).when(low.isin("false", "f", "0", "no", "n"), False), T.BooleanType()


def _temporal(kind, cast):
    def build(x=None):
        if x is None:
            return (F.current_date() if kind == "date" else F.localtimestamp()).cast(cast), T.DateType() if kind == "date" else T.TimestampNTZType()
        c, k = x
        if isinstance(k, T.StructType):
            get = lambda n, d: c.getField(n).cast("int") if n in k.fieldNames() else F.lit(d)
            if kind == "date":
                return F.make_date(get("year", 1970), get("month", 1), get("day", 1)), T.DateType()
            return F.make_timestamp_ntz(get("year", 1970), get("month", 1), get("day", 1), get("hour", 0), get("minute", 0), get("second", 0)), T.TimestampNTZType()
        return c.try_cast(cast), T.DateType() if kind == "date" else T.TimestampNTZType()

    return build



FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "abs": lambda x: (F.abs(_number(*x)), common_type([x[1]])), "sqrt": _double(F.sqrt), "sign": lambda x: (F.signum(x[0]).cast("long"), T.LongType()),
    "floor": _double(lambda c: F.floor(c).cast("double")), "ceil": _double(lambda c: F.ceil(c).cast("double")), "ceiling": _double(lambda c: F.ceil(c).cast("double")),
    "round": _double(lambda c, p=None: rounded(c, p)),
    "tolower": _string(F.lower), "lower": _string(F.lower), "toupper": _string(F.upper), "upper": _string(F.upper), "trim": _string(F.trim),
    "substring": _string(lambda c, start, n=None: F.substring(c, (start + 1).cast("int"), F.lit(1 << 30) if n is None else n.cast("int"))),
    "size": _size, "length": _size,
    "head": lambda x: (F.substring(x[0], 1, 1), x[1]) if isinstance(x[1], T.StringType) else (F.get(x[0], F.lit(0)), x[1].elementType),
    "last": lambda x: (F.try_element_at(x[0], F.lit(-1)), x[1].elementType),
    "tail": _tail, "reverse": lambda x: (F.reverse(x[0]), x[1]), "range": _range,
    "tointeger": lambda x: ((x[0].cast("long") if isinstance(x[1], T.BooleanType) else x[0].try_cast("double").try_cast("bigint")), T.LongType()),
    "tofloat": lambda x: (x[0].try_cast("double"), T.DoubleType()), "toboolean": _boolean, "tostring": _string(lambda c: c),
    "coalesce": _coalesce, "nodes": lambda x: x, "relationships": lambda x: x,
    "date": _temporal("date", "date"), "datetime": _temporal("datetime", "timestamp_ntz"), "localdatetime": _temporal("datetime", "timestamp_ntz"),
    "datetime.fromepoch": lambda s, n=None: (F.timestamp_seconds(s[0]).cast("timestamp_ntz"), T.TimestampNTZType()),
    "datetime.fromepochmillis": lambda s: (F.timestamp_millis(s[0]).cast("timestamp_ntz"), T.TimestampNTZType()),
}


def _trunc_of(kind):
    def build(unit, x):
        c, _ = x
        out = F.call_function("date_trunc", unit[0], c.cast("timestamp_ntz"))
        return (out.cast("date"), T.DateType()) if kind == "date" else (out.cast("timestamp_ntz"), T.TimestampNTZType())

    return build


FUNCTIONS |= {f"{k}.truncate": _trunc_of(k) for k in ("date", "datetime", "localdatetime")}
_COMPILE = {"lit": _lit, "name": _name, "prop": _prop, "list": _list, "map": _map, "case": _case, "quant": _quant, "comp": _comp, "index": _index, "slice": _slice, "labelled": _labelled, "call": _call}


def aggregate(node: Node, scope: Scope, ordinal: str | None = None) -> Typed:
    """Column and type of an aggregate call; ``ordinal`` is a column that gives the input order, for collect()."""
    name, distinct, args = node.args
    if name == "count" and not args:
        return F.count(F.lit(1)), T.LongType()
    c, kind = compile_(args[0], scope)
    if name in ("count", "count_distinct"):
        return (F.count_distinct(c) if distinct or name == "count_distinct" else F.count(c)), T.LongType()
    if name in ("sum", "avg", "mean") and not isinstance(kind, (*NUMBERS, T.NullType)):
        raise TypeProblem(f"{name}() of a {kind.simpleString()}")
    if name == "sum":
        out = T.LongType() if isinstance(kind, (*INTEGERS, T.NullType)) else T.DoubleType()
        c = c.cast(out)
        return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0).cast(out)), out
    if name in ("avg", "mean"):
        return (F.avg(F.when(F.lit(True), c.cast("double"))) if not distinct else F.sum_distinct(c.cast("double")) / F.count_distinct(c)), T.DoubleType()
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(c), kind
    unique = distinct or name == "collect_distinct"
    if ordinal is None:
        return (F.sort_array(F.collect_set(c)) if unique else F.collect_list(c)), T.ArrayType(kind)
    pairs = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(ordinal).alias("o"), c.alias("x")))))
    values = F.transform(pairs, lambda p: p["x"])
    return (F.array_distinct(values) if unique else values), T.ArrayType(kind)
