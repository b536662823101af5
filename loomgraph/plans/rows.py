"""The row pipeline: row calls on a DataFrame; expressions are texts of the expression language."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.errors import SchemaProblem, Unsupported
from loomgraph.functions import expressions as X
from loomgraph.functions.predicates import filter_by_dict


def sort_key(c: Column, direction: str) -> Column:
    """Null is the largest value."""
    return c.desc_nulls_first() if direction.lower().startswith("desc") else c.asc_nulls_last()


def _items(df: DataFrame, items) -> list[Column]:
    scope = X.Scope(df)
    return [X.column(i, scope).alias(i) if isinstance(i, str) else X.column(i[1], scope).alias(i[0]) for i in items]


def select(df, items):
    return df.select(*_items(df, items))


def with_(df, items, extend=False):
    return df.select("*", *_items(df, items)) if extend else select(df, items)


def where_rows(df, filter_dict=None, expr=None):
    df = filter_by_dict(df, filter_dict)
    return df.filter(F.coalesce(X.column(expr, X.Scope(df)).cast("boolean"), F.lit(False))) if expr else df


def order_by(df, keys):
    scope = X.Scope(df)
    pairs = [(k, "asc") if isinstance(k, str) else k for k in keys]
    return df.orderBy(*(sort_key(X.column(k, scope), d) for k, d in pairs))


def whole_number(value: Any) -> int:
    if isinstance(value, str):
        node = X.parse(value)
        value = node.args[0] if node.op == "lit" else None
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise SchemaProblem("a count that isn't negative is needed")
    return value


def group_by(df, keys, aggregations):
    """Aggregations are (alias, function) or (alias, function, expression).

    Lists are collected in the order of the rows, distinct ones by first appearance;
    for that alone the rows are numbered, where their order comes from ``order_by``.
    """
    ordinal = None
    if any(function.lower() in ("collect", "collect_distinct") for _, function, *_ in aggregations):
        ordinal = "__at"
        df = df.withColumn(ordinal, F.monotonically_increasing_id())
    scope, out = X.Scope(df), []
    for alias, function, *expr in aggregations:
        args = tuple(X.parse(e) for e in expr if e not in (None, "*"))
        out.append(X.aggregate(X.Node("call", (function, False, args)), scope, ordinal)[0].alias(alias))
    keyed = [X.column(k, scope).alias(k) if isinstance(k, str) else X.column(k[1], scope).alias(k[0]) for k in keys]
    return df.groupBy(*keyed).agg(*out) if keyed else df.agg(*out)


def unwind(df, expr, as_):
    c, kind = X.compile_(X.parse(expr), X.Scope(df))
    if isinstance(kind, X.T.ArrayType):
        return df.select("*", F.explode(c).alias(as_))
    return df.withColumn(as_, c).filter(F.col(f"`{as_}`").isNotNull())


def fill_empty_row(df):
    """One row of nulls where there is none."""
    one = df.sparkSession.range(1).select(F.lit(1).alias("__one"))
    return one.join(df.withColumn("__has", F.lit(1)), F.lit(1) == F.col("__has"), "left").drop("__one", "__has")


def searched(df: DataFrame, term: str, columns=None, case_sensitive: bool = False, regex: bool = False) -> Column:
    """Any of the text columns (and, for a number, the integer ones) holds the term; nulls never do."""
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = term.lstrip("-").isdigit()
    chosen = [c for c in columns or kinds if isinstance(kinds[c], X.T.StringType) or (numeric and isinstance(kinds[c], X.INTEGERS))]
    out = F.lit(False)
    for name in chosen:
        c = F.col(f"`{name}`").cast("string")
        if regex:
            test = c.rlike(term if case_sensitive else f"(?i){term}")
        else:
            test = F.contains(c, F.lit(term)) if case_sensitive else F.contains(F.lower(c), F.lit(term.lower()))
        out |= F.coalesce(test, F.lit(False))
    return out


def semi_apply_mark(df, other, on, name):
    keys = other.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(keys, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


#: Row calls that match a pattern for each row, given as ``binding_ops``.
APPLIES = ("anti_semi_apply", "semi_apply_mark", "join_apply")


def applied(function: str, df: DataFrame, g, params: dict[str, Any]) -> DataFrame:
    """Rows against the matches of ``binding_ops`` that share the nodes of ``join_aliases``: those without, a mark, or joined."""
    from loomgraph.plans import ops as O
    from loomgraph.plans.bindings import bound_rows

    other = bound_rows(g, O.from_json({"chain": params["binding_ops"]}), params.get("neq"))
    on = [c for c in (f"{a}.{g.node}" for a in params["join_aliases"]) if c in df.columns and c in other.columns]
    if not on:
        raise SchemaProblem(f"the rows and the pattern share none of {params['join_aliases']}")
    quoted = [f"`{c}`" for c in on]
    if function == "join_apply":
        fresh = [f"`{c}`" for c in other.columns if c not in df.columns]
        right = other.select(*(F.col(q).alias(f"__on{i}") for i, q in enumerate(quoted)), *fresh)
        test = [F.col(q) == F.col(f"__on{i}") for i, q in enumerate(quoted)]
        return df.join(right, test, params.get("how", "inner")).drop(*(f"__on{i}" for i in range(len(on))))
    keys = other.select(*(F.col(q).alias(f"__on{i}") for i, q in enumerate(quoted))).distinct()
    test = [F.col(q) == F.col(f"__on{i}") for i, q in enumerate(quoted)]
    if function == "anti_semi_apply":
        return df.join(keys, test, "left_anti")
    marked = df.join(keys.withColumn("__mark", F.lit(True)), test, "left")
    return marked.withColumn(params["out_col"], F.coalesce("__mark", F.lit(False))).drop("__mark", *(f"__on{i}" for i in range(len(on))))


CALLS = {
    "select": select, "return_": select, "with_": with_, "where_rows": where_rows, "order_by": order_by, "group_by": group_by, "unwind": unwind, "fill_empty_row": fill_empty_row,
    "skip": lambda df, count: df.offset(whole_number(count)), "limit": lambda df, count: df.limit(whole_number(count)), "distinct": lambda df: df.distinct(),
    "drop_cols": lambda df, cols: df.drop(*cols), "count_table": lambda df, alias="count": df.agg(F.count(F.lit(1)).alias(alias)),
    "search_any": lambda df, term, columns=None, case_sensitive=False, regex=False: df.filter(searched(df, term, columns, case_sensitive, regex)),
    "anti_semi_apply": lambda df, other, on: df.join(other, on, "left_anti"), "semi_apply_mark": semi_apply_mark, "join_apply": lambda df, other, on, how="inner": df.join(other, on, how),
}


def apply(df: DataFrame, function: str, params: dict[str, Any]) -> DataFrame:
    if function not in CALLS:
        raise Unsupported(f"there is no row call {function!r}")
    return CALLS[function](df, **params)
