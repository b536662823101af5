"""Column predicates for node and edge filters.

Each predicate becomes one native Column; nulls never match unless it says so.
String predicates of a null, or of a column that isn't text, are null unless
``na`` is given; a filter keeps only rows of which its test is true.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import SchemaProblem, TypeProblem

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORALS = (T.DateType, T.TimestampType, T.TimestampNTZType)
TITLE = r"\A(?:[^\p{L}]*\p{Lu}[\p{Ll}\p{M}]*)+[^\p{L}]*\z"


@dataclass(frozen=True)
class Predicate:
    """A named test with its arguments; ``column`` gives its Column for a column of a known type."""

    name: str
    args: dict[str, Any] = field(default_factory=dict)

    def column(self, c: Column, kind: T.DataType) -> Column:
        return BUILD[self.name](c, kind, **self.args)

    def to_json(self) -> dict[str, Any]:
        """The wire form: the type's public name, and ``val`` for the one operand of a comparison."""
        plain = lambda v: v.to_json() if isinstance(v, Predicate) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v
        return {"type": WIRE[self.name], **{"val" if k == "value" else k: plain(v) for k, v in self.args.items()}}


def from_json(data: dict[str, Any]) -> Predicate:
    """The inverse of ``Predicate.to_json``; also takes this module's own names and spelled-out dates and times."""
    args = {"value" if k == "val" else k: _untagged(v) for k, v in data.items()}
    name = READ.get(args.pop("type"))
    if name is None:
        raise SchemaProblem(f"no predicate is called {data['type']!r}")
    if name == "all_of":
        args["predicates"] = [from_json(p) for p in args["predicates"]]
    return Predicate(name, args)


def _untagged(value: Any) -> Any:
    """A value of the wire form: ``{"type": "date" | "datetime" | "time", "value": ISO text}`` is the value itself."""
    if isinstance(value, list):
        return [_untagged(v) if not isinstance(v, dict) or v.get("type") in ("date", "datetime", "time") else v for v in value]
    if isinstance(value, dict) and value.get("type") in ("date", "datetime", "time"):
        read = {"date": dt.date.fromisoformat, "datetime": dt.datetime.fromisoformat, "time": dt.time.fromisoformat}[value["type"]]
        return read(value["value"])
    return value


def _fits(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, NUMBERS)
    if isinstance(value, (dt.date, dt.datetime)):
        return isinstance(kind, (*TEMPORALS, T.StringType))
    return isinstance(kind, (T.StringType, *TEMPORALS))


def _compared(op):
    def build(c: Column, kind: T.DataType, value: Any) -> Column:
        if isinstance(kind, T.BooleanType) != isinstance(value, bool):
            return F.lit(False)  # a boolean and a number don't compare
        if not _fits(kind, value):
            raise TypeProblem(f"a {kind.simpleString()} column isn't comparable with {value!r}")
        guard = ~F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True)
        return op(c, F.lit(value)) & guard

    return build


def _between(c, kind, lower, upper, inclusive=True):
    low, high = ("ge", "le") if inclusive else ("gt", "lt")
    return BUILD[low](c, kind, lower) & BUILD[high](c, kind, upper)


def _missing(c, kind):
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def _text(test):
    def build(c: Column, kind: T.DataType, na: bool | None = None, **args: Any) -> Column:
        if not isinstance(kind, T.StringType):
            return F.lit(na).cast("boolean")
        out = test(c, **args)
        return out if na is None else F.coalesce(out, F.lit(na))

    return build


def pattern(pat: str, case: bool = True, flags: int = 0) -> str:
    """A Python regular expression with its flags in Java's spelling: lines end at \\n only, classes are Unicode's unless ASCII is asked for."""
    names = {re.I: "i", re.M: "m", re.S: "s", re.X: "x"}
    on = "".join(c for f, c in names.items() if flags & f)
    on += ("" if case or "i" in on else "i") + ("" if flags & re.A else "U")
    return f"(?d{on}{'u' if 'i' in on and not flags & re.A else ''}){pat}"


def _contains(c, pat, case=True, regex=True, flags=0):
    if regex:
        return c.rlike(pattern(pat, case, flags))
    return F.contains(c, F.lit(pat)) if case else F.contains(F.lower(c), F.lit(pat.lower()))


def _affix(test):
    def build(c, pat, case=True):
        pats = [pat] if isinstance(pat, str) else list(pat)
        return reduce(lambda a, b: a | b, [test(c, F.lit(p)) if case else test(F.lower(c), F.lit(p.lower())) for p in pats], F.lit(False))

    return build


def _like(before, after):
    # A verbose pattern may end in a comment, so its group is closed on a line of its own.
    return lambda c, pat, case=True, flags=0: c.rlike(pattern(f"{before}(?:{pat}{chr(10) if flags & re.X else ''}){after}", case, flags))


def _cased(one, other):
    return lambda c: c.rlike(rf"\p{{{one}}}") & ~c.rlike(rf"[\p{{{other}}}\p{{Lt}}]")


def _duplicated(c, kind, keep="first"):
    own = Window.partitionBy(c)
    if keep is False:
        return F.count(F.lit(1)).over(own) > 1
    order = F.monotonically_increasing_id()
    return F.row_number().over(own.orderBy(order.asc() if keep == "first" else order.desc())) > 1


def _date(test):
    def build(c, kind):
        if not isinstance(kind, TEMPORALS):
            raise TypeProblem(f"a {kind.simpleString()} column has no calendar")
        return F.coalesce(test(F.to_date(c)), F.lit(False))

    return build


BUILD = {
    "gt": _compared(lambda a, b: a > b), "lt": _compared(lambda a, b: a < b), "ge": _compared(lambda a, b: a >= b), "le": _compared(lambda a, b: a <= b),
    "eq": _compared(lambda a, b: a == b), "ne": _compared(lambda a, b: a != b), "between": _between,
    "is_na": _missing, "not_na": lambda c, k: ~_missing(c, k), "is_null": lambda c, k: c.isNull(), "not_null": lambda c, k: c.isNotNull(),
    "is_in": lambda c, k, options: F.coalesce(c.isin([o for o in options if o is not None]), F.lit(False)) | (c.isNull() if None in options else F.lit(False)),
    "duplicated": _duplicated,
    "all_of": lambda c, k, predicates: reduce(lambda a, b: a & b, [p.column(c, k) for p in predicates], F.lit(True)),
    "contains": _text(_contains), "startswith": _text(_affix(F.startswith)), "endswith": _text(_affix(F.endswith)), "match": _text(_like(r"\A", "")), "fullmatch": _text(_like(r"\A", r"\z")),
    "isnumeric": _text(lambda c: c.rlike(r"\A\p{N}+\z")), "isalpha": _text(lambda c: c.rlike(r"\A\p{L}+\z")), "isdigit": _text(lambda c: c.rlike(r"\A[\p{Nd}²³¹⁰-₉]+\z")),
    "isdecimal": _text(lambda c: c.rlike(r"\A\p{Nd}+\z")), "isalnum": _text(lambda c: c.rlike(r"\A[\p{L}\p{N}]+\z")), "isspace": _text(lambda c: c.rlike(r"\A[\s\p{Z}]+\z")),
    "islower": _text(_cased("Ll", "Lu")), "isupper": _text(_cased("Lu", "Ll")), "istitle": _text(lambda c: c.rlike(TITLE)),
    "never_match": lambda c, k: F.lit(False),
    "is_month_start": _date(lambda d: F.dayofmonth(d) == 1), "is_month_end": _date(lambda d: d == F.last_day(d)),
    "is_quarter_start": _date(lambda d: d == F.trunc(d, "quarter").cast("date")), "is_quarter_end": _date(lambda d: (d == F.last_day(d)) & (F.month(d) % 3 == 0)),
    "is_year_start": _date(lambda d: (F.month(d) == 1) & (F.dayofmonth(d) == 1)), "is_year_end": _date(lambda d: (F.month(d) == 12) & (F.dayofmonth(d) == 31)),
    "is_leap_year": _date(lambda d: (F.year(d) % 4 == 0) & ((F.year(d) % 100 != 0) | (F.year(d) % 400 == 0))),
}


#: The public type names of the wire form.
WIRE = {
    "gt": "GT", "lt": "LT", "ge": "GE", "le": "LE", "eq": "EQ", "ne": "NE", "between": "Between", "is_na": "IsNA", "not_na": "NotNA", "is_null": "IsNull", "not_null": "NotNull", "is_in": "IsIn", "duplicated": "Duplicated", "all_of": "AllOf",
    "contains": "Contains", "startswith": "Startswith", "endswith": "Endswith", "match": "Match", "fullmatch": "Fullmatch", "isnumeric": "IsNumeric", "isalpha": "IsAlpha", "isdigit": "IsDigit", "isdecimal": "IsDecimal", "isalnum": "IsAlnum",
    "isspace": "IsSpace", "islower": "IsLower", "isupper": "IsUpper", "istitle": "IsTitle", "never_match": "NeverMatch", "is_month_start": "IsMonthStart", "is_month_end": "IsMonthEnd", "is_quarter_start": "IsQuarterStart",
    "is_quarter_end": "IsQuarterEnd", "is_year_start": "IsYearStart", "is_year_end": "IsYearEnd", "is_leap_year": "IsLeapYear",
}
READ = {v: k for k, v in WIRE.items()} | {k: k for k in WIRE}


def _named(name, *params):
    def make(*args, **options):
        return Predicate(name, dict(zip(params, args, strict=False)) | options)

    make.__name__ = name
    return make


gt, lt, ge, le, eq, ne = (_named(k, "value") for k in ("gt", "lt", "ge", "le", "eq", "ne"))
between = _named("between", "lower", "upper", "inclusive")
is_na, not_na, is_null, not_null, never_match = (_named(k) for k in ("is_na", "not_na", "is_null", "not_null", "never_match"))
is_in = _named("is_in", "options")
duplicated = _named("duplicated", "keep")
contains = _named("contains", "pat", "case", "flags", "na", "regex")
startswith, endswith = (_named(k, "pat", "case", "na") for k in ("startswith", "endswith"))
match, fullmatch = (_named(k, "pat", "case", "flags", "na") for k in ("match", "fullmatch"))
isna, notna, isnull, notnull = is_na, not_na, is_null, not_null
isnumeric, isalpha, isdigit, isdecimal, isalnum, isspace, islower, isupper, istitle = (_named(k) for k in ("isnumeric", "isalpha", "isdigit", "isdecimal", "isalnum", "isspace", "islower", "isupper", "istitle"))
is_month_start, is_month_end, is_quarter_start, is_quarter_end, is_year_start, is_year_end, is_leap_year = (_named(f"is_{k}") for k in ("month_start", "month_end", "quarter_start", "quarter_end", "year_start", "year_end", "leap_year"))


def all_of(*predicates: Predicate) -> Predicate:
    return Predicate("all_of", {"predicates": list(predicates)})


def condition(df: DataFrame, filters: dict[str, Any] | None) -> Column:
    """The conjunction of a filter dict: a predicate, a list (membership) or a value (equality; None: null) for each column.

    ``label__X: True`` also reads a ``labels`` array or a ``type`` column.
    """
    out = F.lit(True)
    kinds = {f.name: f.dataType for f in df.schema}
    for name, value in (filters or {}).items():
        if name not in kinds:
            label = name.removeprefix("label__")
            if name.startswith("label__") and "labels" in kinds:
                test = F.array_contains("labels", label)
            elif name.startswith("label__") and "type" in kinds:
                test = F.col("type") == label
            else:
                raise SchemaProblem(f"there is no column {name!r}; columns: {', '.join(kinds)}")
            out &= F.coalesce(test, F.lit(False)) if value else ~F.coalesce(test, F.lit(False))
            continue
        c, kind = F.col(f"`{name}`"), kinds[name]
        if isinstance(value, Predicate):
            test = value.column(c, kind)
        elif isinstance(value, (list, tuple, set)):
            test = is_in(list(value)).column(c, kind)
        elif value is None:
            test = c.isNull()
        elif isinstance(kind, T.ArrayType):
            test = F.array_contains(c, value)
        else:
            test = eq(value).column(c, kind)
        out &= F.coalesce(test, F.lit(False))
    return out


def filter_by_dict(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    if any(isinstance(v, Predicate) and "duplicated" in str(v.to_json()) for v in (filters or {}).values()):
        # A window isn't allowed in a filter.
        return df.withColumn("__keep", condition(df, filters)).filter("__keep").drop("__keep")
    return df.filter(condition(df, filters)) if filters else df
