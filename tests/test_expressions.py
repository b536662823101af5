"""Pins of the value semantics, each evaluated through one row."""

import math

import pytest

from loomgraph.errors import GraphError
from loomgraph.functions import expressions as X

PINS = {
    "7 / 2": 3, "-7 / 2": -3, "-7 % 3": -1, "7.0 / 2": 3.5, "1.0 / 0": math.inf, "2.5 + 1": 3.5, "0x1F": 31, "round(-1.5)": -1.0, "round(2.5)": 3.0, "round(0.49999999999999994)": 0.0, "round(2.675, 2)": 2.67,
    "floor(2.7)": 2.0, "ceil(2.1)": 3.0, "sign(-3)": -1, "null = null": None, "1 = 'a'": False, "1 < 'a'": None, "true < 1": None, "1 < 2 < 3": True, "[1, null] = [1, null]": None, "[1, 2] = [1, 3]": False, "[1] = [1, 2]": False,
    "1 IN [2, null]": None, "1 IN [1, null]": True, "1 IN []": False, "'abc' =~ 'a.c'": True, "'abcd' =~ 'a.c'": False, "'abc' STARTS WITH 'ab'": True, "null OR true": True, "null AND false": False, "true XOR null": None,
    "[1, 2, 3][-1]": 3, "[1, 2, 3][9]": None, "[1, 2, 3][1..]": [2, 3], "[1, 2, 3][..-1]": [1, 2], "range(3, 1)": [], "range(3, 1, -1)": [3, 2, 1], "[x IN [1, 2, 3] WHERE x > 1 | x * 10]": [20, 30], "any(x IN [1, null] WHERE x = 1)": True,
    "all(x IN [1, null] WHERE x = 1)": None, "none(x IN [] WHERE x)": True, "single(x IN [1, 1] WHERE x = 1)": False, "size('abc')": 3, "size(null)": None, "head([])": None, "tail([1, 2])": [2], "reverse('abc')": "cba",
    "toInteger('x')": None, "toInteger('3.9')": 3, "toFloat('1e2')": 100.0, "toBoolean('yes')": True, "coalesce(null, 2)": 2, "CASE WHEN null THEN 1 ELSE 2 END": 2, "CASE 3 WHEN 3 THEN 'a' END": "a", "substring('hello', 1, 3)": "ell",
    "{a: 1, b: 'x'}.b": "x", "[1] + 2": [1, 2], "'a' + 1": "a1", "[1] + [2]": [1, 2], "toString(1)": "1", "abs(-2)": 2, "NOT null": None, "1 IS NOT NULL": True, "date('2024-02-29').day": 29, "v <> 1": None,
}


def test_pins(spark):
    df = spark.sql("SELECT CAST(NULL AS BIGINT) AS v")
    scope = X.Scope(df)
    row = df.select(*(X.column(t, scope).alias(f"c{i}") for i, t in enumerate(PINS))).first()
    wrong = {t: (row[i], want) for i, (t, want) in enumerate(PINS.items()) if row[i] != want}
    assert not wrong


@pytest.mark.parametrize("text", ["1 +", "x ^ 2", "a LIKE 'b'", "nosuch(1)", "sum(1)", "[1, 'a']", "unknown"])
def test_refused(spark, text):
    with pytest.raises(GraphError):
        X.column(text, X.Scope(spark.range(1).toDF("v")))


def test_integer_division_by_zero_raises(spark):
    df = spark.range(1).toDF("v")
    with pytest.raises(Exception, match="ZERO"):
        df.select(X.column("1 / v", X.Scope(df))).collect()
