"""String predicates, query strings and the wire form, on rows."""

import re

import pytest

from loomgraph.functions import predicates as P
from loomgraph.graph import Graph
from loomgraph.plans import ops as O
from loomgraph.plans.traverse import query_filter

TEXTS = ["abc", "ABC", "abc\n", "a\nb", "A&B", "A and B", "p|q", "p or q", "é1", "", None]


def hits(spark, p, values=TEXTS, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")
    return [r.t for r in df.select("i", p.column(df["v"], df.schema["v"].dataType).alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("flags", [0, re.I, re.M, re.S, re.I | re.M, re.X, re.A])
@pytest.mark.parametrize("pat", ["abc", "a.b", "^b", "c$", r"\w1", "a b c"])
def test_patterns_are_pythons(spark, pat, flags):
    for make, test in ((P.contains, re.search), (P.match, re.match), (P.fullmatch, re.fullmatch)):
        want = [None if v is None else bool(test(pat, v, flags)) for v in TEXTS]
        assert hits(spark, make(pat, flags=flags)) == want, make.__name__


def test_null_policy(spark):
    assert hits(spark, P.contains("x"), [None, "x"]) == [None, True]
    assert hits(spark, P.contains("x", na=True), [None, "x"]) == [True, True] and hits(spark, P.isalpha(), [None]) == [None]
    assert hits(spark, P.contains("5"), [5], "long") == [None] and hits(spark, P.startswith("5", na=False), [5], "long") == [False]
    df = spark.createDataFrame([(None,), ("x",)], "v string")
    assert P.filter_by_dict(df, {"v": P.contains("y")}).count() == 0


def test_classes_see_the_last_newline(spark):
    for make in (P.isalpha, P.isalnum, P.isnumeric, P.isdigit, P.isdecimal):
        values = ["abc\n", "12\n", "abc", "12", ""]
        assert hits(spark, make(), values) == [getattr(v, make.__name__)() for v in values]


@pytest.mark.parametrize("text, want", [("v == 'A&B'", {"A&B"}), ("v == 'p|q' | v == \"abc\"", {"p|q", "abc"}), ("v =~ 'A.*' & ~(v == 'ABC')", {"A&B", "A and B"}), ("v in ['abc', 'ABC'] and not v == 'abc'", {"ABC"}), ("v = 'none' or v = 'True'", set())])
def test_query_strings(spark, text, want):
    df = spark.createDataFrame([(v,) for v in TEXTS], "v string")
    assert {r.v for r in query_filter(df, text).collect()} == want


def test_wire_form(spark):
    wire = {"type": "Chain", "chain": [{"type": "Node", "filter_dict": {"v": {"type": "AllOf", "predicates": [{"type": "GT", "val": 1}, {"type": "IsIn", "options": [2, 3, 9]}]}}}, {"type": "Edge", "direction": "forward", "hops": 1, "edge_match": {"w": {"type": "Between", "lower": 0, "upper": 5, "inclusive": True}}}, {"type": "Node"}]}
    g = Graph(nodes=spark.createDataFrame([(i, i) for i in range(5)], "id long, v long"), edges=spark.createDataFrame([(2, 1, 4), (3, 1, 9), (1, 0, 1)], "src long, dst long, w long"))
    assert {r.id for r in g.chain(wire).nodes.collect()} == {2, 1}
    back = O.to_json(O.from_json(wire))
    assert back["chain"][0]["filter_dict"]["v"]["predicates"][0] == {"type": "GT", "val": 1} and O.to_json(O.from_json(back)) == back
    assert P.from_json({"type": "GE", "val": {"type": "date", "value": "2024-01-02"}}).args["value"].day == 2
    assert all(P.from_json({"type": P.WIRE[k]} | {}).name == k for k in P.BUILD if k != "all_of")
