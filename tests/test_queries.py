"""Every registered graph query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomgraph import queries as graph

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or (not isinstance(v, (list, str)) and pd.isna(v)):
        return None
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
        return str(v)
    return round(float(v), 9) if hasattr(v, "__float__") else str(v)


def rows(df, columns):
    return sorted(str([plain(x) for x in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(graph.SQL))
def test_equals_duckdb(spark, duck, name):
    want, got = duck.execute(graph.SQL[name]).fetchdf(), graph.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(want, columns) == rows(got, columns)


@pytest.mark.parametrize("name", sorted(set(graph.QUERIES) - set(graph.SQL)))
def test_runs(spark, name):
    assert graph.QUERIES[name](spark, DATA).count() > 0


def test_pagerank_sums_to_one(spark):
    assert abs(graph.QUERIES["pagerank"](spark, DATA).agg({"pagerank": "sum"}).first()[0] - 1) < 1e-6
