"""Graph views of relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _node(df: DataFrame, prefix: str, label: str, id_column: str, **columns: str) -> DataFrame:
    return df.select(key(prefix, id_column).alias("id"), F.lit(label).alias("label"), *(F.col(c).alias(k) for k, c in columns.items()))


def _edge(df: DataFrame, kind: str, src: tuple[str, str], dst: tuple[str, str], unique: str | None) -> DataFrame:
    """Edges of a table; without a unique column the id is a hash of the whole row, so that nothing is written before a filter."""
    eid = F.col(unique) if unique else F.xxhash64(*df.columns)
    return df.select(F.concat(F.lit(f"{kind}:"), eid.cast("string")).alias("eid"), key(*src).alias("src"), key(*dst).alias("dst"), F.lit(kind).alias("type"))


NODES = {
    "Customer": lambda s, d: _node(table(s, d, "customer"), "c", "Customer", "c_custkey", name="c_name", acctbal="c_acctbal", segment="c_mktsegment", key="c_custkey"),
    "Order": lambda s, d: _node(table(s, d, "orders"), "o", "Order", "o_orderkey", totalprice="o_totalprice", status="o_orderstatus", orderdate="o_orderdate", priority="o_orderpriority", key="o_orderkey"),
    "Part": lambda s, d: _node(table(s, d, "part"), "p", "Part", "p_partkey", name="p_name", brand="p_brand", size="p_size", retailprice="p_retailprice", key="p_partkey"),
    "Supplier": lambda s, d: _node(table(s, d, "supplier"), "s", "Supplier", "s_suppkey", name="s_name", acctbal="s_acctbal", key="s_suppkey"),
    "Nation": lambda s, d: _node(table(s, d, "nation").withColumn("k", F.col("n_nationkey").cast("long")), "n", "Nation", "n_nationkey", name="n_name", key="k"),
    "Region": lambda s, d: _node(table(s, d, "region").withColumn("k", F.col("r_regionkey").cast("long")), "r", "Region", "r_regionkey", name="r_name", key="k"),
}
EDGES = {
    "PLACED": lambda s, d: _edge(table(s, d, "orders"), "PLACED", ("c", "o_custkey"), ("o", "o_orderkey"), "o_orderkey"),
    "CONTAINS": lambda s, d: _edge(table(s, d, "lineitem"), "CONTAINS", ("o", "l_orderkey"), ("p", "l_partkey"), None),
    "SUPPLIED_BY": lambda s, d: _edge(table(s, d, "lineitem"), "SUPPLIED_BY", ("o", "l_orderkey"), ("s", "l_suppkey"), None),
    "CUSTOMER_IN": lambda s, d: _edge(table(s, d, "customer"), "CUSTOMER_IN", ("c", "c_custkey"), ("n", "c_nationkey"), "c_custkey"),
    "SUPPLIER_IN": lambda s, d: _edge(table(s, d, "supplier"), "SUPPLIER_IN", ("s", "s_suppkey"), ("n", "s_nationkey"), "s_suppkey"),
    "IN_REGION": lambda s, d: _edge(table(s, d, "nation"), "IN_REGION", ("n", "n_nationkey"), ("r", "n_regionkey"), "n_nationkey"),
}


def commerce(spark: SparkSession, folder: str, labels: list[str], types: list[str]) -> Graph:
    """The parts of the commerce graph that a query needs; ids are ``prefix:key``."""
    both = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return Graph(edges=both([EDGES[t](spark, folder) for t in types]), nodes=both([NODES[k](spark, folder) for k in labels]), edge="eid")


def turns(spark: SparkSession, folder: str) -> Graph:
    """Conversation turns ``conv:turn``, each with an edge to the next."""
    t = table(spark, folder, "conversations")
    at = lambda shift: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + shift).cast("string"))
    nodes = t.select(at(0).alias("id"), "conv_id", "turn", "role").dropDuplicates(["id"])
    edges = t.select(F.concat(F.lit("e"), at(0)).alias("eid"), at(0).alias("src"), at(1).alias("dst"), F.lit("NEXT").alias("type")).dropDuplicates(["eid"])
    return Graph(edges=edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("eid", "src", "dst", "type"), nodes=nodes, edge="eid")
