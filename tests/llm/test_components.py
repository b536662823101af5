"""Connected components of paths whose edges lie in a partition each, where union-find can't join them."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.llm.components import connected
from loomgraph.operators import algorithms

SPLIT = [(3, 2), (4, 3), (5, 4), (5, 1)]


def path(seed):
    order = random.Random(seed).sample(range(1, 9), 8)
    return [(max(e), min(e)) for e in zip(order, order[1:], strict=False)]


def apart(spark, edges):
    return spark.createDataFrame(spark.sparkContext.parallelize(edges, len(edges)), "u long, v long")


@pytest.mark.parametrize("edges", [SPLIT, path(1), path(4)])
def test_a_path_is_one_component(spark, edges):
    nodes = {x for e in edges for x in e}
    assert sorted(map(tuple, connected(apart(spark, edges)).collect())) == sorted((x, min(nodes)) for x in nodes)
    g = Graph(edges=apart(spark, edges).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    assert sorted(map(tuple, algorithms.connected_components(g).collect())) == sorted((x, min(nodes)) for x in nodes)
