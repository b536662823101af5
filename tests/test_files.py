"""Round trips of graph files, the GEXF reader, streams, and refused query texts."""

import pytest

from loomgraph.errors import GraphError
from loomgraph.graph import Graph
from loomgraph.sources.files import read_gexf, read_graph, write_gexf, write_graph
from loomgraph.streaming.edges import windowed_degrees


@pytest.fixture()
def graph(spark):
    nodes = spark.createDataFrame([("a", 1, 0.5, True), ("b", None, 1.5, False)], "id string, v long, w double, f boolean")
    return Graph(nodes=nodes, edges=spark.createDataFrame([("e1", "a", "b", "K")], "eid string, src string, dst string, type string"), edge="eid")


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_folder_round_trip(spark, graph, tmp_path, kind):
    write_graph(graph, f"{tmp_path}/{kind}", kind)
    back = read_graph(spark, f"{tmp_path}/{kind}")
    assert sorted(back.nodes.collect()) == sorted(graph.nodes.collect()) or {tuple(r) for r in back.nodes.collect()} == {tuple(r) for r in graph.nodes.collect()}
    assert back.nodes.schema == graph.nodes.schema and back.edges.collect() == graph.edges.collect() and back.edge == "eid"


def test_gexf_round_trip(spark, graph, tmp_path):
    write_gexf(graph, f"{tmp_path}/g.gexf")
    back = read_gexf(spark, f"{tmp_path}/g.gexf")
    assert {(r.id, r.v, r.w, r.f) for r in back.nodes.collect()} == {("a", 1, 0.5, True), ("b", None, 1.5, False)}
    assert [(r.source, r.target) for r in back.edges.collect()] == [("a", "b")]


@pytest.mark.parametrize("text", ["CREATE (a)", "MATCH (a)", "MATCH (a)-->(b), (c)-->(d) RETURN a.id AS a", "MATCH (a) RETURN a.x AS p, a.y AS p", "CALL graph.k_core() YIELD x RETURN x", "MATCH (a) RETURN count(*) AS n LIMIT -1", "MATCH p = (a)-->(b) WHERE EXISTS { (x)-->(y) } RETURN length(p) AS n"])
def test_refused(graph, text):
    with pytest.raises(GraphError):
        graph.query(text)


def test_stream_of_edges(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1L AS s UNION ALL SELECT timestamp'2024-01-01 00:20:00', 1L UNION ALL SELECT timestamp'2024-01-01 01:10:00', 2L").write.parquet(f"{tmp_path}/in")
    stream = windowed_degrees(spark.readStream.schema("ts timestamp, s long").parquet(f"{tmp_path}/in"), "ts", "s")
    run = stream.writeStream.format("memory").queryName("degrees_").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.node, r.degree) for r in spark.table("degrees_").collect()} == {(1, 2), (2, 1)}
