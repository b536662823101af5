"""The graph engine's registered queries, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph.functions import predicates as P
from loomgraph.graph import Graph
from loomgraph.operators import algorithms as A
from loomgraph.operators import transforms as T
from loomgraph.plans import ops as O
from loomgraph.sources.tables import commerce, key, table, turns
from loomgraph.streaming.edges import windowed_degrees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = "CAST(o_orderdate AS DATE)"
BOTH_NATIONS = "(SELECT 'c:' || c_custkey AS id, c_nationkey AS k FROM customer UNION ALL SELECT 's:' || s_suppkey, s_nationkey FROM supplier)"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def text_query(name: str, labels: list[str], types: list[str], text: str, sql: str) -> None:
    """Registers a query text over part of the commerce graph."""
    QUERIES[name] = lambda spark, d: commerce(spark, d, labels, types).query(text)
    SQL[name] = sql


text_query(
    "commerce_segments", ["Customer", "Order"], ["PLACED"],
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 250000 RETURN c.segment AS seg, count(*) AS n ORDER BY n DESC, seg",
    "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000 GROUP BY 1",
)


@query("SELECT 'c:' || c_custkey AS id, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def node_filter_pred(spark, d):
    g = commerce(spark, d, ["Customer"], ["CUSTOMER_IN"])
    return g.chain([O.n({"acctbal": P.gt(0), "segment": P.is_in(["BUILDING", "MACHINERY"])})]).nodes.select("id", "acctbal")


def _suite(df: DataFrame, id_column: str, column: str, tests: dict[str, P.Predicate]) -> DataFrame:
    kind = df.schema[column].dataType
    return df.select(id_column, *(p.column(F.col(column), kind).alias(k) for k, p in tests.items()))


@query("""SELECT p_partkey, contains(p_name, 'a') AS has_a, contains(lower(p_name), 'RE') OR contains(lower(p_name), 're') AS has_re, starts_with(p_name, 's') AS s_, suffix(p_name, 'e') OR suffix(p_name, 'n') AS _e,
  regexp_matches(p_name, '^[a-m]') AS m, regexp_full_match(p_name, '[a-z ]+') AS f, regexp_full_match(p_name, '[A-Za-z]+') AS alpha, regexp_full_match(p_brand, '[A-Za-z0-9]+') AS alnum FROM (SELECT p_partkey, p_name, p_brand FROM part)""")
def pred_string_suite(spark, d):
    part = table(spark, d, "part")
    tests = {"has_a": P.contains("a"), "has_re": P.contains("RE", case=False), "s_": P.startswith("s"), "_e": P.endswith(("e", "n")), "m": P.match("[a-m]"), "f": P.fullmatch("[a-z ]+"), "alpha": P.isalpha()}
    return _suite(part, "p_partkey", "p_name", tests).join(_suite(part, "p_partkey", "p_brand", {"alnum": P.isalnum()}), "p_partkey")


@query(f"""SELECT o_orderkey, day({DAY}) = 1 AS ms, {DAY} = last_day({DAY}) AS me, {DAY} = date_trunc('quarter', {DAY}) AS qs, {DAY} = last_day({DAY}) AND month({DAY}) % 3 = 0 AS qe,
  month({DAY}) = 1 AND day({DAY}) = 1 AS ys, month({DAY}) = 12 AND day({DAY}) = 31 AS ye, year({DAY}) % 4 = 0 AND (year({DAY}) % 100 <> 0 OR year({DAY}) % 400 = 0) AS leap FROM orders""")
def pred_temporal_suite(spark, d):
    tests = {"ms": P.is_month_start(), "me": P.is_month_end(), "qs": P.is_quarter_start(), "qe": P.is_quarter_end(), "ys": P.is_year_start(), "ye": P.is_year_end(), "leap": P.is_leap_year()}
    return _suite(table(spark, d, "orders"), "o_orderkey", "o_orderdate", tests)


@query("SELECT count(*) FILTER (n > 1) AS repeated, count(*) FILTER (n = 1) AS single FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)")
def pred_duplicated(spark, d):
    df = table(spark, d, "customer").withColumn("k", F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    marked = df.select("k", P.duplicated(False).column(F.col("k"), df.schema["k"].dataType).alias("dup")).distinct()
    return marked.agg(F.sum(F.col("dup").cast("long")).alias("repeated"), F.sum((~F.col("dup")).cast("long")).alias("single"))


@query("SELECT p_partkey, p_size > 10 AND p_size <= 40 AND p_size <> 20 AS both, p_size NOT IN (1, 2) AND p_size BETWEEN 5 AND 15 AS mid FROM part")
def pred_all_of(spark, d):
    tests = {"both": P.all_of(P.gt(10), P.le(40), P.ne(20)), "mid": P.between(5, 15)}
    return _suite(table(spark, d, "part"), "p_partkey", "p_size", tests)


@query("SELECT 'c:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%1%' UNION SELECT 'n:' || n_nationkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name LIKE '%1%'")
def hop1_forward(spark, d):
    g = commerce(spark, d, ["Customer", "Nation"], ["CUSTOMER_IN"])
    return g.chain([O.n({"label": "Customer"}), O.e_forward({"type": "CUSTOMER_IN"}), O.n({"name": P.contains("1", regex=False), "label": "Nation"})]).nodes.select("id")


@query("SELECT 'PLACED:' || o_orderkey AS eid FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 AND c_mktsegment = 'BUILDING'")
def hop1_reverse(spark, d):
    g = commerce(spark, d, ["Customer", "Order"], ["PLACED"])
    return g.chain([O.n({"totalprice": P.gt(400000)}), O.e_reverse(), O.n({"segment": "BUILDING"})]).edges.select("eid")


@query("SELECT 'r:' || n_regionkey AS id FROM nation UNION SELECT 'n:' || n_nationkey FROM nation")
def hop1_undirected(spark, d):
    return commerce(spark, d, ["Nation", "Region"], ["IN_REGION"]).chain([O.n({"label": "Region"}), O.e_undirected(), O.n()]).nodes.select("id")


@query("""WITH x AS (SELECT c_custkey, o_orderkey, l_partkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  WHERE c_acctbal > 5000 AND o_totalprice > 300000 AND p_size > 40)
  SELECT 'c:' || c_custkey AS id FROM x UNION SELECT 'o:' || o_orderkey FROM x UNION SELECT 'p:' || l_partkey FROM x""")
def chain2_pruned(spark, d):
    g = commerce(spark, d, ["Customer", "Order", "Part"], ["PLACED", "CONTAINS"])
    return g.chain([O.n({"label": "Customer", "acctbal": P.gt(5000)}), O.e_forward({"type": "PLACED"}), O.n({"totalprice": P.gt(300000)}), O.e_forward({"type": "CONTAINS"}), O.n({"size": P.gt(40)})]).nodes.select("id")


@query("SELECT DISTINCT 's:' || s_suppkey AS id FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal < s_acctbal")
def same_path_where(spark, d):
    g = commerce(spark, d, ["Customer", "Supplier", "Nation"], ["CUSTOMER_IN", "SUPPLIER_IN"])
    out = g.chain([O.n({"label": "Customer"}, name="a"), O.e_forward(), O.n(), O.e_reverse({"type": "SUPPLIER_IN"}), O.n(name="b")], where=[O.compare(O.col("a", "acctbal"), "<", O.col("b", "acctbal"))])
    return out.nodes.filter("b").select("id")


text_query(
    "bindings_multi_alias", ["Customer", "Order", "Nation"], ["PLACED", "CUSTOMER_IN"],
    "MATCH (n:Nation)<-[:CUSTOMER_IN]-(c:Customer)-[:PLACED]->(o:Order) WHERE o.status = 'F' AND c.acctbal > 9000 RETURN n.name AS nation, c.key AS cust, o.key AS ord",
    "SELECT n_name AS nation, c_custkey AS cust, o_orderkey AS ord FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 9000",
)
text_query(
    "trail_no_reuse", ["Customer", "Nation"], ["CUSTOMER_IN"],
    "MATCH (a:Customer)-[:CUSTOMER_IN]->(n:Nation)<-[:CUSTOMER_IN]-(b:Customer) RETURN n.key AS nation, count(*) AS n",
    "SELECT a.c_nationkey::BIGINT AS nation, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey GROUP BY 1",
)
text_query(
    "varlen_1_3", ["Customer", "Nation", "Region"], ["CUSTOMER_IN", "IN_REGION"],
    "MATCH (r:Region)<-[*1..3]-(x) RETURN r.key AS region, x.label AS label, count(*) AS n",
    "SELECT n_regionkey::BIGINT AS region, 'Nation' AS label, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey::BIGINT, 'Customer', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
)


@query("""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT conv_id, turn FROM t WHERE turn = 0 UNION SELECT t.conv_id, t.turn FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
  SELECT conv_id || ':' || turn AS id FROM r WHERE turn > 0 OR EXISTS (FROM t WHERE t.conv_id = r.conv_id AND t.turn = 1)""")
def reach_fixed_point(spark, d):
    return turns(spark, d).chain([O.n({"turn": 0}), O.e_forward(to_fixed_point=True), O.n()]).nodes.select("id")


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT count(*) AS n FROM t a WHERE EXISTS (FROM t b WHERE b.conv_id = a.conv_id AND b.turn = 2) AND EXISTS (FROM t b WHERE b.conv_id = a.conv_id AND b.turn = 1)
  AND a.turn <= CASE WHEN EXISTS (FROM t b WHERE b.conv_id = a.conv_id AND b.turn = 3) THEN 3 ELSE 2 END AND a.turn >= 0 AND EXISTS (FROM t b WHERE b.conv_id = a.conv_id AND b.turn = 0)""")
def hop_range_2_3(spark, d):
    return turns(spark, d).chain([O.n({"turn": 0}), O.e_forward(min_hops=2, max_hops=3), O.n()]).nodes.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS seg, count(*) AS n, count(DISTINCT c_nationkey) AS nations, min(c_custkey) AS lo, max(c_custkey) AS hi, sum(c_custkey)::BIGINT AS s, avg(c_custkey) AS m FROM customer GROUP BY 1")
def group_by_aggs(spark, d):
    g = commerce(spark, d, ["Customer"], ["CUSTOMER_IN"]).replace(nodes=table(spark, d, "customer").withColumnRenamed("c_custkey", "id"))
    return g.chain([O.rows(), O.group_by([("seg", "CASE WHEN c_acctbal > 0 THEN c_mktsegment END")], [("n", "count"), ("nations", "count_distinct", "c_nationkey"), ("lo", "min", "id"), ("hi", "max", "id"), ("s", "sum", "id"), ("m", "avg", "id")])])


@query("SELECT c_mktsegment AS seg, coalesce(sum(CASE WHEN c_custkey < 0 THEN 1 END), 0)::BIGINT AS none, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS some FROM customer GROUP BY 1")
def sum_of_nulls(spark, d):
    g = Graph(edges=table(spark, d, "nation"), nodes=table(spark, d, "customer"), node="c_custkey", src="n_nationkey", dst="n_regionkey")
    return g.chain([O.rows(), O.group_by([("seg", "c_mktsegment")], [("none", "sum", "CASE WHEN c_custkey < 0 THEN 1 END"), ("some", "count", "CASE WHEN c_acctbal > 0 THEN 1 END")])])


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def collect_ordered(spark, d):
    df = table(spark, d, "nation")
    c, _ = X.aggregate(X.parse("collect(n_name)"), X.Scope(df), ordinal="n_name")
    return df.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(c, ",").alias("names"))


@query("SELECT c_custkey AS id, nullif(c_acctbal, greatest(c_acctbal, 0)) AS v FROM customer ORDER BY v DESC NULLS FIRST, id OFFSET 5 LIMIT 20")
def order_nulls_topk(spark, d):
    g = Graph(edges=table(spark, d, "nation"), nodes=table(spark, d, "customer"), node="c_custkey", src="n_nationkey", dst="n_regionkey")
    return g.chain([O.rows(), O.select([("id", "c_custkey"), ("v", "CASE WHEN c_acctbal < 0 THEN c_acctbal END")]), O.order_by([("v", "desc"), ("id", "asc")]), O.skip(5), O.limit(20)])


text_query("unwind_range", ["Region"], ["IN_REGION"], "MATCH (r:Region) UNWIND range(0, r.key) AS i RETURN r.key AS k, i", "SELECT r_regionkey::BIGINT AS k, unnest(range(0, r_regionkey + 1))::BIGINT AS i FROM region")
text_query(
    "list_comp", ["Nation"], ["IN_REGION"], "MATCH (n:Nation) RETURN n.key AS k, size([x IN range(1, n.key) WHERE x % 3 = 0 | x * x]) AS m, [x IN range(1, n.key) WHERE x % 3 = 0 | x * x][-1] AS l",
    "SELECT n_nationkey::BIGINT AS k, (n_nationkey // 3)::BIGINT AS m, CASE WHEN n_nationkey >= 3 THEN power(n_nationkey // 3 * 3, 2)::BIGINT END AS l FROM nation",
)
text_query(
    "quantifiers", ["Nation"], ["IN_REGION"], "MATCH (n:Nation) RETURN n.key AS k, any(x IN range(1, n.key) WHERE x > 5) AS some, all(x IN range(1, n.key) WHERE x < 9) AS every, none(x IN range(1, n.key) WHERE x = 4) AS no, single(x IN range(1, n.key) WHERE x % 7 = 0) AS one",
    "SELECT n_nationkey::BIGINT AS k, n_nationkey > 5 AS some, n_nationkey < 9 AS every, n_nationkey < 4 AS no, n_nationkey BETWEEN 7 AND 13 AS one FROM nation",
)
text_query(
    "arith_int_div", ["Part"], ["IN_REGION"], "MATCH (p:Part) RETURN p.key AS k, p.size / 7 AS q, p.size % 7 AS r, p.retailprice / 2 AS h, -p.size AS m, toString(p.size) + 'x' AS t, p.size / 2.0 AS f",
    "SELECT p_partkey AS k, (p_size // 7)::BIGINT AS q, (p_size % 7)::BIGINT AS r, p_retailprice / 2 AS h, (-p_size)::BIGINT AS m, p_size || 'x' AS t, p_size / 2.0::DOUBLE AS f FROM part",
)
text_query("round_pins", ["Region"], ["IN_REGION"], "MATCH (r:Region) RETURN r.key AS k, round(r.key - 1.5) AS a, round(r.key + 0.49999999999999994 - r.key) AS b, floor(r.key / 2.0) AS c, sign(r.key - 2) AS d", "SELECT r_regionkey::BIGINT AS k, r_regionkey - 1.0::DOUBLE AS a, CASE WHEN r_regionkey < 1 THEN 0.0::DOUBLE ELSE floor(r_regionkey + 0.49999999999999994::DOUBLE - r_regionkey + 0.5) END AS b, floor(r_regionkey / 2.0::DOUBLE) AS c, sign(r_regionkey - 2)::BIGINT AS d FROM region")
text_query(
    "kleene_logic", ["Nation"], ["IN_REGION"], "MATCH (n:Nation) WITH n.key AS k, CASE WHEN n.key > 20 THEN null ELSE n.key > 10 END AS a, CASE WHEN n.key % 3 = 0 THEN null ELSE n.key % 3 = 1 END AS b RETURN k, a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS w, k IN [1, null, 3] AS i",
    "WITH t AS (SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey <= 20 THEN n_nationkey > 10 END AS a, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 3 = 1 END AS b FROM nation) SELECT k, a AND b AS x, a OR b AS y, a <> b AS z, NOT a AS w, k IN (1, NULL, 3) AS i FROM t",
)
text_query(
    "string_functions", ["Part"], ["IN_REGION"], "MATCH (p:Part) WHERE p.name CONTAINS 'a' AND NOT p.brand STARTS WITH 'Z' RETURN p.key AS k, toUpper(p.name) AS u, substring(p.name, 1, 3) AS s, size(p.name) AS n, reverse(p.brand) AS r, coalesce(null, p.brand) AS c, p.name =~ '.*[aeiou]' AS v",
    "SELECT p_partkey AS k, upper(p_name) AS u, substring(p_name, 2, 3) AS s, length(p_name) AS n, reverse(p_brand) AS r, p_brand AS c, regexp_full_match(p_name, '.*[aeiou]') AS v FROM part WHERE contains(p_name, 'a') AND NOT starts_with(p_brand, 'Z')",
)
text_query(
    "optional_match_count", ["Customer", "Order"], ["PLACED"], "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.key AS k, count(o) AS n",
    "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1",
)
text_query("exists_semi", ["Customer", "Order"], ["PLACED"], "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {status: 'P'}) RETURN c.key AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
text_query("not_exists_anti", ["Customer", "Order"], ["PLACED"], "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.key AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)")
text_query("exists_mark", ["Customer", "Order"], ["PLACED"], "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {status: 'P'}) OR c.acctbal < 0 RETURN c.key AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 OR EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
text_query("union_distinct", ["Customer", "Supplier", "Nation"], ["CUSTOMER_IN", "SUPPLIER_IN"], "MATCH (c:Customer)-->(n) WHERE c.acctbal > 9000 RETURN n.name AS nation UNION MATCH (s:Supplier)-->(n) RETURN n.name AS nation", "SELECT n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
text_query("union_all", ["Customer", "Supplier", "Nation"], ["CUSTOMER_IN", "SUPPLIER_IN"], "MATCH (c:Customer)-->(n) WHERE c.acctbal > 9000 RETURN n.name AS nation UNION ALL MATCH (s:Supplier)-->(n) RETURN n.name AS nation", "SELECT n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION ALL SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
text_query(
    "with_reentry", ["Customer", "Order", "Nation"], ["PLACED", "CUSTOMER_IN"], "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n > 12 MATCH (c)-[:CUSTOMER_IN]->(x) RETURN x.name AS nation, n, count(*) AS customers",
    "SELECT n_name AS nation, n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2",
)
text_query("return_distinct", ["Customer"], ["CUSTOMER_IN"], "MATCH (c:Customer) RETURN DISTINCT c.segment AS seg, c.acctbal > 5000 AS rich", "SELECT DISTINCT c_mktsegment AS seg, c_acctbal > 5000 AS rich FROM customer")
text_query("post_aggregate", ["Customer"], ["CUSTOMER_IN"], "MATCH (c:Customer) RETURN c.segment AS seg, count(c) * 2 + 1 AS n, size(collect(DISTINCT c.segment)) AS one", "SELECT c_mktsegment AS seg, count(*) * 2 + 1 AS n, 1::BIGINT AS one FROM customer GROUP BY 1")
text_query("cartesian_nodes", ["Region", "Nation"], ["IN_REGION"], "MATCH (r:Region), (n:Nation) WHERE r.key < n.key RETURN r.key AS r, n.key AS n", "SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM region, nation WHERE r_regionkey < n_nationkey")
text_query("whole_entity", ["Region"], ["IN_REGION"], "MATCH (r:Region) RETURN r.name AS name, labels(r)[0] AS label, keys(r)[0] AS first, id(r) AS id", "SELECT r_name AS name, 'Region' AS label, 'id' AS first, 'r:' || r_regionkey AS id FROM region")


@query("""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT conv_id, turn FROM t WHERE turn = 0 UNION SELECT t.conv_id, t.turn FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
  SELECT conv_id || ':' || turn AS id, turn AS hops FROM r WHERE turn BETWEEN 1 AND 5""")
def shortest_path_hops(spark, d):
    return turns(spark, d).query("MATCH p = shortestPath((a {turn: 0})-[:NEXT*..5]->(b)) RETURN b.id AS id, length(p) AS hops")


def _nations(spark, d):
    return commerce(spark, d, ["Customer", "Supplier", "Nation", "Region"], ["CUSTOMER_IN", "SUPPLIER_IN", "IN_REGION"])


@query(f"""SELECT 'n:' || n_nationkey AS id, (SELECT count(*) FROM {BOTH_NATIONS} WHERE k = n_nationkey)::INT AS degree_in, 1::INT AS degree_out FROM nation""")
def degrees(spark, d):
    return _nations(spark, d).get_degrees().nodes.filter("label = 'Nation'").select("id", "degree_in", "degree_out")


@query("SELECT count(*) AS n FROM orders WHERE o_custkey % 7 <> o_orderkey % 7")
def prune_self(spark, d):
    e = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("src"), (F.col("o_orderkey") % 7).alias("dst"))
    return Graph(edges=e).prune_self_edges().edges.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'CUSTOMER_IN:' || c_custkey AS eid FROM customer WHERE c_acctbal > 5000")
def keep_nodes(spark, d):
    g = commerce(spark, d, ["Customer", "Nation"], ["CUSTOMER_IN"])
    chosen = g.nodes.filter("label = 'Nation' OR acctbal > 5000").select("id")
    return g.keep_nodes(chosen).edges.select("eid")


@query("SELECT 'CUSTOMER_IN:' || c_custkey AS eid FROM customer WHERE c_nationkey NOT IN (3, 4)")
def drop_nodes(spark, d):
    return commerce(spark, d, ["Customer", "Nation"], ["CUSTOMER_IN"]).drop_nodes(["n:3", "n:4"]).edges.select("eid")


@query("SELECT DISTINCT 'c:' || o_custkey AS id FROM orders UNION SELECT 'o:' || o_orderkey FROM orders")
def materialize_nodes(spark, d):
    return commerce(spark, d, ["Customer"], ["PLACED"]).replace(nodes=None).materialize_nodes().nodes


@query("SELECT 'user_id::' || user_id AS \"nodeID\", 'user_id' AS type FROM events UNION SELECT 'event_type::' || event_type, 'event_type' FROM events UNION SELECT event_id::VARCHAR, 'EventID' FROM events")
def hypergraph_events_nodes(spark, d):
    return T.hypergraph(table(spark, d, "events"), ["user_id", "event_type"], "event_id").nodes.select("nodeID", "type")


@query("SELECT event_id::VARCHAR AS src, 'user_id::' || user_id AS dst, 'user_id' AS \"edgeType\" FROM events UNION ALL SELECT event_id::VARCHAR, 'event_type::' || event_type, 'event_type' FROM events")
def hypergraph_events_edges(spark, d):
    return T.hypergraph(table(spark, d, "events"), ["user_id", "event_type"], "event_id").edges.select("src", "dst", "edgeType")


@query("SELECT 'user_id::' || user_id AS src, 'event_type::' || event_type AS dst, event_id::VARCHAR AS \"EventID\" FROM events")
def hypergraph_direct(spark, d):
    return T.hypergraph(table(spark, d, "events"), ["user_id", "event_type"], "event_id", direct=True).edges.select("src", "dst", "EventID")


@query("SELECT c_mktsegment, c_nationkey, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS probs FROM customer GROUP BY 1, 2")
def conditional_prob(spark, d):
    return T.conditional_probs(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%ro%' OR p_brand ILIKE '%ro%' OR p_type ILIKE '%ro%'")
def search_any(spark, d):
    return Graph(edges=table(spark, d, "nation"), nodes=table(spark, d, "part"), node="p_partkey").search_nodes("Ro").nodes.select("p_partkey")


@query("""WITH e AS (SELECT 's:' || s_suppkey AS a, 'n:' || s_nationkey AS b FROM supplier UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d AS (SELECT a, count(*) AS n FROM u GROUP BY 1)
  SELECT x.a AS src, y.a AS dst, count(*) / (any_value(dx.n) + any_value(dy.n) - count(*)) AS jaccard_coeff FROM u x JOIN u y ON x.b = y.b AND x.a < y.a JOIN d dx ON dx.a = x.a JOIN d dy ON dy.a = y.a GROUP BY 1, 2""")
def jaccard_suppliers(spark, d):
    return A.jaccard(commerce(spark, d, ["Supplier", "Nation", "Region"], ["SUPPLIER_IN", "IN_REGION"]))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
  SELECT conv_id || ':' || turn AS id, min(conv_id || ':' || turn) OVER (PARTITION BY conv_id, run) AS component FROM s""")
def components(spark, d):
    return A.connected_components(turns(spark, d))


@query("SELECT DISTINCT conv_id || ':' || turn AS id, conv_id || ':' || turn AS component FROM conversations")
def strong_components(spark, d):
    return A.strongly_connected_components(turns(spark, d))


@query("SELECT 'n:' || n_nationkey AS id, 1::INT AS core_number FROM nation UNION ALL SELECT 'r:' || r_regionkey, CASE WHEN EXISTS (FROM nation WHERE n_regionkey = r_regionkey) THEN 1 ELSE 0 END FROM region")
def core_numbers(spark, d):
    return A.core_number(commerce(spark, d, ["Nation", "Region"], ["IN_REGION"]))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
  SELECT conv_id || ':' || turn AS id, (row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1)::INT AS level FROM s""")
def topological(spark, d):
    return T.topological_levels(turns(spark, d)).nodes.select("id", "level")


@query("SELECT 'r:0' AS id, 0::BIGINT AS distance UNION ALL SELECT 'n:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 's:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0")
def bfs_distance(spark, d):
    return A.bfs(_nations(spark, d), "r:0", directed=False)


@query("SELECT least(a.n, b.n) AS src, greatest(a.n, b.n) AS dst, count(*) AS cocitation FROM (SELECT l_orderkey AS o, 's:' || l_suppkey AS n FROM lineitem) a JOIN (SELECT l_orderkey AS o, 's:' || l_suppkey AS n FROM lineitem) b ON a.o = b.o AND a.n < b.n GROUP BY 1, 2")
def cocited(spark, d):
    e = table(spark, d, "lineitem").select(key("o", "l_orderkey").alias("src"), key("s", "l_suppkey").alias("dst"))
    return A.cocitation(Graph(edges=e))


@query()
def pagerank(spark, d):
    return A.pagerank(_nations(spark, d))


@query()
def hits(spark, d):
    return A.hits(_nations(spark, d))


@query()
def communities(spark, d):
    return A.label_propagation(_nations(spark, d))


@query("SELECT user_id AS node, date_trunc('hour', ts) AS start, count(*) AS degree FROM events GROUP BY 1, 2")
def windowed(spark, d):
    return windowed_degrees(table(spark, d, "events"), "ts", "user_id").select("node", "start", "degree")


@query("SELECT seg, count(*) AS n FROM (SELECT c_mktsegment AS seg FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000) GROUP BY 1")
def let_steps(spark, d):
    g = commerce(spark, d, ["Customer", "Order"], ["PLACED"])
    return g.let({"big": [O.n(), O.e_forward(), O.n({"totalprice": P.gt(300000)})], "counts": lambda step: step("big").query("MATCH (c)-->(o) RETURN c.segment AS seg, count(*) AS n")})


# Query strings, flags and nulls of predicates


@query("SELECT p_partkey FROM part WHERE (p_size > 40 AND NOT p_brand = 'A&B') OR p_name IN ('a|b', 'x ~ y') OR p_size = 7")
def pred_query_string(spark, d):
    g = Graph(edges=table(spark, d, "nation"), nodes=table(spark, d, "part"), node="p_partkey")
    return g.node_query("p_size > 40 & ~(p_brand == 'A&B') | p_name in ['a|b', \"x ~ y\"] | p_size == 7").nodes.select("p_partkey")


@query("SELECT p_partkey, regexp_matches(p_name, '[A-M]', 'i') AS i, regexp_full_match(p_name || chr(10) || p_brand, '(?s).*') AS s, false AS dot, regexp_matches(p_name || chr(10) || p_brand, '(?m)^[A-Z]') AS m, regexp_matches(p_name, '^[aeiou]', 'i') AS start FROM part")
def pred_flags(spark, d):
    part = table(spark, d, "part").withColumn("two", F.concat_ws("\n", "p_name", "p_brand"))
    own = {"i": P.contains("[A-M]", flags=re.I), "start": P.match("[aeiou]", flags=re.I)}
    two = {"s": P.fullmatch(".*", flags=re.S), "dot": P.fullmatch(".*"), "m": P.contains("^[A-Z]", flags=re.M)}
    return _suite(part, "p_partkey", "p_name", own).join(_suite(part, "p_partkey", "two", two), "p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN contains(c_name, '1') END AS plain, coalesce(c_acctbal > 0 AND contains(c_name, '1'), false) AS no, c_acctbal <= 0 OR contains(c_name, '1') AS yes,
  c_acctbal <= 0 AS gone, c_acctbal > 0 AS there FROM customer""")
def pred_na_policy(spark, d):
    df = table(spark, d, "customer").withColumn("t", F.when(F.col("c_acctbal") > 0, F.col("c_name")))
    return _suite(df, "c_custkey", "t", {"plain": P.contains("1"), "no": P.contains("1", na=False), "yes": P.contains("1", na=True), "gone": P.isna(), "there": P.notnull()})


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z ]*[a-z][a-z ]*') AS low, regexp_full_match(upper(p_brand), '.*[A-Z].*') AS up, regexp_full_match(p_size::VARCHAR, '[0-9]+') AS digits, false AS never FROM part")
def pred_case_suite(spark, d):
    part = table(spark, d, "part").withColumns({"u": F.upper("p_brand"), "s": F.col("p_size").cast("string")})
    parts = [_suite(part, "p_partkey", "p_name", {"low": P.islower()}), _suite(part, "p_partkey", "u", {"up": P.isupper()}), _suite(part, "p_partkey", "s", {"digits": P.isdigit(), "never": P.never_match()})]
    return parts[0].join(parts[1], "p_partkey").join(parts[2], "p_partkey")


# Hop labels and slices

WALK = """WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT conv_id, turn FROM t WHERE turn = 0 UNION SELECT t.conv_id, t.turn FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1) """


def _first_turns(g):
    return g.nodes.filter("turn = 0").select("id")


@query(WALK + "SELECT conv_id || ':' || turn AS id, turn::INT AS hop FROM r WHERE turn BETWEEN 1 AND 3 OR turn = 0")
def hop_node_labels(spark, d):
    g = turns(spark, d)
    return g.hop(_first_turns(g), hops=3, label_node_hops="hop", label_seeds=True).nodes.select("id", "hop")


@query(WALK + "SELECT 'e' || conv_id || ':' || (turn - 1) AS eid, turn::INT AS hop FROM r WHERE turn BETWEEN 2 AND 3")
def hop_output_slice(spark, d):
    g = turns(spark, d)
    return g.hop(_first_turns(g), hops=4, output_min_hops=2, output_max_hops=3, label_edge_hops="hop").edges.select("eid", "hop")


@query(WALK + "SELECT conv_id || ':' || turn AS id FROM r WHERE turn BETWEEN 1 AND 2")
def hop_wave_front(spark, d):
    g = turns(spark, d)
    return g.hop(_first_turns(g), return_as_wave_front=True, hops=2, direction="undirected").nodes.select("id")


@query(WALK + "SELECT conv_id || ':' || turn AS id FROM r a WHERE turn IN (0, 3) AND EXISTS (FROM r b WHERE b.conv_id = a.conv_id AND b.turn = 3)")
def hop_end_points(spark, d):
    return turns(spark, d).chain([O.n({"turn": 0}), O.e_forward(min_hops=3, max_hops=3, prune_to_endpoints=True), O.n()]).nodes.select("id")


# Temporal language

text_query(
    "temporal_columns", ["Order"], ["PLACED"],
    "MATCH (o:Order) WHERE o.orderdate >= localdatetime('1995-03-01T00:00') AND o.orderdate < localdatetime('1995-01-01T00:00') + duration({months: 6}) RETURN o.key AS k, o.orderdate + duration('P1M2DT3H') AS later, o.orderdate - duration('P1Y') AS earlier, o.orderdate.year AS y",
    "SELECT o_orderkey AS k, o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR AS later, o_orderdate - INTERVAL 1 YEAR AS earlier, year(o_orderdate)::BIGINT AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-07-01'",
)
text_query(
    "temporal_constants", ["Region"], ["IN_REGION"],
    "MATCH (r:Region) RETURN r.key AS k, toString(duration.between(date('1984-10-11'), date('2015-06-24'))) AS a, toString(duration.inDays(date('1984-10-11'), date('2015-06-24'))) AS b, time('12:00') AS c, toString(datetime({year: 2015, month: 7, day: 21, hour: 21, timezone: 'Europe/Stockholm'})) AS d, "
    "toString(date.truncate('week', date('2017-11-11'), {dayOfWeek: 2})) AS e, toString(duration('P1M') * 1.5) AS f, duration('P1DT1H0.5S').nanosecondsOfSecond AS g, toString(date('2024-01-31') + duration({months: 1})) AS h, localtime({hour: 12, minute: 31, millisecond: 645}) AS i, toString(date({year: 1984, week: 10, dayOfWeek: 3})) AS j",
    "SELECT r_regionkey::BIGINT AS k, 'P30Y8M13D' AS a, 'P11213D' AS b, '12:00Z' AS c, '2015-07-21T21:00+02:00[Europe/Stockholm]' AS d, '2017-11-07' AS e, 'P1M15DT5H14M33S' AS f, 500000000::BIGINT AS g, '2024-02-29' AS h, '12:31:00.645' AS i, '1984-03-07' AS j FROM region",
)

# Row calls with patterns, graphs in texts

PLACES = ([O.n({"label": "Customer", "acctbal": P.gt(9000)}, name="c"), O.e_forward({"type": "CUSTOMER_IN"}), O.n(name="n")], [O.n(name="n"), O.e_reverse({"type": "SUPPLIER_IN"}), O.n({"acctbal": P.gt(8000)}, name="s")])
RICH = "(SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000) c"
HAS = "EXISTS (FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 8000)"


def _places(spark, d, call):
    g = commerce(spark, d, ["Customer", "Supplier", "Nation"], ["CUSTOMER_IN", "SUPPLIER_IN"])
    return g.chain(O.to_json([O.rows(binding_ops=PLACES[0]), call]))


@query(f"SELECT c_custkey AS k FROM {RICH} WHERE NOT {HAS}")
def rows_anti_semi_apply(spark, d):
    return _places(spark, d, O.anti_semi_apply(PLACES[1], ["n"])).select(F.col("`c.key`").alias("k"))


@query(f"SELECT c_custkey AS k, {HAS} AS near FROM {RICH}")
def rows_semi_apply_mark(spark, d):
    return _places(spark, d, O.semi_apply_mark(PLACES[1], ["n"], "near")).select(F.col("`c.key`").alias("k"), "near")


@query(f"SELECT c_custkey AS k, s_suppkey AS s FROM {RICH} JOIN supplier ON s_nationkey = c_nationkey WHERE s_acctbal > 8000")
def rows_join_apply(spark, d):
    return _places(spark, d, O.join_apply(PLACES[1], ["n"])).select(F.col("`c.key`").alias("k"), F.col("`s.key`").alias("s"))


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def rows_alias_endpoints(spark, d):
    g = commerce(spark, d, ["Nation", "Region"], ["IN_REGION"])
    return g.chain([O.rows("edges", alias_endpoints={"a": "src", "b": "dst"}), O.select([("nation", "a.name"), ("region", "b.name")])])


text_query(
    "graph_constructor", ["Customer", "Order"], ["PLACED"], "GRAPH dear = GRAPH { MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 AND c.acctbal > 0 } USE dear MATCH (c:Customer)-->(o) RETURN c.key AS k, count(*) AS n",
    "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000 AND c_acctbal > 0 GROUP BY 1",
)
text_query("not_exists_some", ["Customer", "Order"], ["PLACED"], "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {status: 'P'}) RETURN c.key AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")


@query("SELECT 'n:' || n_nationkey AS id, ((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + 1)::INT AS degree FROM nation")
def call_degree_write(spark, d):
    return commerce(spark, d, ["Customer", "Nation", "Region"], ["CUSTOMER_IN", "IN_REGION"]).query("CALL graph.degree.write()").nodes.filter("label = 'Nation'").select("id", "degree")


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, count(DISTINCT substr(n_name, 1, 3)) AS heads FROM nation GROUP BY 1")
def collect_in_chain(spark, d):
    g = Graph(edges=table(spark, d, "nation"), nodes=table(spark, d, "nation"), node="n_nationkey", src="n_nationkey", dst="n_regionkey")
    out = g.chain([O.rows(), O.order_by([("n_name", "desc")]), O.group_by([("region", "n_regionkey")], [("names", "collect", "n_name"), ("heads", "collect_distinct", "substring(n_name, 0, 3)")])])
    return out.select("region", F.array_join("names", ",").alias("names"), F.size("heads").cast("long").alias("heads"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 0)")
def rows_distinct_count(spark, d):
    g = Graph(edges=table(spark, d, "nation"), nodes=table(spark, d, "customer"), node="c_custkey")
    return g.chain([O.rows(), O.where_rows(expr="c_acctbal > 0"), O.select(["c_custkey", "c_mktsegment", "c_nationkey"]), O.drop_cols(["c_custkey", "nope"]), O.distinct(), O.count_table("n")])


@query("SELECT NULL::BIGINT AS c_custkey")
def rows_fill_empty(spark, d):
    g = Graph(edges=table(spark, d, "nation"), nodes=table(spark, d, "customer"), node="c_custkey")
    return g.chain([O.rows(), O.where_rows(expr="c_custkey < 0"), O.select(["c_custkey"]), O.fill_empty_row()])


# Algorithms

RING = "SELECT DISTINCT (o_custkey * 7 + 3) % 60 AS src, (o_custkey * o_custkey + 11) % 60 AS dst FROM orders WHERE o_custkey % 3 = 0"
STARS = "(SELECT n_nationkey AS n, n_regionkey AS r, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation)"


def _ring(spark, d):
    """A graph of at most 60 nodes with cycles."""
    c = F.col("o_custkey")
    return Graph(edges=table(spark, d, "orders").filter("o_custkey % 3 = 0").select(((c * 7 + 3) % 60).alias("src"), ((c * c + 11) % 60).alias("dst")).distinct())


@query(f"""WITH RECURSIVE e AS ({RING}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), reach AS (SELECT id AS a, id AS b FROM v UNION SELECT a, dst FROM reach JOIN e ON b = src)
  SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def strong_components_cyclic(spark, d):
    return A.strongly_connected_components(_ring(spark, d))


DISTANCES = f"""WITH RECURSIVE o AS ({RING}), e AS (SELECT src AS u, dst AS v FROM o UNION SELECT dst, src FROM o), n AS (SELECT u AS id FROM e UNION SELECT v FROM e),
  w AS (SELECT id AS s, id AS t, 0 AS h FROM n UNION SELECT s, v, h + 1 FROM w JOIN e ON t = u WHERE h < 20), d AS (SELECT s, t, min(h) AS h FROM w GROUP BY 1, 2) """


@query(DISTANCES + "SELECT s AS id, max(h)::BIGINT AS eccentricity FROM d GROUP BY 1")
def eccentricities(spark, d):
    return A.eccentricity(_ring(spark, d))


@query(DISTANCES + "SELECT s AS id, round(coalesce((count(*) FILTER (h > 0))::DOUBLE / nullif(sum(h), 0) * (count(*) FILTER (h > 0)) / ((SELECT count(*) FROM n) - 1), 0), 9) AS closeness FROM d GROUP BY 1")
def closeness(spark, d):
    return A.closeness_centrality(_ring(spark, d), "closeness").withColumn("closeness", F.round("closeness", 9))


@query(DISTANCES + "SELECT s AS id, round(coalesce(sum(1.0::DOUBLE / h) FILTER (h > 0), 0) / ((SELECT count(*) FROM n) - 1), 9) AS harmonic FROM d GROUP BY 1")
def harmonic(spark, d):
    return A.harmonic_centrality(_ring(spark, d), "harmonic").withColumn("harmonic", F.round("harmonic", 9))


@query(f"""WITH b AS (SELECT *, sum(k + 1) OVER (PARTITION BY r) + 1 AS s FROM {STARS}), v AS (SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) AS n)
  SELECT 'n:' || b.n AS src, 'r:' || r AS dst, round((k + 1) * (s - k - 1) / (v.n * (v.n - 1) / 2.0::DOUBLE), 12) AS share FROM b, v
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, round((s - 1) / (v.n * (v.n - 1) / 2.0::DOUBLE), 12) FROM supplier JOIN b ON b.n = s_nationkey, v""")
def edge_betweenness(spark, d):
    g = commerce(spark, d, ["Supplier", "Nation", "Region"], ["SUPPLIER_IN", "IN_REGION"])
    g = g.replace(nodes=None)
    return A.edge_betweenness_centrality(g, "share").withColumn("share", F.round("share", 12))


@query(f"""WITH b AS (SELECT *, sum(k + 1) OVER (PARTITION BY r) + 1 AS s FROM {STARS}), v AS (SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) AS n)
  SELECT 'n:' || b.n AS id, round(((s - 1) * (s - 2) / 2 - (s - k - 1) * (s - k - 2) / 2) * 2 / ((v.n - 1) * (v.n - 2))::DOUBLE, 12) AS share FROM b, v
  UNION ALL SELECT 'r:' || r, round((any_value((s - 1) * (s - 2) / 2) - sum((k + 1) * k / 2)) * 2 / any_value((v.n - 1) * (v.n - 2))::DOUBLE, 12) FROM b, v GROUP BY r""")
def betweenness(spark, d):
    g = commerce(spark, d, ["Supplier", "Nation", "Region"], ["SUPPLIER_IN", "IN_REGION"]).replace(nodes=None)
    return A.betweenness_centrality(g, "share").filter("id NOT LIKE 's:%'").withColumn("share", F.round("share", 12))


@query(f"WITH b AS (SELECT * FROM {STARS}) SELECT 'r:0' AS src, 'n:' || n AS dst FROM b WHERE r = 0 UNION ALL SELECT 'n:' || n, 's:' || s_suppkey FROM b JOIN supplier ON s_nationkey = n WHERE r = 0")
def bfs_tree(spark, d):
    return A.bfs_edges(commerce(spark, d, ["Supplier", "Nation", "Region"], ["SUPPLIER_IN", "IN_REGION"]), "r:0", directed=False)


NEAR = """WITH e AS (SELECT 's:' || s_suppkey AS a, 'n:' || s_nationkey AS b FROM supplier UNION SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d AS (SELECT a, count(*) AS n FROM u GROUP BY 1)
  SELECT x.a AS src, y.a AS dst, round({0}, 12) AS {1} FROM u x JOIN u y ON x.b = y.b AND x.a < y.a JOIN d dx ON dx.a = x.a JOIN d dy ON dy.a = y.a GROUP BY 1, 2"""


@query(NEAR.format("count(*)::DOUBLE / least(any_value(dx.n), any_value(dy.n))", "overlap_coeff"))
def overlap_suppliers(spark, d):
    return A.overlap(commerce(spark, d, ["Supplier", "Nation", "Region"], ["SUPPLIER_IN", "IN_REGION"]), digits=12)


@query(NEAR.format("2 * count(*)::DOUBLE / (any_value(dx.n) + any_value(dy.n))", "sorensen_coeff"))
def sorensen_suppliers(spark, d):
    return A.sorensen(commerce(spark, d, ["Supplier", "Nation", "Region"], ["SUPPLIER_IN", "IN_REGION"]), digits=12)


@query("SELECT 's:' || a.s_suppkey AS src, 's:' || b.s_suppkey AS dst, 1::BIGINT AS bibcoupling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND 's:' || a.s_suppkey < 's:' || b.s_suppkey")
def bibcoupled(spark, d):
    return A.bibcoupling(commerce(spark, d, ["Supplier", "Nation"], ["SUPPLIER_IN"]))


@query("SELECT 'r:0' AS id UNION ALL SELECT 'n:' || n_nationkey FROM nation WHERE n_regionkey = 0")
def ego(spark, d):
    return A.ego_graph(_nations(spark, d), "r:0", 1).nodes.select("id")


@query("SELECT 'n:' || n_nationkey AS id, round(((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1)::DOUBLE / ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) - 1), 12) AS share FROM nation")
def degree_shares(spark, d):
    g = commerce(spark, d, ["Supplier", "Nation", "Region"], ["SUPPLIER_IN", "IN_REGION"])
    return A.degree_centrality(g, "share").filter("id LIKE 'n:%'").withColumn("share", F.round("share", 12))


@query("SELECT 'IN_REGION:' || n_nationkey AS eid, CASE WHEN n_name LIKE '%1%' AND n_regionkey % 2 = 1 THEN 2.0 ELSE 0.3 END::DOUBLE AS weight FROM nation")
def modularity_weights(spark, d):
    g = commerce(spark, d, ["Nation", "Region"], ["IN_REGION"])
    group = F.when(F.col("label") == "Region", F.col("key") % 2).otherwise(F.when(F.col("name").contains("1"), 1).otherwise(2))
    return T.modularity_weighted_layout(g.replace(nodes=g.nodes.withColumn("g", group)), "g").edges.select("eid", "weight")


@query("SELECT DISTINCT 'who::' || user_id AS \"nodeID\", 'who' AS type FROM events UNION SELECT 'who::' || event_type, 'who' FROM events UNION SELECT event_id::VARCHAR, 'EventID' FROM events")
def hypergraph_categories(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    out = T.hypergraph_of(Graph(edges=e), event_id="event_id", opts={"CATEGORIES": {"who": ["user_id", "event_type"]}})
    return out.nodes.select("nodeID", "type").distinct()


@query("SELECT 'n:' || n_nationkey AS id, round(6378137.0::DOUBLE * radians(n_nationkey * 5), 3) AS x, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(n_nationkey - 10) / 2)), 3) + 0.0 AS y FROM nation")
def mercator(spark, d):
    g = commerce(spark, d, ["Nation"], ["IN_REGION"])
    g = g.replace(nodes=g.nodes.withColumns({"latitude": F.col("key") - 10, "longitude": F.col("key") * 5}))
    return T.mercator_layout(g).nodes.select("id", F.round("x", 3).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t),
  l AS (SELECT conv_id || ':' || turn AS id, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level FROM s)
  SELECT id, ((row_number() OVER (PARTITION BY level ORDER BY id) - 1) * 100.0)::DOUBLE AS x, (0 - level * 100.0)::DOUBLE AS y FROM l""")
def tree(spark, d):
    return T.tree_layout(turns(spark, d)).nodes.select("id", "x", (F.col("y") + 0.0).alias("y"))


@query(WALK + "SELECT conv_id || ':' || turn AS id, (2 * turn)::DOUBLE AS distance FROM r WHERE conv_id = (SELECT min(conv_id) FROM conversations WHERE turn = 0)")
def sssp_turns(spark, d):
    g = turns(spark, d)
    first = g.nodes.filter("turn = 0").agg(F.min("conv_id")).first()[0]
    return A.sssp(g.replace(edges=g.edges.withColumn("w", F.lit(2.0))), f"{first}:0", "w")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR o_orderstatus ILIKE '%urgent%'")
def search_edges(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return Graph(edges=e, src="o_custkey", dst="o_orderkey").search_edges("urgent", columns=["o_orderpriority", "o_orderstatus"]).edges.select(F.col("o_orderkey").alias("k"))


@query("SELECT 'n:' || n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::INT AS degree_in FROM nation WHERE n_nationkey >= 10")
def call_filters(spark, d):
    g = commerce(spark, d, ["Customer", "Nation"], ["CUSTOMER_IN"])
    out = g.chain([O.call("get_indegrees", {}), O.call("filter_nodes_by_dict", {"filter_dict": {"label": "Nation", "key": P.ge(10)}})])
    return out.nodes.select("id", "degree_in")


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def parameters(spark, d):
    return commerce(spark, d, ["Customer"], ["CUSTOMER_IN"]).query("MATCH (c:Customer) WHERE c.acctbal > $low AND c.segment IN $segments RETURN c.key AS k", {"low": 5000, "segments": ["BUILDING", "MACHINERY"]})


text_query(
    "language_suite", ["Nation", "Region"], ["IN_REGION"],
    "MATCH (n:Nation)-[e]->(r) RETURN n.key AS k, 3 < n.key < 9 AS c, CASE WHEN n.key > 5 THEN null ELSE n.key END IS NULL AS z, 0x1F + n.key AS h, size([1, 2, 3, 4][1..3]) + size([1, 2][..-1]) AS s, toInteger('7') AS t, type(e) AS y, toInteger('x') IS NULL AS u, n = n AS same, [n.key, 1] = [n.key, 1] AS l",
    "SELECT n_nationkey::BIGINT AS k, n_nationkey > 3 AND n_nationkey < 9 AS c, n_nationkey > 5 AS z, (31 + n_nationkey)::BIGINT AS h, 3::BIGINT AS s, 7::BIGINT AS t, 'IN_REGION' AS y, true AS u, true AS same, true AS l FROM nation",
)


@query()
def louvain(spark, d):
    return A.louvain(_ring(spark, d))



def entry(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["commerce_segments"](spark, folder)
