"""Graphs: impact, adjacency, deduplication, resolution, closure, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import joins, ordered, sets
from graphloom.plans import graph
from graphloom.session import table
from graphloom.sources import sinks

_id = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def key_edges(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys as edges: orders to customers to nations to regions."""
    o = table(spark, d, "orders").select(_id("orders", "o_orderkey").alias("from_id"), _id("customer", "o_custkey").alias("to_id"), F.lit("placed_by").alias("relation"))
    c = table(spark, d, "customer").select(_id("customer", "c_custkey").alias("from_id"), _id("nation", "c_nationkey").alias("to_id"), F.lit("lives_in").alias("relation"))
    n = table(spark, d, "nation").select(_id("nation", "n_nationkey").alias("from_id"), _id("region", "n_regionkey").alias("to_id"), F.lit("part_of").alias("relation"))
    return o.unionByName(c).unionByName(n)


EDGES = """edges AS (
  SELECT 'orders:' || o_orderkey AS from_id, 'customer:' || o_custkey AS to_id, 'placed_by' AS relation FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in' FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of' FROM nation)"""
_kind = lambda: F.split("id", ":")[0].alias("kind")


def _target(spark: SparkSession, id_: str) -> DataFrame:
    return spark.createDataFrame([(id_,)], "id string")


def impact_region_incoming(spark: SparkSession, d: str) -> DataFrame:
    r = graph.traverse(key_edges(spark, d), _target(spark, "region:0"), "incoming", 3)
    return r.select("id", _kind(), F.col("distance").cast("int"), "relation")


def impact_capped(spark: SparkSession, d: str) -> DataFrame:
    """The feature's own cap on nodes: the nearest 200, by id within a level."""
    r = graph.traverse(key_edges(spark, d), _target(spark, "region:1"), "incoming", 3, most=200)
    return r.select("id", F.col("distance").cast("int"))


def impact_both_summary(spark: SparkSession, d: str) -> DataFrame:
    r = graph.impact(key_edges(spark, d), _target(spark, "nation:3"), 3, None)
    return r.groupBy("direction", _kind()).agg(F.count("*").alias("nodes"), F.max("distance").cast("int").alias("farthest"))


def impact_paths(spark: SparkSession, d: str) -> DataFrame:
    r = graph.traverse(key_edges(spark, d), _target(spark, "region:2"), "incoming", 3)
    s = graph.steps(r, 3)
    return s.select("id", F.array_join(F.transform("steps", lambda x: F.concat_ws("<-", x["from_id"], x["to_id"])), " ").alias("path"))


def edge_dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.select(F.col("o_custkey").alias("from_id"), F.col("l_partkey").alias("to_id"), "o_orderdate", "o_orderkey", "l_linenumber", F.concat_ws("/", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence"))
    return sets.last_wins(e, ["from_id", "to_id"], ["o_orderdate", "o_orderkey", "l_linenumber"], ["evidence"])


def call_graph_adjacency(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    n = ordered.following(ev, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "event_type", "callee")
    n = n.where("callee is not null").groupBy(F.col("event_type").alias("caller"), "callee").agg(F.count("*").alias("n"))
    return n.groupBy("caller").agg(F.count("*").alias("callees"), F.sum("n").alias("calls"), F.array_join(F.array_sort(F.collect_list("callee")), ",").alias("callee_list"))


def prune_internal(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def external_fallback(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), _id("nation", "n_nationkey").alias("n_id"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return joins.resolved(s, [(n, "s_nationkey", "n_id")], F.col("s_nationkey").cast("string"), "nation_id")


def def_use_two_step(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), F.concat_ws("::", "o_orderpriority", "o_orderstatus").alias("scoped"))
    by_symbol = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("symbol"), _id("customer", "c_custkey").alias("s_id"))
    by_name = table(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy(F.concat_ws("::", "o_orderpriority", "o_orderstatus").alias("scoped")).agg(F.min("o_orderkey").alias("k")).select("scoped", _id("orders", "k").alias("n_id"))
    return joins.resolved(o, [(by_symbol, "symbol", "s_id"), (by_name, "scoped", "n_id")], F.col("scoped"), "bound").select("o_orderkey", "bound")


def suffix_name_join(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("ring",), ("widget",), ("small ring",), ("hot gear",), ("mall ring",)], "word string")
    return joins.suffix_join(table(spark, d, "part").select("p_partkey", "p_name"), v, "p_name", "word", " ").select("p_partkey", "word")


def substring_name_join(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("RED",), ("Widget",), ("o",), ("t g",)], "word string")
    return joins.substring_join(table(spark, d, "part").select("p_partkey", "p_name"), v, "p_name", "word").select("p_partkey", "word")


def dependency_order(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_levels(key_edges(spark, d)).select("id", F.col("level").cast("int"))


def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    c = graph.closure(key_edges(spark, d))
    return c.groupBy("to_id").agg(F.count("*").alias("dependents"), F.max("distance").cast("int").alias("farthest"))


def evidence_traversal(spark: SparkSession, d: str) -> DataFrame:
    """Edges within two steps out of every nation, counted by relation; the cap is beyond what any start reaches."""
    n = table(spark, d, "nation").select(_id("nation", "n_nationkey").alias("start"), _id("nation", "n_nationkey").alias("id"))
    back = key_edges(spark, d).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "relation")
    e = graph.evidence(back, n, 2, 2**31 - 1, False)
    return e.groupBy("start", "relation", F.col("distance").cast("int").alias("distance")).agg(F.count("*").alias("n"))


def unknown_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Nations of three regions are known nodes; ends of edges that are not become external or unknown nodes."""
    n = table(spark, d, "nation")
    nodes = n.where("n_regionkey < 3").select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("kind"))
    e = n.select(_id("nation", "n_nationkey").alias("from_id"), F.concat(F.lit("external:"), F.col("n_regionkey").cast("string")).alias("to_id"))
    return graph.with_endpoints(nodes, e)


def cypher_export(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nodes = n.select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(r.select(_id("region", "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    e = n.select(_id("nation", "n_nationkey").alias("from_id"), _id("region", "n_regionkey").alias("to_id"))
    return sinks.cypher(nodes, e, "Place", "PART_OF")


_f = [impact_region_incoming, impact_capped, impact_both_summary, impact_paths, edge_dedupe_last_wins, call_graph_adjacency, prune_internal, external_fallback, def_use_two_step, suffix_name_join, substring_name_join, dependency_order, dependency_closure, evidence_traversal, unknown_endpoints, cypher_export]
QUERIES = {f.__name__: f for f in _f}

ORACLE_SQL = {
    "impact_region_incoming": f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'region:0' AS id, 0 AS distance, '' AS relation
        UNION ALL SELECT e.from_id, r.distance + 1, e.relation FROM r JOIN edges e ON e.to_id = r.id WHERE r.distance < 3)
        SELECT id, split_part(id, ':', 1) AS kind, CAST(min(distance) AS INTEGER) AS distance, min(relation) AS relation FROM r WHERE distance > 0 GROUP BY id""",
    "impact_capped": f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'region:1' AS id, 0 AS distance
        UNION ALL SELECT e.from_id, r.distance + 1 FROM r JOIN edges e ON e.to_id = r.id WHERE r.distance < 3)
        SELECT id, CAST(distance AS INTEGER) AS distance FROM r WHERE distance > 0 ORDER BY distance, id LIMIT 200""",
    "impact_both_summary": f"""WITH RECURSIVE {EDGES}, i AS (SELECT 'nation:3' AS id, 0 AS distance
        UNION ALL SELECT e.from_id, i.distance + 1 FROM i JOIN edges e ON e.to_id = i.id WHERE i.distance < 3),
        o AS (SELECT 'nation:3' AS id, 0 AS distance
        UNION ALL SELECT e.to_id, o.distance + 1 FROM o JOIN edges e ON e.from_id = o.id WHERE o.distance < 3),
        a AS (SELECT 'incoming' AS direction, * FROM i UNION ALL SELECT 'outgoing', * FROM o)
        SELECT direction, split_part(id, ':', 1) AS kind, count(DISTINCT id) AS nodes, CAST(max(distance) AS INTEGER) AS farthest FROM a WHERE distance > 0 GROUP BY ALL""",
    "impact_paths": f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'region:2' AS id, 0 AS distance, '' AS path
        UNION ALL SELECT e.from_id, r.distance + 1, r.path || CASE WHEN r.path = '' THEN '' ELSE ' ' END || r.id || '<-' || e.from_id FROM r JOIN edges e ON e.to_id = r.id WHERE r.distance < 3)
        SELECT id, path FROM r WHERE distance > 0""",
    "edge_dedupe_last_wins": """SELECT from_id, to_id, evidence FROM (
        SELECT o_custkey AS from_id, l_partkey AS to_id, o_orderkey || '/' || l_linenumber AS evidence,
          row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber DESC) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE n = 1""",
    "call_graph_adjacency": """WITH n AS (SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events),
        c AS (SELECT caller, callee, count(*) AS n FROM n WHERE callee IS NOT NULL GROUP BY ALL)
        SELECT caller, count(*) AS callees, CAST(sum(n) AS BIGINT) AS calls, string_agg(callee, ',' ORDER BY callee) AS callee_list FROM c GROUP BY caller""",
    "prune_internal": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)",
    "external_fallback": """SELECT s_suppkey, s_nationkey, coalesce('nation:' || n_nationkey, 'external:' || s_nationkey) AS nation_id
        FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""",
    "def_use_two_step": """WITH d AS (SELECT o_orderpriority || '::' || o_orderstatus AS scoped, min(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
        o AS (SELECT *, o_orderpriority || '::' || o_orderstatus AS scoped FROM orders)
        SELECT o_orderkey, coalesce('customer:' || c_custkey, 'orders:' || k, 'external:' || o.scoped) AS bound
        FROM o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = o_custkey LEFT JOIN d ON d.scoped = o.scoped""",
    "suffix_name_join": """SELECT p_partkey, word FROM part, (VALUES ('ring'), ('widget'), ('small ring'), ('hot gear'), ('mall ring')) v(word)
        WHERE p_name = word OR p_name LIKE '% ' || word""",
    "substring_name_join": "SELECT p_partkey, word FROM part, (VALUES ('RED'), ('Widget'), ('o'), ('t g')) v(word) WHERE contains(lower(p_name), lower(word))",
    "dependency_order": f"""WITH RECURSIVE {EDGES}, r AS (SELECT DISTINCT to_id AS id, 0 AS level FROM edges WHERE to_id NOT IN (SELECT from_id FROM edges)
        UNION SELECT e.from_id, r.level + 1 FROM r JOIN edges e ON e.to_id = r.id) SELECT id, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY id""",
    "dependency_closure": f"""WITH RECURSIVE {EDGES}, r AS (SELECT from_id, to_id, 1 AS distance FROM edges
        UNION SELECT r.from_id, e.to_id, r.distance + 1 FROM r JOIN edges e ON e.from_id = r.to_id)
        SELECT to_id, count(DISTINCT from_id) AS dependents, CAST(max(distance) AS INTEGER) AS farthest FROM r GROUP BY to_id""",
    "evidence_traversal": f"""WITH {EDGES}, one AS (SELECT to_id AS start, from_id, relation FROM edges WHERE to_id LIKE 'nation:%' AND split_part(to_id, ':', 2) IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)),
        two AS (SELECT start, e.relation FROM one JOIN edges e ON e.to_id = one.from_id)
        SELECT start, relation, 1 AS distance, count(*) AS n FROM one GROUP BY ALL UNION ALL SELECT start, relation, 2, count(*) FROM two GROUP BY ALL""",
    "unknown_endpoints": """SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN n_name ELSE 'nation:' || n_nationkey END AS name, CASE WHEN n_regionkey < 3 THEN 'Nation' ELSE 'Unknown' END AS kind FROM nation
        UNION ALL SELECT DISTINCT 'external:' || n_regionkey, CAST(n_regionkey AS VARCHAR), 'External' FROM nation""",
    "cypher_export": """SELECT CAST(0 AS INTEGER) AS seq, 'CREATE CONSTRAINT IF NOT EXISTS FOR (n:Place) REQUIRE n.id IS UNIQUE;' AS statement
        UNION ALL SELECT 1, 'MERGE (n:Place {id: "nation:' || n_nationkey || '"}) SET n.name = "' || n_name || '";' FROM nation
        UNION ALL SELECT 1, 'MERGE (n:Place {id: "region:' || r_regionkey || '"}) SET n.name = "' || r_name || '";' FROM region
        UNION ALL SELECT 2, 'MATCH (a:Place {id: "nation:' || n_nationkey || '"}), (b:Place {id: "region:' || n_regionkey || '"}) MERGE (a)-[:PART_OF]->(b);' FROM nation""",
}
