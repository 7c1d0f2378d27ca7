"""Ranges, sets, scores, sampling and document transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import intervals, sets
from graphloom.plans import graph, scoring, specs
from graphloom.session import table

_DAY = "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))"
_BANDS = [("all", 0, 1000000), ("low", 0, 100000), ("lower", 0, 50000), ("mid", 100000, 300000), ("inner", 150000, 250000), ("core", 190000, 210000), ("high", 300000, 600000)]
_SQL_BANDS = "(VALUES " + ", ".join(map(str, _BANDS)) + ") b(name, lo, hi)"


def interval_innermost(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "name string, lo long, hi long").withColumn("k", F.lit(1))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("k"))
    return intervals.innermost(o, bands, ["k"], "o_orderkey", "o_totalprice", "lo", "hi", 50_000, ["name"]).select("o_orderkey", F.col("name").alias("band"))


def interval_maximal(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    o = table(spark, d, "orders").select("o_custkey", day.alias("start_day"), (day + 1 + F.col("o_orderkey") % 60).cast("int").alias("end_day"))
    return intervals.maximal(o, ["o_custkey"], "start_day", "end_day")


def coalesce_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = table(spark, d, "events").select("user_id", s.alias("start_s"), (s + 7200).alias("end_s"))
    return intervals.coalesced(e, ["user_id"], "start_s", "end_s", width=86_400)


def edit_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 20).cast("long").alias("start_off"), (F.col("l_linenumber") * 20 + F.col("l_quantity")).cast("long").alias("end_off"))
    return intervals.conflicts(e, ["l_orderkey"], "start_off", "end_off")


def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """Every part name with its first word deleted and a mark inserted at the end."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    cut = F.instr("p_name", " ")
    e = p.select("p_partkey", F.lit(0).alias("start"), cut.alias("end"), F.lit("").alias("replacement")).unionByName(p.select("p_partkey", F.length("p_name").alias("start"), F.length("p_name").alias("end"), F.lit("!").alias("replacement")))
    return intervals.apply_edits(p, e, "p_partkey", "p_name")


def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("quantity"), "l_discount")
    a, b = li.where("l_discount < 0.05").drop("l_discount"), li.where("l_discount >= 0.05").drop("l_discount")
    return sets.multiset_difference(a, b, ["l_returnflag", "l_linestatus", "quantity"])


def keep_max_dedupe(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sets.keep_best(li, ["l_orderkey"], "l_extendedprice", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey", "l_extendedprice"])


def _customer_signals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").join(o, "c_custkey", "left").na.fill(0, ["n", "urgent"])
    return scoring.signals(c, ["c_custkey"], [
        ("segment.name_suffix", "local", "weak", F.col("c_mktsegment") == "BUILDING", 1.5),
        ("balance.large", "type", "strong", F.col("c_acctbal") > 5000, 2.5),
        ("balance.some", "type", "medium", F.col("c_acctbal") > 1000, 1.0),
        ("orders.many", "graph", "medium", F.col("n") > 0, F.col("n") * 0.5),
        ("orders.urgent", "call", "medium", F.col("urgent") > 0, F.col("urgent") * 0.5),
        ("balance.negative", "penalty", "weak", F.col("c_acctbal") < 0, 1.5),
    ])


_SCORE_SQL = """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY ALL),
    p AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5::DOUBLE ELSE 0 END AS loc,
      CASE WHEN c_acctbal > 5000 THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN c_acctbal > 1000 THEN 1::DOUBLE ELSE 0 END AS typ,
      least(5::DOUBLE, coalesce(n, 0) * 0.5::DOUBLE) AS g, least(4::DOUBLE, coalesce(urgent, 0) * 0.5::DOUBLE) AS c,
      CASE WHEN c_acctbal < 0 THEN 1.5::DOUBLE ELSE 0 END AS pen, c_acctbal > 5000 AS strong FROM customer LEFT JOIN o ON o_custkey = c_custkey),
    s AS (SELECT *, loc + typ + g + c - pen AS raw FROM p WHERE loc + typ + g + c + pen > 0),"""


def score_caps(spark: SparkSession, d: str) -> DataFrame:
    return scoring.finish_additional(_customer_signals(spark, d), ["c_custkey"]).select("c_custkey", "score", "confidence", "detected")


def score_architecture(spark: SparkSession, d: str) -> DataFrame:
    return scoring.finish_architecture(_customer_signals(spark, d), ["c_custkey"]).select("c_custkey", "score", "confidence", "detected")


_RELATED = [("click", "purchase"), ("view", "click"), ("signup", "view"), ("error", "signup")]


def pattern_intersections(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value > 150").select("user_id", "event_type")
    return scoring.intersections(e, ["user_id"], "event_type", spark.createDataFrame(_RELATED, "a string, b string")).select("user_id", "a", "b")


def group_detections(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws("-", F.col("l_returnflag"), F.col("l_linenumber").cast("string")).alias("pattern"), F.col("l_quantity").alias("score"))
    level = scoring.mode(F.when(F.col("score") >= 40, "high").when(F.col("score") >= 20, "medium").otherwise("low"))
    g = scoring.by_node(li.withColumn("mode", level), ["l_orderkey"])
    return g.select("l_orderkey", "n", F.array_join("patterns", ",").alias("patterns"))


def skip_histogram(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    reason = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") > 400000, "too_large").when(F.col("o_orderpriority").startswith("5"), "low_priority").otherwise("accepted")
    return o.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def fair_sample(spark: SparkSession, d: str) -> DataFrame:
    """The feature's own cap: 60 items in all, from queues of unequal order."""
    e = table(spark, d, "events").select("event_type", "user_id", "ts", "event_id")
    return sets.fair_sample(e, "event_type", ["user_id", "ts", "event_id"], ["event_id"], 60).select("event_type", "event_id", F.col("round").cast("long"))


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("order"), "l_partkey", F.col("l_quantity").cast("long").alias("quantity"), specs.cents(F.col("l_extendedprice")).alias("gross"), specs.cents(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"))


def summarize_orders(spark: SparkSession, d: str) -> DataFrame:
    return specs.summarize(_order_lines(spark, d), ["custkey"])


def summarize_orders_by_category(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    return specs.summarize(_order_lines(spark, d).join(p, "l_partkey"), ["custkey", "category"]).select("custkey", "category", "net", "item_count")


_KINDS = ["signup", "error", "click", "view", "purchase"]


def pivot_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type", specs.cents(F.col("value")).alias("value"))
    return specs.pivoted(e, ["day", "user_id"], "event_type", "value", _KINDS)


def rollup_inventory(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    m = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), q.alias("q"))
    return specs.balances(m, ["l_partkey", "l_suppkey"], "day", "q")


def denormalize(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.max("l_shipdate").alias("last"))
    x = o.join(li, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_shipped"))
    return c.join(x, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), "last_shipped")


def reconcile_ledgers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("key"), specs.cents(F.col("o_totalprice")).alias("amount"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(specs.cents(F.col("l_extendedprice"))).alias("amount"))
    return specs.reconciled(a, b, "key", "amount", 5_000_000)


def org_tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, k, id_, parent, v: df.select(F.concat(F.lit(f"{k}:"), F.col(id_).cast("string")).alias("id"), parent.alias("parent"), v.alias("value"))
    up = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    zero = F.lit(0).cast("long")
    t = one(table(spark, d, "region"), "region", "r_regionkey", F.lit(None).cast("string"), zero)
    t = t.unionByName(one(table(spark, d, "nation"), "nation", "n_nationkey", up("region", "n_regionkey"), zero))
    t = t.unionByName(one(table(spark, d, "customer"), "customer", "c_custkey", up("nation", "c_nationkey"), specs.cents(F.col("c_acctbal"))))
    return graph.subtree_totals(t, "value")


def merge_profiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    seg = F.lower("c_mktsegment")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user"), F.lit(0).alias("rank"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("a"), F.col("c_custkey").cast("string"))).alias("mail"), F.array(F.lit("payer"), seg).alias("roles"))
    b = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("user"), F.lit(1).alias("rank"), F.when(F.col("c_custkey") % 7 == 0, F.lit("other")).otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("mail"), F.array(seg, F.lit("admin")).alias("roles"))
    m = specs.merged(a.unionByName(b), "user", "rank", ["name", "mail"], "roles")
    return m.select("user", "name", "mail", F.array_join("roles", ",").alias("roles"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), F.col("conflict_count").cast("int"))


_f = [interval_innermost, interval_maximal, coalesce_ranges, edit_overlap_check, apply_edits, multiset_diff, keep_max_dedupe, score_caps, score_architecture, pattern_intersections, group_detections, skip_histogram, fair_sample, summarize_orders, summarize_orders_by_category, pivot_events, rollup_inventory, denormalize, reconcile_ledgers, org_tree_rollup, merge_profiles]
QUERIES = {f.__name__: f for f in _f}

_CENTS = lambda x: f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"
_LINES = f"""l AS (SELECT o_custkey AS custkey, o_orderkey AS k, l_partkey, CAST(l_quantity AS BIGINT) AS quantity, {_CENTS("l_extendedprice")} AS gross, {_CENTS("l_extendedprice * l_discount")} AS discount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_SUM = lambda x: f"CAST(sum({x}) AS BIGINT)"

ORACLE_SQL = {
    "interval_innermost": f"""SELECT o_orderkey, name AS band FROM (SELECT o_orderkey, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY hi - lo, name) AS n
        FROM orders JOIN {_SQL_BANDS} ON o_totalprice >= lo AND o_totalprice < hi) WHERE n = 1""",
    "interval_maximal": f"""WITH r AS (SELECT DISTINCT o_custkey, CAST({_DAY} AS INTEGER) AS start_day, CAST({_DAY} + 1 + o_orderkey % 60 AS INTEGER) AS end_day FROM orders)
        SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.o_custkey = b.o_custkey AND b.start_day <= a.start_day AND a.end_day <= b.end_day AND (b.start_day < a.start_day OR a.end_day < b.end_day))""",
    "coalesce_ranges": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS t FROM events),
        m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT user_id, min(s) AS start_s, max(t) AS end_s, count(*) AS n FROM i GROUP BY user_id, island""",
    "edit_overlap_check": """SELECT * FROM (SELECT l_orderkey, CAST(l_linenumber * 20 AS BIGINT) AS start_off, CAST(l_linenumber * 20 + l_quantity AS BIGINT) AS end_off,
        lag(CAST(l_linenumber * 20 + l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 20, l_linenumber * 20 + l_quantity) AS previous_end FROM lineitem) WHERE start_off < previous_end""",
    "apply_edits": "SELECT p_partkey, substr(p_name, instr(p_name, ' ') + 1) || '!' AS p_name FROM part",
    "multiset_diff": """WITH l AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) AS quantity, l_discount FROM lineitem),
        e AS (SELECT l_returnflag, l_linestatus, quantity FROM l WHERE l_discount < 0.05 EXCEPT ALL SELECT l_returnflag, l_linestatus, quantity FROM l WHERE l_discount >= 0.05)
        SELECT *, count(*) AS n FROM e GROUP BY ALL""",
    "keep_max_dedupe": """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""",
    "score_caps": _SCORE_SQL + """ a AS (SELECT *, CASE WHEN loc + typ <= 0 AND (g > 0 OR c > 0) THEN least(raw, 3.9) ELSE raw END AS s1 FROM s),
        b AS (SELECT *, CASE WHEN loc > 0 AND typ + g + c = 0 THEN least(s1, 3.9) ELSE s1 END AS s2 FROM a),
        f AS (SELECT c_custkey, CAST(floor(greatest(CASE WHEN NOT strong AND s2 >= 7 THEN 6.9 ELSE s2 END, 0) * 10 + 0.5) AS DOUBLE) / 10 AS score FROM b)
        SELECT c_custkey, score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence, score >= 1 AS detected FROM f""",
    "score_architecture": _SCORE_SQL + """ a AS (SELECT *, CASE WHEN loc + typ < 2 AND raw >= 7 THEN 4 ELSE raw END AS s1 FROM s),
        b AS (SELECT *, CASE WHEN loc > 0 AND typ + g + c = 0 THEN least(s1, 3.75) ELSE s1 END AS s2 FROM a),
        f AS (SELECT c_custkey, CAST(floor(s2 * 100 + 0.5) AS DOUBLE) / 100 AS score FROM b)
        SELECT c_custkey, score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence, score >= 1 AS detected FROM f""",
    "pattern_intersections": f"""WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 150)
        SELECT x.user_id, a, b FROM (VALUES {", ".join(map(str, _RELATED))}) r(a, b) JOIN e x ON x.event_type = a JOIN e y ON y.event_type = b AND y.user_id = x.user_id""",
    "group_detections": """WITH l AS (SELECT l_orderkey, l_returnflag || '-' || l_linenumber AS pattern, l_quantity AS score, CASE WHEN l_quantity >= 40 THEN 'detected' WHEN l_quantity >= 20 THEN 'probable' ELSE 'weak' END AS mode FROM lineitem)
        SELECT l_orderkey, count(*) AS n, string_agg(pattern || '=' || mode, ',' ORDER BY score DESC, pattern, mode) AS patterns FROM l GROUP BY l_orderkey""",
    "skip_histogram": """SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 400000 THEN 'too_large' WHEN o_orderpriority LIKE '5%' THEN 'low_priority' ELSE 'accepted' END AS reason, count(*) AS n FROM orders GROUP BY ALL""",
    "fair_sample": """SELECT event_type, event_id, rn AS round FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id, ts, event_id) AS rn FROM events) ORDER BY rn, event_type LIMIT 60""",
    "summarize_orders": f"""WITH {_LINES} SELECT custkey, count(DISTINCT k) AS order_count, {_SUM("quantity")} AS item_count, {_SUM("gross")} AS gross, {_SUM("discount")} AS discounts, {_SUM("gross - discount")} AS net FROM l GROUP BY custkey""",
    "summarize_orders_by_category": f"""WITH {_LINES} SELECT custkey, p_type AS category, {_SUM("gross - discount")} AS net, {_SUM("quantity")} AS item_count FROM l JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "pivot_events": f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, {_CENTS("value")} AS v FROM events)
        SELECT day, user_id, {_SUM("v")} AS total_value, count(*) AS event_count, {", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}_count, coalesce(CAST(sum(v) FILTER (event_type = '{k}') AS BIGINT), 0) AS {k}_value" for k in _KINDS)} FROM e GROUP BY day, user_id""",
    "rollup_inventory": f"""WITH m AS (SELECT l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, {_SUM("CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END")} AS delta, count(*) AS movement_count FROM lineitem GROUP BY ALL)
        SELECT *, CAST(sum(delta) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY day) AS BIGINT) AS balance FROM m""",
    "denormalize": """WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY ALL),
        x AS (SELECT o_custkey, count(*) AS orders, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines, strftime(max(last), '%Y-%m-%d') AS last_shipped FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL)
        SELECT c_custkey, c_name, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, last_shipped FROM customer LEFT JOIN x ON o_custkey = c_custkey""",
    "reconcile_ledgers": f"""WITH a AS (SELECT o_orderkey AS key, {_CENTS("o_totalprice")} AS amount FROM orders WHERE o_orderkey % 13 <> 0),
        b AS (SELECT l_orderkey AS key, {_SUM(_CENTS("l_extendedprice"))} AS amount FROM lineitem GROUP BY ALL)
        SELECT coalesce(a.key, b.key) AS key, a.amount AS primary_amount, b.amount AS secondary_amount, a.amount - b.amount AS difference,
        CASE WHEN a.key IS NULL THEN 'missing_in_primary' WHEN b.key IS NULL THEN 'missing_in_secondary' WHEN abs(a.amount - b.amount) <= 5000000 THEN 'match' ELSE 'mismatch' END AS status FROM a FULL JOIN b ON a.key = b.key""",
    "org_tree_rollup": f"""WITH c AS (SELECT c_custkey, c_nationkey, {_CENTS("c_acctbal")} AS v FROM customer)
        SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS parent, 0::BIGINT AS direct, 0::BIGINT AS total, v AS value FROM c
        UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, count(c_custkey), count(c_custkey), CAST(coalesce(sum(v), 0) AS BIGINT) FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey
        UNION ALL SELECT 'region:' || r_regionkey, NULL, count(DISTINCT n_nationkey), count(DISTINCT n_nationkey) + count(c_custkey), CAST(coalesce(sum(v), 0) AS BIGINT) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY r_regionkey""",
    "merge_profiles": """WITH a AS (SELECT c_custkey AS u, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey END AS mail, lower(c_mktsegment) AS seg FROM customer WHERE c_custkey % 3 <> 0),
        b AS (SELECT c_custkey AS u, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE c_name END AS name, 'b' || c_custkey AS mail, lower(c_mktsegment) AS seg FROM customer WHERE c_custkey % 5 <> 0)
        SELECT coalesce(a.u, b.u) AS user, coalesce(a.name, b.name) AS name, coalesce(a.mail, b.mail) AS mail,
        CASE WHEN b.u IS NULL THEN 'payer,' || a.seg WHEN a.u IS NULL THEN b.seg || ',admin' ELSE 'payer,' || a.seg || ',admin' END AS roles,
        CASE WHEN b.u IS NULL THEN '0' WHEN a.u IS NULL THEN '1' ELSE '0,1' END AS sources,
        CAST(CASE WHEN a.u IS NULL OR b.u IS NULL THEN 0 ELSE (a.name <> b.name)::INT + coalesce((a.mail <> b.mail)::INT, 0) + 1 END AS INTEGER) AS conflict_count
        FROM a FULL JOIN b ON a.u = b.u""",
}
