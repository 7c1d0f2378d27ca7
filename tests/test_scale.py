"""Plans that keep rows off the driver and out of one task, and the rows they give."""

import random

from graphloom import catalogue
from graphloom.operators import filters, joins
from graphloom.plans import graph
from graphloom.session import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_opened_rows_are_not_broadcast(spark, monkeypatch):
    """Names are opened into their parts; only a vocabulary counted to be small is sent out."""
    names = table(spark, SF, "part").select("p_partkey", "p_name")
    words = spark.createDataFrame([("RED",), ("o",), ("ring",)], "word string")
    rows = []
    for join in (joins.substring_join, joins.suffix_join):
        by = (" ",) if join is joins.suffix_join else ()
        for small in (20_000, 0):
            monkeypatch.setattr(joins, "SMALL", small, raising=False)
            df = join(names, words, "p_name", "word", *by)
            assert "BuildLeft" not in plan(df)
            assert ("BroadcastHashJoin" in plan(df)) == (small > 0)
            rows.append(sorted((r.p_partkey, r.word) for r in df.collect()))
    assert rows[0] and rows[0] == rows[1] and rows[2] and rows[2] == rows[3]


def test_names_are_looked_up_once(spark):
    """Many requests of a name that many symbols have are answered from its count; lists are made where they are asked for."""
    s = [(f"s{i}", "same", f"a.same.{i}", "f" if i % 2 else None) for i in range(4)] + [("t", "one", "one", "g"), ("t", "one", "b.one", "g")]
    r = [("q0", "same", None), ("q1", "same", "f"), ("q2", "a.same.2", None), ("q3", "a.same.2", "f"), ("q4", "one", None), ("q5", "one", "g"), ("q6", None, None), ("q7", "none", None)]
    symbols, requests = spark.createDataFrame(s, "id string, name string, qualified_name string, file_path string"), spark.createDataFrame(r, "request string, name string, file string")
    got = {x.request: (x.status, x.id, x.candidates) for x in filters.symbol_lookup(requests, symbols).collect()}
    every = [f"s{i}" for i in range(4)]
    assert got == {
        "q0": ("ambiguous", None, every), "q1": ("ambiguous", None, ["s1", "s3"]), "q2": ("found", "s2", ["s2"]), "q3": ("not-found", None, []),
        "q4": ("found", "t", ["t"]), "q5": ("found", "t", ["t"]), "q6": ("not-found", None, []), "q7": ("not-found", None, []),
    }
    p = plan(catalogue.QUERIES["symbol_lookup"](spark, SF))
    assert "collect_" not in p  # no list for each request
    assert p.index("Join") < p.index("Aggregate")  # symbols are summed up below the join, not pairs above it


def test_rules_are_evaluated_once(spark):
    """No filter is inferred that evaluates all rules a second time."""
    for name in ("pattern_signals", "design_signals"):
        assert "size(filter(array(CASE" not in plan(catalogue.QUERIES[name](spark, SF))


def test_parts_are_dealt_before_the_rules(spark):
    """Bare keys fit into one task, their rules don't; detections of a part then need no second exchange."""
    for name in ("detected_patterns", "detected_designs"):
        df = catalogue.QUERIES[name](spark, SF)
        p = df._jdf.queryExecution().executedPlan().toString()
        assert p.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in p


def test_levels_of_any_graph(spark):
    """Chains, branches, cycles and what hangs on them, against plain Python; a chain takes few rounds."""
    rng, edges = random.Random(5), []
    for g in range(12):
        n = 30
        for i in range(1, n):
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                edges.append((f"{g}.{i}", f"{g}.{rng.randrange(max(0, i - 4), i)}"))
    edges += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("on1", "c1"), ("on2", "on1"), ("both", "on2"), ("both", "0.7"), ("above", "both"), ("self", "self"), ("twice", "0.3"), ("twice", "0.3")]
    edges += [("k1", "k2"), ("k2", "k1"), ("k2", "0.1"), ("p", "k1"), ("open", None)]
    deps = {}
    for a, b in edges:
        deps.setdefault(a, set()).add(b)
    want = {b: 0 for _, b in edges if b not in deps and b is not None}
    while new := {a: 1 + max(want[b] for b in bs) for a, bs in deps.items() if a not in want and all(b in want for b in bs)}:
        want |= new
    got = [(r.id, r.level) for r in graph.dependency_levels(spark.createDataFrame(edges, "from_id string, to_id string")).collect() if r.id is not None]
    assert len(got) == len(want) and dict(got) == want


def test_chains_take_few_rounds(spark, monkeypatch):
    laid = []
    monkeypatch.setattr(graph, "checkpoint", lambda df, f=graph.checkpoint: laid.append(1) or f(df))
    chain = spark.range(1, 301).selectExpr("cast(id as string) AS from_id", "cast(id - 1 as string) AS to_id")
    assert {int(r.id): r.level for r in graph.dependency_levels(chain).collect()} == {i: i for i in range(301)}
    assert len(laid) < 20


def test_orders_share_one_exchange(spark):
    df = catalogue.QUERIES["numbered_results"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") == 1 and "REPARTITION_BY_NUM" in p


def test_kinds_do_not_deal_the_candidates(spark):
    """A few kinds as keys of an exchange would put all candidates into as many tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        p = catalogue.QUERIES["call_site_alignment"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(kind" not in p
