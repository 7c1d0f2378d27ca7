import re
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.llm import mixing, queries
from tests.llm.cases import SF, documents, frame


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    """Share by weight; cut what is above its cap; share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(rows, near):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= near(s), (s, taken[s], target[s])


def test_targets_and_shares(spark):
    d = documents(spark)
    rows = queries.op7_source_mix(spark, SF).collect()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: size(r.text) for r in d.collect()}
    largest = defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    check(rows, lambda s: largest[s])
    again = queries.op7_source_mix(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_many_blocks_of_one_source(spark):
    """A hot source is many blocks and several rounds; the miss is the part of one short document."""
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 50 + 1).cast("int")), " ").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise(F.lit(None)).alias("source"))
    p = mixing.plan(d).select("doc_id", "size", "source", "target", (F.col("copies") * F.col("size")).alias("taken")).collect()
    assert len(p) == 3000
    check(p, lambda s: 50)


def test_expectation_is_kept(spark):
    """Over many seeds a document is taken as often as its source's share says."""
    d = spark.range(40).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int")), " ").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got, n = defaultdict(int), 4
    for seed in range(n):
        for r in mixing.plan(d, seed=100 + seed).collect():
            got[r.source] += r.copies * r.size
            target = r.target
    assert abs(got["b"] / n - target) < 3 or abs(got["a"] / n - target) < 3


def test_reruns_agree_however_rows_lie(spark):
    """Other partitions, other orders of summation: the same copies."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") * F.col("id") % 97 + 1).cast("int")), " ").alias("text"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    runs = [sorted((r.doc_id, r.copies) for r in mixing.plan(x).collect()) for x in (d, d.repartition(5, F.rand(3)), d.orderBy(F.desc("doc_id")).repartition(23))]
    assert runs[0] == runs[1] == runs[2]


def test_repeated_rows(spark):
    """Many rows of one id (or none) and one text are taken as often in all as the plan says, each at most twice."""
    d = spark.range(900).select(F.when(F.col("id") < 300, None).when(F.col("id") < 500, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 500, "one two three").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), "id")
    p = mixing.plan(d).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()
    m = mixing.mix(d).groupBy("doc_id", "source", "id").count().collect()
    got = defaultdict(int)
    for r in m:
        got[r.doc_id, r.source] += r["count"]
        assert r["count"] <= 2
    assert got == {(r.doc_id, r.source): r.n for r in p if r.n}


def test_awkward_rows(spark):
    d = frame(spark)
    p = mixing.plan(d)
    rows = p.collect()
    assert len(rows) == d.count() and all(r.copies == 0 for r in rows if r.size == 0)
    m = mixing.mix(d)
    assert m.columns == d.columns
    assert m.count() == sum(r.copies for r in rows)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.plan(d.limit(0)).count() == 0
