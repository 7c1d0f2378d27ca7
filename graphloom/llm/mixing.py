"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and S words wants T / S copies of each of its documents.
The whole part is given to all; the fraction left is a probability that pivotal
rounding makes 0 or 1.  Two documents meet, a random amount of words moves from
one to the other until one of them is settled, and the other goes on.  The amount
is chosen so that no document's expectation changes, and as words (not
probabilities) move, the words a source takes stay at its target until its very
last document is settled by one draw.  A source's long documents go first; what
their last draw misses shifts the probabilities of the shorter ones, tier by tier,
so the end result is off by the part of one short document.

The pairs meet in a reduction tree: documents in hashed blocks of about `BLOCK`,
the one unsettled document of each block in blocks of the next level, and so on.
So a source of any size is many bounded blocks, and there are log(n) rounds.
Draws are hashes of document ids, so reruns agree.

Only DataFrame functions touch the rows.

Defined results: null and blank texts have size 0 and are never taken; a null
source is a source of its own and sorts last; repeated rows are documents of
their own; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, dealt, word_count

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix is to hold, and the most copies of a source.
SHARE, MOST = 1.5, 2
#: Sources whose table of a few numbers goes to every executor; more are joined by key.
MOST_SOURCES = 20_000
#: Documents of a block, on average.
BLOCK = 256
#: Shares of a source's documents, by size, at which the next tier begins.
TIERS = (0.8, 0.5)
EPS = 1e-12


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source (source, source_size, n, cuts): its target words.

    Targets share all words by weight, none above `most` times its source; what is
    too much is shared again by weight.  That is one level L with target =
    min(cap, L * weight): in order of cap / weight, the first source for which the
    rest over the weights left is no more than its own ratio fixes L (later sources
    give smaller values, so it is the largest of those).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.get(cyc, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", most * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = share * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(after))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(all_))
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w"))
    return s.select("source", "source_size", "n", "cuts", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(2**53)).cast("double") / float(2**53)


def _meet(i: Column, j: Column, seed: Column) -> Column:
    """(settled, copies of it, the other) of two documents with probabilities p and sizes s."""
    room = lambda x: (1 - x["p"]) * x["s"]
    mass = lambda x: x["p"] * x["s"]
    up, down = F.least(room(i), mass(j)), F.least(mass(i), room(j))
    rises = _uniform(seed, i["h"], j["h"]) * (up + down) < down
    at = lambda x, p: F.struct(x["id"].alias("id"), x["h"].alias("h"), x["o"].alias("o"), x["s"].alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))
    out = lambda x, c, rest: F.struct(F.struct(x["id"].alias("id"), x["h"].alias("h"), x["o"].alias("o"), x["s"].alias("s"), F.lit(c).alias("c")).alias("done"), rest.alias("rest"))
    return F.when(
        rises,
        F.when(room(i) <= mass(j), out(i, 1, at(j, j["p"] - room(i) / j["s"]))).otherwise(out(j, 0, at(i, i["p"] + mass(j) / i["s"]))),
    ).otherwise(
        F.when(mass(i) <= room(j), out(i, 0, at(j, j["p"] + mass(i) / j["s"]))).otherwise(out(j, 1, at(i, i["p"] - room(j) / i["s"])))
    )


_ITEM = "struct<id:bigint,h:bigint,o:int,s:double,p:double>"
_DONE = "array<struct<id:bigint,h:bigint,o:int,s:double,c:int>>"


def _round(blocks: DataFrame, level: int, seed: int) -> DataFrame:
    """Fold each block, largest documents first, into settled documents and one that goes on."""
    zero = F.struct(F.lit(None).cast(_ITEM).alias("rest"), F.array().cast(_DONE).alias("done"))

    def step(a: Column, x: Column) -> Column:
        m = _meet(a["rest"], x, F.lit(seed * 1000 + level))
        first = F.struct(x.cast(_ITEM).alias("rest"), a["done"].alias("done"))
        # met once: a one-element array binds the outcome to a name
        later = F.get(F.transform(F.array(m), lambda y: F.struct(y["rest"].cast(_ITEM).alias("rest"), F.concat(a["done"], F.array(y["done"])).cast(_DONE).alias("done"))), F.lit(0))
        return F.when(a["rest"].isNull(), first).otherwise(later)

    items = F.sort_array(F.collect_list(F.struct((-F.col("x.s")).alias("neg"), F.col("x.id").alias("id"), F.col("x.h").alias("h"), F.col("x.o").alias("o"), F.col("x.s").alias("s"), F.col("x.p").alias("p"))))
    items = F.transform(items, lambda y: F.struct(y["id"].alias("id"), y["h"].alias("h"), y["o"].alias("o"), y["s"].alias("s"), y["p"].alias("p")).cast(_ITEM))
    return blocks.groupBy("src", "b").agg(items.alias("items")).select("src", "b", F.aggregate("items", zero, step).alias("r"))


def _settle(level: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(src, id, h, o, s, c) of all documents of (src, b, x): the reduction tree, whose root is one draw."""
    done, k = [], 0
    while True:
        r = checkpoint(_round(level, k, seed))
        done.append(r.select("src", F.explode("r.done").alias("y")).select("src", "y.*"))
        level = r.where("r.rest is not null").select("src", F.floor(F.col("b") / BLOCK).alias("b"), F.col("r.rest").alias("x"))
        if blocks <= 1:
            break
        blocks, k = math.ceil(blocks / BLOCK), k + 1
    settled = level.select("src", "x.id", "x.h", "x.o", "x.s", (_uniform(F.lit(seed), F.col("x.h"), F.col("x.id")) < F.col("x.p")).cast("int").alias("c"))
    for y in done:
        settled = settled.unionByName(y)
    return settled


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, h, o, size, source, source_size, target, copies), one row per input row; h and o tell rows of one key apart."""
    d = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text), F.col(source)).alias("h"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"))
    d = d.withColumn("o", F.row_number().over(Window.partitionBy("id", "h").orderBy("size")).cast("int"))
    d = checkpoint(d)
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.percentile("size", F.array(*[F.lit(x) for x in TIERS])).alias("cuts")), share=share, most=most)
    t = checkpoint(t.withColumn("src", F.xxhash64("source")))
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = t.agg(F.max("n").alias("most"), F.count("*").alias("sources")).first()
    small = F.broadcast if s["sources"] <= MOST_SOURCES else (lambda df: df)
    x = d.join(small(t.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    x = x.withColumn("whole", F.floor(p + EPS).cast("int")).withColumn("p", p - F.col("whole"))
    x = x.withColumn("open", (F.col("p") > EPS) & (F.col("size") > 0))
    n_of = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    item = F.struct("id", "h", "o", F.col("size").cast("double").alias("s"), "p")
    level = x.where("open").withColumn("b", F.pmod(F.xxhash64("id", "h", "o", F.lit(seed)), n_of))
    tier = F.lit(0)
    for k in range(len(TIERS)):
        tier = tier + (F.col("size") <= F.get(F.col("cuts"), F.lit(k))).cast("int")
    level = level.select("src", "b", tier.alias("tier"), item.alias("x"))
    blocks = max(1, math.ceil((s["most"] or 0) / BLOCK))
    settled = None
    for k in range(len(TIERS) + 1):
        own = level.where(F.col("tier") == k).select("src", "b", "x")
        part = checkpoint(_settle(own, blocks, seed + k))
        settled = part if settled is None else settled.unionByName(part)
        if k == len(TIERS):
            break
        got = part.groupBy("src").agg(F.sum(F.col("c") * F.col("s")).alias("got"))
        # a source's documents share one probability: times whole words, its sum does not depend on their order
        rest = level.groupBy("src").agg((F.max("x.p") * F.sum(F.when(F.col("tier") == k, F.col("x.s")))).alias("want"), F.sum(F.when(F.col("tier") > k, F.col("x.s"))).alias("room"))
        shift = rest.join(got, "src").select("src", ((F.col("want") - F.col("got")) / F.col("room")).alias("shift"))
        moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x.p") + F.coalesce("shift", F.lit(0.0))))
        level = level.where(F.col("tier") > k)
        # a few numbers per source: rows of a hot source stay where they are
        level = (level.join(small(shift), "src", "left") if s["sources"] <= MOST_SOURCES else level.join(*dealt(level, shift, "src"), "left")).withColumn("x", F.col("x").withField("p", moved)).select("src", "b", "tier", "x")
    settled = settled.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("o").alias("_o"), "c")
    out = x.join(settled, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("o") == F.col("_o")), "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.coalesce(F.col("c"), F.lit(0)))
    return out.select(F.col("id").alias(key), "h", "o", "size", "source", "source_size", "target", copies.cast("int").alias("copies"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The input's rows, each as often as the mix takes it."""
    p = plan(df, key, text, source, seed)
    # rows of one key, text and source have one size, so they differ by a copy at most: how many have one more is all there is to know
    p = p.groupBy(F.col(key).alias("_id"), F.col("h").alias("_h")).agg(F.min("copies").alias("_c"), F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    p = checkpoint(p)
    cols = df.columns
    d = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    k, t, s = (f"c{cols.index(c)}" for c in (key, text, source))
    d = d.withColumn("_k", F.col(k).cast("long")).withColumn("_x", F.xxhash64(F.col(t), F.col(s)))
    meet = lambda p: d.join(p, F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_h")))
    # what is not taken doesn't travel
    out = meet(p.where("_rows = 1 AND _all > 0")).withColumn("_n", F.col("_c"))
    if p.where("_rows > 1").limit(1).count():  # numbered row by row; no group is held
        many = meet(p.where("_rows > 1 AND _all > 0")).withColumn("_o", F.row_number().over(Window.partitionBy("_k", "_x").orderBy("_x")))
        out = out.unionByName(many.withColumn("_n", F.col("_c") + (F.col("_o") <= F.col("_all") - F.col("_rows") * F.col("_c")).cast("int")).drop("_o"))
    out = out.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
