"""Deduplication, multisets, fair sampling and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """One row per key, with the carried columns of its last row; combined before the shuffle."""
    last = F.max(F.struct(*order, *[c for c in carry if c not in order])).alias("_l")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in carry])


def keep_best(df: DataFrame, keys: list[str], score: str, tie: list[str], carry: list[str]) -> DataFrame:
    """One row per key with the largest score, the first by `tie` on equal scores."""
    best = F.min(F.struct((-F.col(score)).alias("_s"), *tie, *[c for c in carry if c not in tie])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in carry])


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many more rows of each key the left side has."""
    n = left.groupBy(*keys).agg(F.count("*").alias("n")).unionByName(right.groupBy(*keys).agg((-F.count("*")).alias("n")))
    return n.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def united(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Rows of both sides, one for each key: the left side's where both have it."""
    d = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    rest = [c for c in left.columns if c != key]
    return d.groupBy(key).agg(F.min(F.struct("_side", *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def shared(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the left side whose key the right side has too."""
    return left.join(right.select(key), key, "left_semi")


def omitted(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the left side whose key the right side has not."""
    return left.join(right.select(key), key, "left_anti")


def covered_keys(candidates: DataFrame, template: DataFrame, group: str, key: str) -> DataFrame:
    """(group, same, missing): whether each group's keys are all in the template, and the template's number of keys that it lacks."""
    n = template.select(key).distinct().count()  # fields of one template
    d = candidates.select(group, key).distinct().join(template.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return d.groupBy(group).agg((F.count("*") == F.count("_in")).alias("same"), (F.lit(n) - F.count("_in")).alias("missing"))


def fair_sample(df: DataFrame, queue: str, order: list[str], item: list[str], cap: int) -> DataFrame:
    """Round-robin over queues in their order: each gives its next item that no other gave yet, up to `cap` in all.

    A queue gives `cap` items at most and passes over as many, so its first 2 * cap
    can matter; one task then walks those of all queues.  Input order does not matter.
    """
    w = Window.partitionBy(queue).orderBy(*order)
    d = df.dropDuplicates([queue, *item]).withColumn("round", F.row_number().over(w)).where(F.col("round") <= 2 * cap)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat(batches)
        if not len(b):
            return
        queues = {q: list(zip(map(tuple, g[item].to_numpy()), g.index)) for q, g in b.reset_index(drop=True).groupby(queue, sort=True)}
        b = b.reset_index(drop=True)
        chosen, picked, at = set(), [], dict.fromkeys(queues, 0)
        turn = 0
        while len(picked) < cap:
            turn, before = turn + 1, len(picked)
            for q, rows in queues.items():
                while at[q] < len(rows) and rows[at[q]][0] in chosen:
                    at[q] += 1
                if at[q] < len(rows) and len(picked) < cap:
                    chosen.add(rows[at[q]][0])
                    picked.append((rows[at[q]][1], turn))
                    at[q] += 1
            if len(picked) == before:
                break
        yield b.loc[[i for i, _ in picked]].assign(round=[t for _, t in picked])

    return d.orderBy(queue, "round").coalesce(1).mapInPandas(walk, d.schema)


def packed(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Greedy choice per key: in order, whatever still fits is taken and the rest is passed over. Streams; keeps one number per key."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left = None, budget
        for b in batches:
            keep = []
            for k, c in zip(zip(*(b[x] for x in keys)), b[cost]):
                if k != now:
                    now, left = k, budget
                keep.append(c <= left)
                left -= c if c <= left else 0
            yield b[keep]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(take, df.schema)
