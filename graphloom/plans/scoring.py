"""Additive evidence scores, their two final forms, and detections by node.

Signals are rows (keys, rule, area, points, strength) with area local, type, graph,
call or penalty.  Both families cap graph evidence; they differ in how evidence of
one sort alone is held down and in rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    low: float = 1.0
    medium: float = 4.0
    high: float = 7.0
    graph_cap: float = 5.0
    call_cap: float = 4.0


def signals(df: DataFrame, keys: list[str], rules: list[tuple[str, str, str, Column, Column | float]]) -> DataFrame:
    """One row per rule that holds, from (rule, area, strength, condition, points)."""
    row = lambda n, a, s, p: F.struct(F.lit(n).alias("rule"), F.lit(a).alias("area"), F.lit(s).alias("strength"), (p if isinstance(p, Column) else F.lit(float(p))).cast("double").alias("points"))
    found = F.array(*[F.when(cond, row(n, a, s, p)) for n, a, s, cond, p in rules])
    return df.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def totals(sig: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by area and what the final forms ask of the rules."""
    area = lambda a: F.coalesce(F.sum(F.when(F.col("area") == a, F.col("points"))), F.lit(0.0)).alias(a)
    return sig.groupBy(*keys).agg(
        *[area(a) for a in ("local", "type", "graph", "call", "penalty")],
        F.count_if((F.col("strength") == "strong") & F.col("area").isin("local", "type")).alias("strong"),
        F.bool_and(F.col("rule").contains("name") | (F.col("area") == "penalty")).alias("all_names"),
        F.bool_or(~F.col("rule").rlike("(?i)name|suffix|decorator") & (F.col("area") != "penalty")).alias("other_rules"),
        F.count_if(F.col("area") != "penalty").alias("rules"),
    )


def confidence(score: Column, c: Config = Config()) -> Column:
    return F.when(score >= c.high, "high").when(score >= c.medium, "medium").otherwise("low")


def mode(level: Column) -> Column:
    """How much a detection may be relied on."""
    return F.when(level == "high", "detected").when(level == "medium", "probable").otherwise("weak")


def _finished(t: DataFrame, keys: list[str], score: Column, c: Config) -> DataFrame:
    t = t.withColumn("score", score)
    level = confidence(F.col("score"), c)
    return t.select(*keys, "score", level.alias("confidence"), (F.col("score") >= c.low).alias("detected"), "rules", "strong")


def finish_additional(sig: DataFrame, keys: list[str], c: Config = Config()) -> DataFrame:
    """Graph-only and naming-only evidence stays below medium, weak evidence below high; not negative, one decimal."""
    t = totals(sig, keys)
    own = F.col("local") + F.col("type")
    graph, call = F.least("graph", F.lit(c.graph_cap)), F.least("call", F.lit(c.call_cap))
    s = own + graph + call - F.col("penalty")
    s = F.when((own <= 0) & ((graph > 0) | (call > 0)), F.least(s, F.lit(c.medium - 0.1))).otherwise(s)
    s = F.when((F.col("rules") > 0) & F.col("all_names"), F.least(s, F.lit(c.medium - 0.1))).otherwise(s)
    s = F.when((F.col("strong") == 0) & (s >= c.high), F.lit(c.high - 0.1)).otherwise(s)
    return _finished(t, keys, F.floor(F.greatest(s, F.lit(0.0)) * 10 + 0.5) / 10, c)


def finish_architecture(sig: DataFrame, keys: list[str], c: Config = Config()) -> DataFrame:
    """Graphs alone make no high score, names alone stay a quarter below medium; may be negative, two decimals, halves up."""
    t = totals(sig, keys)
    own = F.col("local") + F.col("type")
    s = own + F.least("graph", F.lit(c.graph_cap)) + F.least("call", F.lit(c.call_cap)) - F.col("penalty")
    s = F.when((own < 2) & (s >= c.high), F.lit(c.medium)).otherwise(s)
    names = (F.col("local") > 0) & ~F.col("other_rules") & (F.col("type") == 0) & (F.col("graph") == 0) & (F.col("call") == 0)
    s = F.when(names, F.least(s, F.lit(c.medium - 0.25))).otherwise(s)
    return _finished(t, keys, F.floor(s * 100 + 0.5) / 100, c)


def at_least(df: DataFrame, level: str) -> DataFrame:
    """Detections of a confidence or a higher one."""
    order = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    return df.where(F.array_position(order, F.col("confidence")) >= F.array_position(order, F.lit(level)))


def evidence_points(found: DataFrame, starts: DataFrame, each: float, cap: float, relation: str | None = None) -> DataFrame:
    """(start, items, points): graph evidence (start, relation, ...) of chosen starts, `each` points an item and `cap` at most; `relation` takes the place of the items' own."""
    e = found.join(starts.select("start"), "start", "left_semi")
    e = e.withColumn("relation", F.lit(relation)) if relation is not None else e
    return e.groupBy("start", "relation").agg(F.count("*").alias("items"), F.least(F.lit(float(cap)), F.count("*") * each).alias("points"))


def by_node(detections: DataFrame, node: list[str]) -> DataFrame:
    """(node, n, patterns): patterns with their modes, best score first, then by name."""
    found = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "pattern", "mode")))
    return detections.groupBy(*node).agg(F.count("*").alias("n"), F.transform(found, lambda x: F.concat_ws("=", x["pattern"], x["mode"])).alias("patterns"))


def intersections(detections: DataFrame, node: list[str], pattern: str, related: DataFrame) -> DataFrame:
    """Pairs of related patterns (a, b) that a node has both of; pairs are taken from the relation, not from all of a node's."""
    d = detections.select(*node, F.col(pattern).alias("a")).distinct()
    return d.join(related, "a").join(d.withColumnRenamed("a", "b"), [*node, "b"], "left_semi")
