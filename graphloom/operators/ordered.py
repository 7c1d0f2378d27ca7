"""Operators on rows in order within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def following(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str = "next") -> DataFrame:
    """Add the value of the next row of the same key.

    `bucket` grows with the order (a day of a time, say): rows are sorted within
    buckets, so a key with a third of all rows is many tasks, and the last row of a
    bucket takes the value from the head of the next one.
    """
    d = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    heads = d.groupBy(*keys, "_b").agg(F.min(F.struct(*order, F.col(value).alias("_v"))).alias("_h"))
    heads = heads.select(*keys, "_b", F.lead("_h._v").over(Window.partitionBy(*keys).orderBy("_b")).alias("_n"))
    d = d.withColumn(out, F.lead(value).over(w)).withColumn("_end", F.lead(F.lit(1)).over(w).isNull())
    return d.join(heads, [*keys, "_b"]).withColumn(out, F.when(F.col("_end"), F.col("_n")).otherwise(F.col(out))).drop("_b", "_n", "_end")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Add the sum over a key's rows up to this one; rows are to be one per key and order."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


#: Named orders of results: columns, those with a minus descending.
ORDERS = {
    "nodes": ("qualified_name", "file_path", "line", "id"),
    "edges": ("from_id", "to_id", "relation"),
    "detections": ("-score", "pattern", "file"),
    "matches": ("file", "start", "end"),
    "chunks": ("-relevance", "file", "start_line"),
    "hits": ("repository", "path", "sha"),
    "plans": ("width", "rule_id", "candidate_id"),
    "definitions": ("owner", "name"),
    "diagnostics": ("file", "start", "code", "message"),
}
#: Roles of a selection in their order.
ROLES = ("target", "type", "incoming", "outgoing")


def named(order: str) -> list[Column]:
    """Sort columns of a named order."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in ORDERS[order]]


def by_role(role: str, *rest: str) -> list[Column]:
    """Sort columns: roles in their fixed order, unknown ones last, then the rest."""
    at = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role))
    return [F.when(at == 0, len(ROLES) + 1).otherwise(at), *map(F.col, rest)]


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """Rows numbered from 1 within their key, by any order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(df: DataFrame, order: list[Column], most: int = 20) -> tuple[DataFrame, int]:
    """(the first rows of all, how many were left out)."""
    return df.orderBy(*order).limit(most), max(0, df.count() - most)
