"""Operators over half-open ranges [start, end) per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesced(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Touching or overlapping ranges of a key merged, with the number of ranges in each as `n`.

    A running maximum of ends marks where a new island begins.  With `width`, ranges
    are first merged among those that start in the same bucket: a key with very many
    ranges is then many tasks, and its islands alone meet in one.
    """
    out = df.select(*keys, start, end, F.lit(1).cast("long").alias("n"))
    if width is not None:
        out = _islands(out.withColumn("_bucket", F.floor(F.col(start) / width)), [*keys, "_bucket"], start, end).drop("_bucket")
    return _islands(out, keys, start, end)


def _islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start, end)
    df = df.withColumn("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_island", F.sum(F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_island")


def maximal(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges that no other range of their key contains; one of equal ranges stays. A running maximum instead of a self join."""
    d = df.dropDuplicates([*keys, start, end])
    w = Window.partitionBy(*keys).orderBy(F.col(start).asc(), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_reach", F.max(end).over(w)).where(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).drop("_reach")


def bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bucket of the given width that a range touches: the equi-join key of interval joins."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def covering(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with each range of their key that covers them, by equality on buckets and a residual test."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return p.join(bucketed(ranges, start, end, width), [*keys, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str], id_: str, at: str, start: str, end: str, width: int, carry: list[str]) -> DataFrame:
    """The narrowest covering range of each point, the first by its carried columns on ties."""
    c = covering(points, ranges, keys, at, start, end, width)
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("w"), *carry)).alias("b")
    return c.groupBy(*keys, id_).agg(best).select(*keys, id_, *[F.col(f"b.{x}").alias(x) for x in carry])


def conflicts(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges that begin before the one before them, in sorted order, has ended."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))


def apply_edits(files: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Texts with (start, end, replacement) applied by original offsets; a range outside the text fails the query."""
    e = edits.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_edits"))
    d = files.join(e, file, "left")
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0))), x["replacement"]).alias("out"), x["end"].alias("at"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    end = lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text)))
    outside = F.exists("_edits", lambda x: (x["start"] < 0) | (x["end"] < x["start"]) | (x["end"] > F.length(text)))
    done = F.when(outside, F.raise_error(F.lit("edit outside its text"))).otherwise(F.aggregate("_edits", zero, step, end))
    return d.withColumn(text, F.when(F.col("_edits").isNull(), F.col(text)).otherwise(done)).drop("_edits")


def budgeted(df: DataFrame, keys: list[str], budget: int, start: str = "start", end: str = "end", rank: str = "rank") -> DataFrame:
    """Per key, ranges taken in rank order that overlap none taken before and still fit the byte budget; others are passed over."""
    schema = df.schema

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, left = None, [], budget
        for b in batches:
            keep = []
            for row in b.itertuples():
                k = tuple(getattr(row, c) for c in keys)
                if k != now:
                    now, taken, left = k, [], budget
                s, e = getattr(row, start), getattr(row, end)
                ok = e - s <= left and not any(s < y and x < e for x, y in taken)
                if ok:
                    taken.append((s, e))
                    left -= e - s
                keep.append(ok)
            yield b[keep]

    return df.repartition(*keys).sortWithinPartitions(*keys, rank, start, end).mapInPandas(take, schema)
