"""Connected components of a link table, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in a link, component being the smallest id reachable.

    Each round, a node takes the smallest label among its own and its neighbours',
    and then its label's label: labels reach their minimum in about log(diameter)
    rounds.  A node with many links is summed up before the shuffle.  Rounds are
    cut off from one another by reliable checkpoints.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = checkpoint(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = e.groupBy(F.col("u").alias("id")).agg(F.least(F.first("u"), F.min("v")).alias("component"))
    label = checkpoint(label)
    while True:
        near = e.join(label.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = checkpoint(step.join(jump, "component").select("id", "old", F.least("component", "next").alias("component")))
        if not new.where("component < old").limit(1).count():
            return new.select("id", "component")
        label = new.select("id", "component")
