"""Folder trees: from listings to nested JSON, from JSON to folders and blank files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.files import relative

IGNORED = ("node_modules", ".git", ".DS_Store")


def listing(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Relative paths of all files below a folder; no file is opened."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    d = b.select(relative(spark, root).alias("path"))
    return d.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in ignored])))


def entries(paths: DataFrame) -> DataFrame:
    """(path, is_dir) of files and of all folders above them."""
    p = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/"))
    folders = paths.where(F.col("path").contains("/")).select(F.explode(up).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return folders.unionByName(paths.select("path", F.lit(False).alias("is_dir")))


def flattened(df: DataFrame, text: str) -> DataFrame:
    """(path, is_dir) of nested structures in JSON; names with separators, `..` or NUL fail the query."""

    def walk(node: dict, base: str) -> Iterator[tuple[str, bool]]:
        for name, x in sorted(node.items()):
            if not name or name in (".", "..") or re.search(r"[/\\\0]", name):
                raise ValueError(f"invalid name {name!r}")
            path = f"{base}/{name}" if base else name
            yield path, isinstance(x, dict)
            if isinstance(x, dict):
                yield from walk(x, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for t in b[text] for r in walk(json.loads(t), "")], columns=["path", "is_dir"])

    return df.select(text).mapInPandas(run, "path string, is_dir boolean")


def skeleton(plan: DataFrame, out: str, overwrite: bool = False) -> dict[str, int]:
    """Create the folders and blank files of a plan (path, is_dir) through Spark's file systems; counts of what was done.

    Plans are as large as a project's folder tree, and go to the driver row by row.
    """
    spark = plan.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(out).getFileSystem(spark._jsc.hadoopConfiguration())
    done = {"folders": 0, "files": 0, "skipped": 0}
    for r in plan.orderBy("path").toLocalIterator():
        p = hadoop(f"{out}/{r['path']}")
        if r["is_dir"]:
            done["folders"] += fs.mkdirs(p)
        elif fs.exists(p) and not overwrite:
            done["skipped"] += 1
        else:
            fs.create(p, True).close()
            done["files"] += 1
    return done


def expanded(patterns: DataFrame, services: DataFrame) -> DataFrame:
    """Paths with `*` replaced by the name of every service; others once."""
    star = F.col("path").contains("*")
    many = patterns.where(star).join(services)
    return many.select(F.replace("path", F.lit("*"), F.col("service")).alias("path")).unionByName(patterns.where(~star).select("path"))
