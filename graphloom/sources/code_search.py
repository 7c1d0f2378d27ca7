"""Code search results as a table, through any function that fetches a page.

One partition per package and extension follows `next` links up to a number of
pages, with bounded retries.  The fetching function is given, so tests (and
clusters without a network) use a recorded one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.sets import fair_sample

#: Extensions that are searched.
EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")
HITS = "package string, extension string, repository string, path string, sha string"


def backoff_seconds(attempt: int, base: float, most: float) -> float:
    return min(most, base * 2 ** max(0, attempt - 1))


def retried(fetch: Callable, *args, attempts: int = 5, base: float = 1.0, most: float = 30.0, sleep=time.sleep):
    """The result of fetch; a ConnectionError is tried again after growing waits."""
    for k in range(1, attempts + 1):
        try:
            return fetch(*args)
        except ConnectionError:
            if k == attempts:
                raise
            sleep(backoff_seconds(k, base, most))


def jobs(packages: DataFrame, package: str = "package") -> DataFrame:
    """(package, extension): one search for every package and extension."""
    return packages.select(F.col(package).alias("package"), F.explode(F.array(*[F.lit(e) for e in EXTENSIONS])).alias("extension"))


def fetched(spark: SparkSession, packages: list[str], fetch: Callable[[str, str, int], tuple[list[tuple[str, str, str]], int, bool]], pages: int = 10, attempts: int = 5) -> DataFrame:
    """Rows of every page read, with the page, the total that the service names, and whether pages were left; a page without hits is one row of nulls.

    fetch(package, extension, page) gives (repository, path, sha) rows, the total, and
    whether a next page exists.  Persist the result where hits and status are both read.
    """
    todo = jobs(spark.createDataFrame([(p,) for p in packages], "package string")).repartition(len(packages) * len(EXTENSIONS), "package", "extension")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, e in zip(b["package"], b["extension"]):
                for page in range(1, pages + 1):
                    rows, total, more = retried(fetch, p, e, page, attempts=attempts)
                    left = bool(more and page == pages)
                    yield pd.DataFrame([(p, e, *r, page, total, left) for r in rows or [(None, None, None)]], columns=["package", "extension", "repository", "path", "sha", "page", "total", "left"])
                    if not more:
                        break

    return todo.mapInPandas(run, f"{HITS}, page int, total long, left boolean")


def hits(read: DataFrame) -> DataFrame:
    return read.where(F.col("path").isNotNull()).select("package", "extension", "repository", "path", "sha")


def status(read: DataFrame) -> DataFrame:
    """(package, extension, pages, total, hits, truncated): truncated where pages were left or fewer hits came than the total."""
    n = F.count("path")
    return read.groupBy("package", "extension").agg(F.max("page").alias("pages"), F.max("total").alias("total"), n.alias("hits"), (F.bool_or("left") | (n < F.max("total"))).alias("truncated"))


def search(spark: SparkSession, packages: list[str], fetch: Callable[[str, str, int], tuple[list[tuple[str, str, str]], int, bool]], pages: int = 10, attempts: int = 5) -> DataFrame:
    """Hits of every package and extension; `status` of `fetched` tells what was left out."""
    return hits(fetched(spark, packages, fetch, pages, attempts))


def candidates(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct files; with `most`, taken in turn from the queues of package and extension."""
    if most is None:
        return hits.select("repository", "path", "sha").distinct()
    q = hits.withColumn("queue", F.concat_ws("\0", "package", "extension"))
    return fair_sample(q, "queue", ["repository", "path", "sha"], ["repository", "path", "sha"], most)


def blobs(found: DataFrame) -> DataFrame:
    """One file to fetch per blob, the first by repository and path."""
    return found.groupBy("sha").agg(F.min(F.struct("repository", "path")).alias("f")).select("sha", "f.repository", "f.path")
