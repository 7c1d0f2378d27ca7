"""Joins of names, ids and paths, each as joins on equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(df: DataFrame, facts: list[tuple[DataFrame, str, str]], name: Column, out: str = "resolved") -> DataFrame:
    """Add the id that the first fact table (facts, key, id) has for a row, else `external:` and its name."""
    found = []
    for i, (f, key, id_) in enumerate(facts):
        df = df.join(f.select(F.col(key), F.col(id_).alias(f"_r{i}")), key, "left")
        found.append(F.col(f"_r{i}"))
    return df.withColumn(out, F.coalesce(*found, F.concat(F.lit("external:"), name))).drop(*[f"_r{i}" for i in range(len(facts))])


#: Rows of the other side up to which it is sent to every executor.
SMALL = 20_000


def sized(other: DataFrame) -> DataFrame:
    """Other side of a join: sent to every executor if it is counted to be small, else dealt out with its partner, never through the driver."""
    return other.hint("broadcast" if other.limit(SMALL + 1).count() <= SMALL else "merge")


def _meet(opened: DataFrame, other: DataFrame, on: str | Column) -> DataFrame:
    """Join rows that were opened into several each with the other side.

    Spark takes the opened rows to be as few as before and would send them all through
    the driver.  Only another side that was counted to be small is sent, else both are dealt out.
    """
    return opened.join(sized(other), on)


def suffix_join(names: DataFrame, vocabulary: DataFrame, name: str, word: str, by: str = ".") -> DataFrame:
    """Names that are a word or end with it after `by`: names are opened into their suffixes."""
    p = F.split(name, by.replace(".", "\\."))
    tails = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), by))
    return _meet(names.withColumn("_tail", F.explode(tails)), vocabulary, F.col("_tail") == F.col(word)).drop("_tail")


def substring_join(names: DataFrame, vocabulary: DataFrame, name: str, word: str, width: int = 3) -> DataFrame:
    """Names that contain a word, in any case: they meet under the first `width` characters of the word, then are tested.

    Words shorter than that are met by all of their length.
    """
    n, w = F.lower(name), F.lower(word)
    lengths = F.array(*[F.lit(k) for k in range(1, width + 1)])
    grams = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(n) - k + 1, F.lit(1))), lambda i: F.substr(n, i, k))))
    left = names.withColumn("_g", F.explode(F.array_distinct(grams)))
    right = vocabulary.withColumn("_g", F.substr(w, F.lit(1), F.lit(width)))
    return _meet(left, right, "_g").where(F.contains(n, w)).drop("_g")


def prefix_join(specifiers: DataFrame, packages: DataFrame, specifier: str, package: str) -> DataFrame:
    """Specifiers that are a package or a path below one."""
    p = F.split(specifier, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/"))
    return _meet(specifiers.withColumn("_head", F.explode(heads)), packages, F.col("_head") == F.col(package)).drop("_head")


def contains_join(df: DataFrame, ids: DataFrame, array: str, id_: str) -> DataFrame:
    """Rows with each id that their array holds."""
    return _meet(df.withColumn("_x", F.explode(F.array_distinct(array))), ids, F.col("_x") == F.col(id_)).drop("_x")


def bijective(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Groups in which every a goes with one b and every b with one a."""
    d = pairs.select(group, a, b).distinct()
    n = lambda k, x: d.groupBy(group, k).agg(F.count("*").alias("n")).groupBy(group).agg(F.max("n").alias(x))
    return n(a, "na").join(n(b, "nb"), group).where("na = 1 and nb = 1").select(group)


def nearest_ancestor(paths: DataFrame, files: DataFrame, path: str, base: str) -> DataFrame:
    """For each path the file named `base` in the nearest folder above it (columns: path, found)."""
    from graphloom.functions.text import ancestors

    up = paths.select(path, F.posexplode(ancestors(F.col(path))).alias("_d", "_folder"))
    at = files.where(F.col("file").endswith(base)).select("file", F.regexp_replace("file", "/?[^/]+$", "").alias("_folder"))
    at = at.where((F.col("file") == F.lit(base)) | F.col("file").endswith(f"/{base}"))
    return _meet(up, at, "_folder").groupBy(path).agg(F.max_by("file", "_d").alias("found"))
