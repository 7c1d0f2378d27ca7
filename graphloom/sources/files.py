"""Text files as tables (path, text, sha256, is_test, is_declaration)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import excluded, is_declaration_path, is_source_path, is_test_path, matches_glob, safe_path

#: Parts of paths that are never read as context.
IGNORED = (".git/", "node_modules/", "dist/", "build/", "coverage/", ".lock", "package-lock.json", ".env", "credential", "secret")


class NothingMatched(ValueError):
    """A glob that had to match found no file."""


def described(files: DataFrame) -> DataFrame:
    """Add what is known from path and text; a byte order mark becomes a blank, so places stay."""
    t = F.regexp_replace("text", "^﻿", " ")
    return files.select("path", t.alias("text"), F.sha2("text", 256).alias("sha256"), is_test_path(F.col("path")).alias("is_test"), is_declaration_path(F.col("path")).alias("is_declaration"))


def relative(spark: SparkSession, root: str) -> Column:
    """The column `path` below a folder; Spark and Hadoop print local paths with one or three slashes."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    prefix = (base if not base.startswith("file:") else "file:/" + base.removeprefix("file:").lstrip("/")) + "/"
    return F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(prefix), F.lit(""))


def text_files(spark: SparkSession, root: str, globs: list[str] | None = None, exclude: tuple[str, ...] = ("node_modules",), required: bool = False) -> DataFrame:
    """Files below a folder with paths relative to it; text files with a NUL byte are left out."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = b.where(F.expr("position(unhex('00') IN content) = 0")).select(relative(spark, root).alias("path"), F.decode("content", "UTF-8").alias("text"))
    files = files.where(~excluded(F.col("path"), *exclude)) if exclude else files
    if globs:
        if required:
            for g in globs:
                if not files.where(matches_glob(F.col("path"), g)).limit(1).count():
                    raise NothingMatched(f"no file matches the glob {g}")
        files = files.where(matches_glob(F.col("path"), *globs))
    return described(files)


def source_files(files: DataFrame, declarations: bool = False) -> DataFrame:
    """Script sources, without declaration files unless asked for."""
    own = files.where(is_source_path(F.col("path")) & ~F.col("path").contains("node_modules"))
    return own if declarations else own.where(~is_declaration_path(F.col("path")))


def in_memory(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Given texts as files; a path that leaves the root fails the query."""
    d = spark.createDataFrame(files, "path string, text string")
    return described(d.withColumn("path", F.when(safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path outside the root: "), "path")))))


def overlaid(files: DataFrame, overlay: DataFrame) -> DataFrame:
    """Files with the texts of an overlay (path, text) in place of their own; an unknown path fails the query."""
    o = overlay.select("path", F.col("text").alias("_new"), F.lit(True).alias("_over"))
    f = files.select("path", "text", F.lit(True).alias("_known")).join(o, "path", "full_outer")
    text = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no such file: "), "path"))).otherwise(F.coalesce("_new", "text"))
    return described(f.select("path", text.alias("text")))


def allowed(files: DataFrame) -> DataFrame:
    """Files that may be read as context."""
    hit = F.lit(False)
    for part in IGNORED:
        hit = hit | F.lower("path").contains(part)
    return files.where(~hit)


def documentation(files: DataFrame) -> DataFrame:
    return allowed(files).where(F.col("path").rlike(r"(?i)^(readme|contributing)[^/]*$|^docs/.*\.md$"))


def tidy(text: Column) -> Column:
    """Line feeds alone, none at the end."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n+$", "")
