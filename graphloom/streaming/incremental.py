"""Incremental forms of batch operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.query import jspath


def json_lines(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """(file, text) of lines in files as they arrive."""
    d = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def path_matches(lines: DataFrame, expression: str) -> DataFrame:
    """Results of a path expression on a stream; stateless, so any sink and mode will do."""
    return jspath.query(lines, "file", "text", expression)


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and their values per window and type; state goes when the watermark passes a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
