"""JSON documents as VARIANT values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """(file, text, value, error) of whole JSON files; not tolerant: a broken file fails the query."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    v = F.try_parse_json("text") if tolerant else F.parse_json("text")
    d = d.withColumn("value", v)
    return d.withColumn("error", F.when(F.col("value").isNull(), F.concat(F.lit("Invalid JSON in "), "file")))


def elements(docs: DataFrame, value: str = "value") -> DataFrame:
    """(file, element_pos, value): elements of top-level arrays, any other document as its own element 0."""
    array = F.schema_of_variant(value).startswith("ARRAY")
    docs = docs.where(F.col(value).isNotNull())
    spark = docs.sparkSession
    many = docs.where(array)
    inner = many.lateralJoin(spark.tvf.variant_explode(F.col(value).outer()).select(F.col("pos").alias("element_pos"), F.col("value").alias("_v")))
    many = inner.select("file", F.col("element_pos").cast("long"), F.col("_v").alias("value"))
    return many.unionByName(docs.where(~array).select("file", F.lit(0).cast("long").alias("element_pos"), F.col(value).alias("value")))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("value"), F.col("value").alias("text"))
