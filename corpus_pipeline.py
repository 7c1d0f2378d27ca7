"""From raw documents to packed training sequences.

Five stages, each over all rows that the one before it kept.  Stages return the
columns of `documents`, the last one the pieces of packed sequences.

Defined results, for every stage: an empty table gives an empty one; columns beyond
those of `documents`, whatever their names, pass through (the last stage drops them).
Null and empty texts have no words, so the first stage rejects them; those that the
second empties stay, link with nothing, have size 0 and so are in no mix.  Repeated
rows with one id and text are one document to the second and third stage: the second
cuts them alike, the third keeps one.  Elsewhere they are rows of their own.  A null id sorts first: texts
without one count as earlier than all others.  Ties are settled by id, then by hash of
the text.  A null source is a source of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, near_dup, packing, quality
from graphloom.llm.common import checkpoint_dir, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, weighed by their estimated accuracies, find good; short and repetitive ones fail the base rule."""
    return quality.keep(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that an earlier one has; n_chars follows the text, and is null where that is."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, up to twice."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place there."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", packed),
]

#: The fit of the rules and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if last is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{top}/{k}"
