"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space as the corpus contracts define it; anything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the parquet tables of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Rows of an Arrow batch that are Python objects at once.
SLICE = 128


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows through a Python function that gives any number of rows for each; `make` is called once per task.

    An Arrow batch may hold 10,000 whole texts: they become Python strings `SLICE` at
    a time, and what they give goes on before the next ones come.
    """
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                out = [y for x in zip(*(c.to_pylist() for c in part.columns)) for y in f(*x)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), out_schema)], schema=out_schema)

    return df.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a single machine that names none, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint that outlives any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """The right side and the condition of an equi-join of two frames of one lineage on a key that may be hot.

    Where one side is an aggregate by the key, Spark joins it as it lies, and then
    adaptive execution can't split a hot key's rows.  With a hash of the key as a
    second key both sides are dealt for the join.  The right side's key comes out
    under another name.
    """
    name, twin = f"_{key}", f"_{key}_"
    r = right.withColumnRenamed(key, name).withColumn(twin, F.xxhash64(name))
    return r, (left[key] == r[name]) & (F.xxhash64(left[key]) == r[twin])


def hidden(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of the input."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words, as `size(words(text))` but without making them where a byte count tells it.

    A text whose only white space is single blanks and line feeds between words has
    one more word than those; the tests for that are plain byte searches.
    """
    t = F.coalesce(text, F.lit(""))
    odd = F.lit(False)
    for s in ("  ", "\n\n", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(t, F.lit(s))
    for s in (" ", "\n"):
        odd = odd | F.startswith(t, F.lit(s)) | F.endswith(t, F.lit(s))
    gaps = F.octet_length(t) - F.octet_length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).when(odd, F.size(words(t))).otherwise(gaps + 1).cast("long")


#: Stands for a null id where Python works on ids: pandas would turn a column with nulls into floats.
NO_ID = -(2**63)


def safe_id(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def own_id(c: Column) -> Column:
    """The reverse of `safe_id`."""
    return F.when(c != NO_ID, c)
