"""Removal of repeated multi-line chunks.

A rolling window of `min_lines` line hashes runs over each text.  A chunk goes on for
as long as the window stands earlier in the corpus (by document id, text hash and
place, without overlap) and ends where it does not.  So boundaries depend on the lines
at them and on nothing else: a chunk that is shared has the same ends wherever it
stands and whatever is around it, and goes from its first line to its last, if it has
`min_lines` lines or more.  The first occurrence of a line is in no window that stands
earlier, so no line is lost from the corpus.

Windows are compared line hash by line hash, then by bytes: the different lines of all
windows that stand more than once are brought together under their hash, and a hash
that stands for two lines cuts nothing.  No group is ever gathered; aggregations
combine before their shuffle, and joins on a hot window or line are plain equi-joins
that adaptive execution can split.

Defined results: a null text stays null and an empty one empty; a text that loses
all its lines becomes empty but keeps its row; rows with the same document id and
text count as one document, differing texts under one id (or none) as several; null
ids sort first; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, dealt

NO_ID = -(2**63)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once although f uses it in a lambda."""
    return F.get(F.transform(F.array(x), f), 0)


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _windows(text: Column, m: int) -> Column:
    """The line hashes of all windows of m lines, by the line that they start at."""
    hashes = F.transform(F.split(text, "\n"), lambda x: _hash(x))
    each = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (m - 1), F.lit(0))), lambda x, i: F.slice(h, i + 1, m))
    return _let(hashes, each)


def removals(df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2) -> DataFrame:
    """(id, t, k): windows from line k that repeat an earlier one, in the text of hash t under an id."""
    m = min_lines
    c = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    keys = c.select("id", "t", F.posexplode(_windows(F.col("text"), m)).alias("k", "w"))
    ends = [f(x).alias(f"{n}_{x}") for x in ("id", "t", "k") for n, f in (("lo", F.min), ("hi", F.max))]
    often = keys.groupBy("w").agg(*ends).where("lo_id < hi_id OR lo_t < hi_t OR lo_k < hi_k").select("w")
    many = checkpoint(keys.join(*dealt(keys, often, "w"), "left_semi"))  # hashes and places alone
    # the different lines of those windows, by their bytes
    at = many.groupBy("id", "t").agg(F.collect_set("k").alias("at"))
    lines = lambda ls, at: F.transform(F.array_distinct(F.flatten(F.transform(at, lambda k: F.sequence(k, k + (m - 1))))), lambda i: F.get(ls, i))
    texts = c.join(at, ["id", "t"]).select(F.explode(_let(F.split("text", "\n"), lambda ls: lines(ls, F.col("at")))).alias("line"))
    shared = checkpoint(texts.select(_hash(F.col("line")).alias("x"), "line").distinct().groupBy("x").count().where("count > 1").select("x"))
    # the first place of each window; every other that doesn't overlap it repeats it
    first = many.groupBy("w").agg(F.min(F.struct("id", "t", "k")).alias("first"))
    r, same = dealt(many, first, "w")
    own = (F.col("id") == F.col("first.id")) & (F.col("t") == F.col("first.t"))
    again = many.join(r, same).where(~own | (F.col("k") >= F.col("first.k") + m)).select("id", "t", "k", "w")
    for i in range(m if shared.limit(1).count() else 0):  # hardly ever a hash stands for two lines
        again = again.withColumn("x", F.get("w", F.lit(i))).join(shared, "x", "left_anti").drop("x")
    return again.select("id", "t", "k")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, counts: bool = False) -> DataFrame:
    """The input's rows with repeated runs of lines cut out of their texts.

    With `counts`, columns n_lines and n_removed (lines before, lines cut) follow.
    """
    gone = removals(df, key, text, min_lines).groupBy("id", "t").agg(F.collect_set("k").alias("_gone"))
    cols = df.columns
    d = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    k, t = f"c{cols.index(key)}", f"c{cols.index(text)}"
    d = d.withColumn("_id", F.coalesce(F.col(k).cast("long"), F.lit(NO_ID))).withColumn("_t", F.xxhash64(t))
    d = d.join(gone, (F.col("_id") == gone["id"]) & (F.col("_t") == gone["t"]), "left")
    # only texts that lose something are cut up again
    lost = F.flatten(F.transform("_gone", lambda k: F.sequence(k, k + (min_lines - 1))))
    left = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), lost), lambda i: F.get(ls, i))
    d = d.withColumn("_kept", F.when(F.col("_gone").isNotNull(), _let(F.split(t, "\n"), left)))
    cut = F.array_join("_kept", "\n")
    out = [F.col(f"c{i}").alias(c) if c != text else F.when(F.col("_kept").isNotNull(), cut).otherwise(F.col(t)).alias(c) for i, c in enumerate(cols)]
    if counts:
        n = F.coalesce(F.size(F.split(t, "\n")), F.lit(0))
        out += [n.cast("long").alias("n_lines"), F.coalesce(n - F.size("_kept"), F.lit(0)).cast("long").alias("n_removed")]
    return d.select(*out)
