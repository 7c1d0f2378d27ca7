"""Ranking by words and packing under a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import STOP_WORDS, line_count, normalized, term_matches, token_estimate
from graphloom.operators.sets import packed


def task_terms(task: str) -> list[str]:
    """Sorted distinct terms of a task, as `functions.text.terms` finds them."""
    import re

    parted = re.sub(r"([a-zà-öø-ÿ0-9])([A-ZÀ-ÖØ-Þ])", r"\1 \2", task).lower()
    return sorted({t for t in re.findall(r"[^\W_]+", parted) if len(t) > 1 and t not in STOP_WORDS})


def _has(tokens: Column, term: str) -> Column:
    return F.exists(tokens, lambda t: term_matches(t, F.lit(term)))


def seed_scores(df: DataFrame, task: str, name: Column, path: Column, comment: Column, body: Column) -> DataFrame:
    """Add `score`: 100 for the task itself, per term 20 in the name, 8 in the path, 4 in the comment, and 1 in the body for ten terms at most."""
    part = {"_n": name, "_p": path, "_c": comment, "_b": body}
    d = df.withColumns({k: F.split(normalized(F.coalesce(v, F.lit(""))), " ") for k, v in part.items()})
    d = d.withColumn("_b", F.array_distinct("_b"))
    terms = task_terms(task)
    hit = lambda c, w: sum((F.when(_has(F.col(c), t), w).otherwise(0) for t in terms), F.lit(0))
    exact = F.when(normalized(F.lit(task)) == F.array_join("_n", " "), 100).otherwise(0)
    score = exact + hit("_n", 20) + hit("_p", 8) + hit("_c", 4) + F.least(F.lit(10), hit("_b", 1))
    return d.withColumn("score", score.cast("long")).drop(*part)


def relevance(text: Column, task: str) -> Column:
    """How many terms of a task a text has."""
    tokens = F.split(normalized(text), " ")
    return sum((F.when(_has(tokens, t), 1).otherwise(0) for t in task_terms(task)), F.lit(0))


_STATE = "struct<fence:string,out:array<struct<line:int,heading:string>>>"


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of (section, heading, start_line, end_line, body): headings outside fences begin a section.

    Lines are walked by an aggregate over the array of a text's lines; a fence is
    closed by its own marker alone.  Sections of white space are left out.
    """
    lines = F.split(text, r"\r?\n")
    opens = lambda x: F.when(F.startswith(F.ltrim(x), F.lit("```")), "```").when(F.startswith(F.ltrim(x), F.lit("~~~")), "~~~")
    zero = F.struct(F.lit(None).cast("string").alias("fence"), F.array(F.struct(F.lit(0).alias("line"), F.lit(None).cast("string").alias("heading"))).alias("out")).cast(_STATE)

    def step(a: Column, x: Column) -> Column:
        m = opens(x["l"])
        fence = F.when(a["fence"] == m, F.lit(None).cast("string")).otherwise(F.coalesce(a["fence"], m))
        head = F.regexp_extract(x["l"], r"^#{1,6}\s+(.+)$", 1)
        new = F.struct(a["fence"].alias("fence"), F.concat(a["out"], F.array(F.struct(x["i"].alias("line"), F.trim(head).alias("heading")))).alias("out")).cast(_STATE)
        return F.when(m.isNotNull(), F.struct(fence.alias("fence"), a["out"].alias("out")).cast(_STATE)).when(a["fence"].isNull() & (head != ""), new).otherwise(a)

    # only lines that look like a heading or a fence are walked
    marked = F.filter(F.transform(F.col("_lines"), lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda x: x["l"].rlike(r"^(#{1,6}\s+.+|\s*(```|~~~).*)$"))
    d = df.withColumn("_lines", lines).withColumn("_cuts", F.aggregate(marked, zero, step)["out"])
    d = d.select(*df.columns, "_lines", "_cuts", F.posexplode("_cuts").alias("section", "_c"))
    end = F.coalesce(F.get("_cuts", F.col("section") + 1)["line"], F.size("_lines"))
    d = d.withColumn("heading", F.col("_c.heading")).withColumn("start_line", F.col("_c.line") + 1).withColumn("end_line", end)
    d = d.withColumn("body", F.regexp_replace(F.array_join(F.slice("_lines", F.col("start_line"), F.greatest(end - F.col("_c.line"), F.lit(0))), "\n"), r"^\s+|\s+$", ""))
    return d.where(F.col("body").rlike(r"\S")).drop("_lines", "_cuts", "_c")


def chunks(docs: DataFrame, task: str, path: str = "path", text: str = "text", kind: str = "documentation") -> DataFrame:
    """Chunks of markdown by section and of other files as a whole, with relevance and estimated tokens."""
    md = F.lower(path).endswith(".md")
    s = sections(docs.where(md), text).select(path, "heading", "start_line", "end_line", F.col("body").alias("text"))
    w = docs.where(~md).select(path, F.lit(None).cast("string").alias("heading"), F.lit(1).alias("start_line"), line_count(F.col(text)).cast("int").alias("end_line"), F.col(text).alias("text"))
    d = s.unionByName(w)
    id_ = F.concat(F.lit(f"{kind}:"), F.col(path), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return d.withColumn("id", id_).withColumn("relevance_score", relevance(F.concat_ws(" ", path, "heading", "text"), task)).withColumn("estimated_tokens", token_estimate(F.col("text")))


def item_priority(target: Column, test: Column, score: Column, distance: Column) -> Column:
    """Order of optional code: targets, then tests, then the rest by distance, ten at most."""
    d = F.least(F.lit(10), distance)
    return F.when(target, 4000 + score).when(test, 3000 - d).otherwise(2000 - d)


def seeds(df: DataFrame, most: int, keys: list[str] | None = None) -> DataFrame:
    """The best `most` rows (file_path, start_off, end_off, score, id) of which none contains another; no keys: over all files.

    A row that a better one of its file contains or is contained by is passed over.
    Of a file's rows, `most` taken ones decide, so each file gives `most` rows and
    those of all files are cut again: nothing but the best is sorted as a whole.
    """
    import pandas as pd

    def take(it):
        now, taken = None, []
        for b in it:
            keep = []
            for f, s, e, score in zip(b["file_path"], b["start_off"], b["end_off"], b["score"]):
                if f != now:
                    now, taken = f, []
                ok = score > 0 and len(taken) < most and not any(s <= x and y <= e or x <= s and e <= y for x, y in taken)
                if ok:
                    taken.append((s, e))
                keep.append(ok)
            yield b[pd.Series(keep, index=b.index, dtype=bool)]

    d = df.repartition("file_path").sortWithinPartitions("file_path", F.desc("score"), "id").mapInPandas(take, df.schema)
    return d.orderBy(F.desc("score"), "id").limit(most)


def pack(items: DataFrame, keys: list[str], budget: int, cost: str = "estimated_tokens", priority: str = "priority", id_: str = "id") -> DataFrame:
    """Optional items by priority, each taken if it still fits."""
    return packed(items.withColumn("_o", -F.col(priority)), keys, ["_o", id_], cost, budget).drop("_o")
