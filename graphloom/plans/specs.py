"""Document transformations: roll-ups, pivots, hierarchies, differences, merges, redaction, reconciliation.

Money comes as whole cents, so sums do not depend on the order of rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordered import running_sum


def cents(x: Column) -> Column:
    """Whole cents of a double, halves up."""
    return F.floor(x * 100 + 0.5).cast("long")


def summarize(lines: DataFrame, by: list[str]) -> DataFrame:
    """Orders, items, gross, discounts and net per group, from (order, quantity, gross, discount)."""
    return lines.groupBy(*by).agg(
        F.count_distinct("order").alias("order_count"),
        F.sum("quantity").cast("long").alias("item_count"),
        F.sum("gross").alias("gross"),
        F.sum("discount").alias("discounts"),
        F.sum(F.col("gross") - F.col("discount")).alias("net"),
    )


def pivoted(events: DataFrame, by: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """Total and count per group, and both for each of the given kinds; one aggregation."""
    each = [x for k in kinds for x in (F.count_if(F.col(kind) == k).alias(f"{k}_count"), F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(value))), F.lit(0)).alias(f"{k}_value"))]
    return events.groupBy(*by).agg(F.sum(value).alias("total_value"), F.count("*").alias("event_count"), *each)


def balances(moves: DataFrame, keys: list[str], day: str, quantity: str) -> DataFrame:
    """(keys, day, delta, movement_count, balance): movements summed by day first, then a running sum over days."""
    d = moves.groupBy(*keys, day).agg(F.sum(quantity).alias("delta"), F.count("*").alias("movement_count"))
    return running_sum(d, keys, day, "delta", "balance")


def reconciled(a: DataFrame, b: DataFrame, key: str, amount: str, tolerance: int) -> DataFrame:
    """(key, primary, secondary, difference, status) of two ledgers; amounts alike within the tolerance match."""
    x = a.select(key, F.col(amount).alias("primary_amount")).join(b.select(key, F.col(amount).alias("secondary_amount")), key, "full_outer")
    diff = F.col("primary_amount") - F.col("secondary_amount")
    status = F.when(F.col("primary_amount").isNull(), "missing_in_primary").when(F.col("secondary_amount").isNull(), "missing_in_secondary").when(F.abs(diff) <= tolerance, "match").otherwise("mismatch")
    return x.select(key, "primary_amount", "secondary_amount", diff.alias("difference"), status.alias("status"))


# --- JSON ----------------------------------------------------------------


def leaves(value, path: str = "") -> Iterator[tuple[str, object]]:
    """Paths and values of a JSON value's leaves; empty arrays and objects are leaves."""
    stack = [(path, value)]
    while stack:
        p, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [(f"{p}.{k}" if p else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            stack += [(f"{p}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield p, v


def _kind(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def flattened(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, type, value) of every leaf of JSON texts, values as JSON; texts that are no JSON give no rows.

    JSON nests without bound, which no fixed schema follows: a function over batches.
    """
    kind = df.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                try:
                    v = json.loads(t) if t is not None else None
                except ValueError:
                    continue
                if t is not None:
                    out += [(k, p, _kind(x), json.dumps(x, ensure_ascii=False, separators=(",", ":"))) for p, x in leaves(v)]
            yield pd.DataFrame(out, columns=[key, "path", "type", "value"])

    return df.select(key, text).mapInPandas(walk, f"`{key}` {kind}, path string, type string, value string")


def deep_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path, before, after, change) from leaves of two states; a full outer join on key and path."""
    a, b = before.select(key, "path", F.col("value").alias("before")), after.select(key, "path", F.col("value").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("unchanged")
    return a.join(b, [key, "path"], "full_outer").withColumn("change", change)


def redact_json(df: DataFrame, text: str, exact: list[str], keys: str, replacement: str = "[redacted]") -> DataFrame:
    """JSON texts with leaves replaced whose path is listed, whose key matches, or that look like e-mail."""
    key, mail = re.compile(keys, re.I) if keys else None, re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+")

    def clean(v, path, name):
        if isinstance(v, dict):
            return {k: clean(x, f"{path}.{k}" if path else k, k) for k, x in v.items()}
        if isinstance(v, list):
            return [clean(x, f"{path}[{i}]", name) for i, x in enumerate(v)]
        hit = path in exact or key is not None and name and key.search(name) or isinstance(v, str) and mail.fullmatch(v)
        return replacement if hit else v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{text: [None if t is None else json.dumps(clean(json.loads(t), "", ""), ensure_ascii=False) for t in b[text]]})

    return df.mapInPandas(run, df.schema)


#: Texts that look like e-mail addresses.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def redact_mail(text: Column, replacement: str = "[redacted]") -> Column:
    return F.regexp_replace(text, MAIL, replacement)


def schema_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, type, required, enum, default, description) of JSON schemas, the root as `$`."""
    kind = df.schema[key].dataType.simpleString()
    cols = [key, "path", "type", "required", "enum", "default", "description"]

    def rows(s: dict, path: str, required: bool):
        dump = lambda x: None if x is None else json.dumps(x, separators=(",", ":"))
        yield path, s.get("type"), required, dump(s.get("enum")), dump(s.get("default")), s.get("description")
        need = set(s.get("required", ()))
        for k, x in s.get("properties", {}).items():
            yield from rows(x, f"{path}.{k}", k in need)
        if isinstance(s.get("items"), dict):
            yield from rows(s["items"], f"{path}[]", False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(b[key], b[text]) for r in rows(json.loads(t), "$", True)], columns=cols)

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, path string, type string, required boolean, enum string, default string, description string")


def merged(records: DataFrame, user: str, rank: str, scalars: list[str], roles: str) -> DataFrame:
    """One profile per user: scalars from the first source that has them, roles united in source order, sources, and fields in conflict.

    A field is in conflict if sources give different values, roles if their lists differ.
    """
    pick = [F.min(F.when(F.col(c).isNotNull(), F.struct(rank, c)))[c].alias(c) for c in scalars]
    differ = sum(((F.min(c) != F.max(c)).cast("int") for c in scalars), F.lit(0))
    texts = F.array_join(F.array_sort(roles), ",")
    every = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(roles).alias("r"))))
    return records.groupBy(user).agg(
        *pick,
        F.array_distinct(F.flatten(F.transform(every, lambda x: x["r"]))).alias(roles),
        F.transform(every, lambda x: x[rank]).alias("sources"),
        (F.coalesce(differ, F.lit(0)) + (F.min(texts) != F.max(texts)).cast("int")).alias("conflict_count"),
    )
