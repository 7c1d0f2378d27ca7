"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole.  The bytes that each token stands for give
its place in the text, and every section gets the tokens whose deciding byte lies
in it.  A token that crosses a boundary is thus counted once for sections that
share the boundary, by one of three rules: its "first", "middle" or "last" byte
decides.  Sections may leave gaps, overlap or nest; each is a binary search over
the sorted token places, so no pairs of tokens and sections are formed.

Sections are given in code points, `end` exclusive.  Defined results: a null text is
empty; sections of a null array give no rows; empty sections have no tokens; parts
beyond the text are cut off; repeated rows give their rows again; empty tables give
empty results; columns other than those named are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import safe_id
from graphloom.llm.tokenizer import default_path, encoder

RULES = ("first", "middle", "last")
COUNTS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def byte_places(text: str) -> np.ndarray | None:
    """Byte offset of each code point and of the end; None where they are the same numbers."""
    if text.isascii():
        return None
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


def attribute(ids: np.ndarray, lengths: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [start, end) in bytes, and how many of the text's tokens cross its end."""
    stop = np.cumsum(lengths[ids])
    first = stop - lengths[ids]
    at = {"first": first, "middle": (first + stop - 1) // 2, "last": stop - 1}[rule]
    n = np.maximum(np.searchsorted(at, end) - np.searchsorted(at, start), 0)
    # the one token with first < end < stop
    crossing = np.searchsorted(first, end) - np.searchsorted(stop, end, side="right")
    return n, crossing


def section_tokens(df: DataFrame, rule: str = "first", key: str = "doc_id", text: str = "text", sections: str | None = None, path: str | None = None) -> DataFrame:
    """One row per section: `sections` names a column of array<struct<start, end>>; lines are taken where it is None."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or default_path()
    cols = [safe_id(F.col(key)).alias("doc_id"), F.col(text).alias("text")]
    if sections is not None:
        cols += [F.col(sections)["start"].cast("array<bigint>").alias("s"), F.col(sections)["end"].cast("array<bigint>").alias("e")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            out = []
            given = zip(b["s"].tolist(), b["e"].tolist()) if sections is not None else ((None, None) for _ in range(len(b)))
            for doc, t, (s, e) in zip(b["doc_id"].tolist(), b["text"].tolist(), given):
                t = t or ""
                if sections is None:
                    s = np.cumsum([0, *(len(x) + 1 for x in t.split("\n")[:-1])])
                    e = np.append(s[1:], len(t))
                elif s is None or e is None:
                    continue
                s, e = (np.clip(np.asarray(x, np.int64), 0, len(t)) for x in (s, e))
                place = byte_places(t)
                bs, be = (s, e) if place is None else (place[s], place[e])
                n, crossing = attribute(enc.ids(t), enc.byte_lengths, bs, be, rule)
                out.append((np.full(len(s), doc), np.arange(len(s), dtype=np.int32), s, e, n, crossing))
            if out:
                yield pd.DataFrame(dict(zip(("doc_id", "section", "start", "end", "n_tokens", "n_crossing"), map(np.concatenate, zip(*out)))))

    return df.select(*cols).mapInPandas(count, COUNTS)
