"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Documents are encoded whole, end with an end token, and only those longer than a
sequence are cut: into full pieces, after a first one that takes what is left over.
Then each piece goes where the sum over gaps g of (open sequences with gap g)**2
becomes smallest, long pieces first.  A new sequence is opened only where no open
one has room: letting the sum decide that too took 1 % more sequences on the test
corpus (4511 for 4464 full ones, against 4465).

That rule looks at lengths only, so it runs on the counts of pieces by length, at
most `capacity` numbers whatever the corpus.  Of N pieces, every K-th makes one
batch of about `batch` pieces; that is packed once, on the driver, and stands for
K equal batches.  What does not divide by K is packed the same way.  Pieces learn
their rank among pieces of their length through a two-step count, and look up the
slot of that rank: the result does not depend on how rows are partitioned.

Memory: a worker holds an Arrow batch of texts, its encoder's bounded table and the
slots (at most a few times `batch`); the driver holds the counts and the slots.

Defined results: null and empty texts are the end token alone; repeated rows are
pieces of their own; empty tables give empty results; columns other than the key
and the text are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, map_rows, own_id, safe_id
from graphloom.llm.tokenizer import default_path, encoder

CAPACITY, END_ID = 1024, 2
#: Pieces of a batch that the driver packs; bounds what workers are sent.
BATCH = 150_000
#: Pieces numbered by one task, on average.
RANKED = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n - (max(1, -(-n // capacity)) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), in one pass over the texts; a null key is the smallest long."""
    path = path or default_path()

    def make():
        enc, end = encoder(path), np.array([end_id], "<u4")

        def encode(doc: int, t: str | None) -> Iterator[tuple]:
            ids = np.concatenate([enc.ids(t or ""), end])
            for k, (s, n) in enumerate(cut(len(ids), capacity)):
                yield doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())

        return encode

    return map_rows(df.select(safe_id(F.col(key)).alias("doc_id"), F.col(text).alias("text")), make, PIECES)


def sum_of_squares(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """Pack counts[s] pieces of each length s, long ones first.

    Returns per length the (bin, offset) rows of its pieces, and the number of bins.
    """
    open_ = np.zeros(capacity + 1, np.int64)  # bins by gap; full ones don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, slots = 0, {}
    for s in np.flatnonzero(counts)[::-1].tolist():
        rows = np.empty((int(counts[s]), 2), np.int64)
        for k in range(len(rows)):
            here = open_[s:capacity]
            at = capacity
            if here.any():
                change = open_[: capacity - s] - here
                change = 2 * change + 2
                change[0] -= 1  # a filled bin leaves the sum
                change[here == 0] = np.iinfo(np.int64).max
                at = s + int(change.argmin())
            if at == capacity:
                b, bins = bins, bins + 1
            else:
                b = stacks[at].pop()
                open_[at] -= 1
            rows[k] = b, capacity - at
            if at > s:
                stacks[at - s].append(b)
                open_[at - s] += 1
        slots[s] = rows
    return slots, bins


class Plan:
    """Slots of all pieces shorter than a sequence, by length and rank."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, batch: int = BATCH):
        left = np.zeros(capacity + 1, np.int64)
        for s, n in counts.items():
            left[s] = n
        left[capacity] = 0  # full pieces are sequences of their own
        self.levels, self.sequences = [], 0
        done = np.zeros_like(left)
        while total := int(left.sum()):
            k = max(1, -(-total // batch))
            part = left // k
            if not part.any():  # fewer of each length than batches
                k, part = int(left[left > 0].min()), (left > 0).astype(np.int64)
            slots, bins = sum_of_squares(part, capacity)
            first = np.zeros(capacity + 2, np.int64)
            first[1:] = np.cumsum(part)
            table = np.concatenate([slots[s] for s in sorted(slots)]).astype(np.int64)
            # rank range of this level per length, batches, first sequence, slots
            self.levels.append((done.copy(), part * k, k, self.sequences, first, table[:, 0], table[:, 1].astype(np.int32)))
            self.sequences += bins * k
            done += part * k
            left -= part * k

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        for done, n, k, base, first, bin_, at in self.levels:
            r = rank - done[length]
            own = (r >= 0) & (r < n[length])
            slot = first[length[own]] + r[own] // k
            seq[own] = base + bin_[slot] * k + r[own] % k
            off[own] = at[slot]
        return seq, off


def ranked(p: DataFrame, buckets: int) -> DataFrame:
    """Add `rank` from 0 among pieces of the same length, in no task more than a bucket's rows of one length."""
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    c = p.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    c = c.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return p.join(c, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1).drop("before", "bucket")


def pack(p: DataFrame, capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """Add sequence_id and offset to rows of `pieces`."""
    p = checkpoint(p)
    counts = {int(s): int(n) for s, n in p.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity, batch)
    short = ranked(p.where(F.col("length") < capacity), max(1, -(-sum(counts.values()) // RANKED)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seq, off = plan.find(b["length"].to_numpy(), b["rank"].to_numpy())
            yield b.drop(columns="rank").assign(sequence_id=seq, offset=off)

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = short.select(*cols, "rank").mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
    full = p.where(F.col("length") == capacity).select(*cols, (F.lit(plan.sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).withColumn("doc_id", own_id(F.col("doc_id")))
