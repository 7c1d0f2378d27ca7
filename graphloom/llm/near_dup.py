"""Near-duplicate groups by MinHash bands, odd sketches and full sets.

1. One pass over the texts gives each a shingle set, MinHash samples, band keys
   and an odd sketch: the samples folded into a bitmap of parities.  Of two
   bitmaps, the bits that differ tell how many samples differ.
2. Texts with equal sets are one class; its smallest id goes on for all of them.
3. Classes that share a band are candidates.  Each band's bucket has a pivot, its
   smallest id, and every member is a row of that pivot's group, so pairs are
   never written out: two members of one bucket meet in its pivot's group.
4. A group compares its members with the pivot on full sets.  Members that this
   leaves apart are compared with all others: sizes and odd sketches rule out most
   pairs, full sets decide the rest.  A group gives a spanning forest of its links.
   A group whose sets are too large for one task is dealt over chunks; members
   left apart then meet every chunk in turn.  Nothing is capped or dropped.
5. Connected components of the links give the smallest id reachable.

With 128 samples in 32 bands, a pair at the threshold 0.8 shares no band with
probability 5e-8, and its odd sketch fails the test with less than 1e-6.

Defined results: texts without words are linked with nothing; rows with equal ids
are one document if their texts are equal, and several if not; a null id sorts
first and stays null, and null ids are told apart by their texts like any other;
empty tables give empty results; other columns pass through `keep_one`, which keeps
one row of a group, any one of those that repeat both id and text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, dealt, map_rows
from graphloom.llm.components import components
from graphloom.llm.minhash import bands, odd_sketch, samples, shingles

NO_ID = -(2**63)
SHINGLE, THRESHOLD = 5, 80
BANDS, ROWS, BITS = 32, 4, 512
#: Shingles of one chunk of a group, about 100 MB with its index.
CHUNK = 2_000_000
#: The sketch's estimate falls short of a similarity of 0.8 by this much with less than 1e-6.
SLACK = 0.2

SIGNATURE = "id long, h long, n long, digest binary, keys array<long>, sketch binary"


def signatures(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """One row per text: id, a hash of the text, size and digest of its shingle set, band keys, odd sketch."""

    def make():
        import xxhash

        def sign(i: int, h: int, t: str | None) -> Iterator[tuple]:
            s = shingles(t, n)
            m = samples(s, BANDS * ROWS)
            yield i, h, len(s), xxhash.xxh3_128_digest(s.tobytes()), bands(m, ROWS).tolist() if len(s) else [], odd_sketch(m, BITS)

        return sign

    d = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return map_rows(d, make, SIGNATURE)


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities that odd sketches (rows of 64-bit words) estimate."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1)
    share = np.minimum(2.0 * differ / BITS, 0.999999)
    return 1 + BITS / 2 * np.log1p(-share) / (2 * BANDS * ROWS)


def named(sig: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Signatures with a long v for each document (id, h), in the order of documents, and the table of names.

    Where an id has one text alone, it is the name.  Else documents are numbered in
    ranges of (id, h): a number tells range and place there, so it needs no counting.
    """
    several = sig.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi")
    if not several.limit(1).count():
        return sig.withColumn("v", F.col("id")), None
    names = sig.select("id", "h").distinct().repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    names = checkpoint(names.select("id", "h", F.monotonically_increasing_id().alias("v")))
    return sig.join(names, ["id", "h"]), names


class Sets:
    """Members of a group with their sets, and an index from shingle to members."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], sketches: list[bytes]):
        self.ids, self.sets = ids, sets
        self.n = np.array([len(s) for s in sets])
        self.sketch = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(ids), -1)
        self._index = None

    def shared(self, s: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with all members' sets."""
        if self._index is None:
            flat = np.concatenate(self.sets)
            who = np.repeat(np.arange(len(self.sets)), self.n)
            order = np.argsort(flat, kind="stable")
            values, first = np.unique(flat[order], return_index=True)
            self._index = values, np.append(first, len(flat)), who[order]
        values, first, who = self._index
        at = np.searchsorted(values, s)
        at = at[np.append(values, values[-1:])[at] == s] if len(values) else at[:0]
        at = at[at < len(values)]
        start, count = first[at], first[at + 1] - first[at]
        if not len(at):
            return np.zeros(len(self.ids), np.int64)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        return np.bincount(who[place], minlength=len(self.ids))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        both = self.shared(s)
        return 100 * both >= percent * (self.n + len(s) - both)

    def possible(self, n: int, sketch: np.ndarray, percent: int) -> np.ndarray:
        """Members that sizes and sketches do not rule out."""
        sizes = 100 * np.minimum(self.n, n) >= percent * np.maximum(self.n, n)
        return sizes & (similar(self.sketch, sketch) >= percent / 100 - SLACK)


class Forest(dict):
    def find(self, x):
        while (y := self.get(x, x)) != x:
            self[x] = self.get(y, y)
            x = self[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def group_links(pivot: int, g: Sets, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of a group's links; which members hang together with the pivot directly."""
    p = g.ids.index(pivot)
    near = g.linked(g.sets[p], percent)
    near[p] = True
    links, tree = [], Forest()
    for i in np.flatnonzero(near).tolist():
        if i != p and tree.join(p, i):
            links.append((pivot, g.ids[i]))
    for i in np.flatnonzero(~near).tolist():
        maybe = g.possible(g.n[i], g.sketch[i], percent)
        maybe[i] = False
        maybe &= ~near | (tree.find(i) != tree.find(p))
        if maybe.any():
            for j in np.flatnonzero(maybe & g.linked(g.sets[i], percent)).tolist():
                if tree.join(i, j):
                    links.append((g.ids[i], g.ids[j]))
    return links, near


def _groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal keys; rows come sorted, and one run is held at a time."""
    rows = itertools.chain.from_iterable(b.itertuples(index=False, name=None) for b in batches)
    for k, run in itertools.groupby(rows, key=lambda r: r[: len(keys)]):
        yield k, [r[len(keys) :] for r in run]


def _sets(rows: list[tuple]) -> Sets:
    return Sets([r[0] for r in rows], [np.frombuffer(r[2], np.uint64) for r in rows], [r[1] for r in rows])


OUT = "p long, nc int, a long, b long, near boolean, sketch binary, s binary"


def links(df: DataFrame, sig: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(a, b): links by names v whose components are those of all links between classes."""
    reps = sig.where("n > 0").groupBy("digest").agg(F.min(F.struct("v", "id", "h")).alias("r"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    reps = reps.select("r.v", "r.id", "r.h", "n", "keys", "sketch")
    hits = reps.select(F.explode("keys").alias("k"), "v")
    pivots = hits.groupBy("k").agg(F.min("v").alias("p"), F.max("v").alias("hi")).where("p < hi").select("k", "p")
    star = hits.join(*dealt(hits, pivots, "k")).select("p", "v").distinct()
    star = checkpoint(star)
    # at most one pivot per band and document
    size = reps.select("v", "n").join(star, "v").groupBy("p").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("nc"))
    rows = reps.select("v", "id", "h", "n", "sketch").join(star, "v")
    rows = rows.join(*dealt(rows, size, "p"))
    chunks = F.when(F.col("v") == F.col("p"), F.sequence(F.lit(0), F.col("nc") - 1)).otherwise(F.array(F.pmod(F.xxhash64("v"), F.col("nc")).cast("int")))
    wanted = rows.groupBy("id", "h").agg(F.first("v").alias("v"), F.first("sketch").alias("sketch"), F.collect_list(F.struct("p", "nc", chunks.alias("cs"))).alias("at"))
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    wanted = docs.join(wanted, ["id", "h"]).select("v", "text", "sketch", "at")

    def make():
        def shingle(v: int, t: str | None, sk: bytes, at: list[dict]) -> Iterator[tuple]:
            s = shingles(t, n).tobytes()
            for x in at:
                for c in x["cs"]:
                    yield x["p"], c, x["nc"], v, sk, s

        return shingle

    members = map_rows(wanted, make, "p long, c int, nc int, id long, sketch binary, s binary")
    members = members.repartition(F.col("p"), F.col("c")).sortWithinPartitions("p", "c", "id")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (p, _, nc), run in _groups(batches, ["p", "c", "nc"]):
            run = [r for k, r in enumerate(run) if not k or r[0] != run[k - 1][0]]  # repeated rows of one document
            g = _sets(run)
            found, near = group_links(p, g, percent)
            out = [(p, nc, a, b, None, None, None) for a, b in found]
            if nc > 1:  # other chunks have members that these have not met
                out += [(p, nc, r[0], None, bool(x), r[1], r[2]) for r, x in zip(run, near.tolist()) if r[0] != p]
            if out:
                yield pd.DataFrame(out, columns=["p", "nc", "a", "b", "near", "sketch", "s"])

    one = checkpoint(members.select("p", "c", "nc", "id", "sketch", "s").mapInPandas(within, OUT))
    apart = one.where("near = false")
    chunks_of = apart.groupBy("p").agg(F.ceil(F.sum(F.length("s")) / (8 * CHUNK)).cast("int").alias("nl"))
    left = apart.select("p", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("c"), "nc", F.col("a").alias("id"), "sketch", "s")
    left = left.join(chunks_of, "p").select("p", "c", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nl")).cast("int").alias("l"), F.lit(True).alias("asks"), F.lit(False).alias("near"), "id", "sketch", "s")
    right = one.where("near is not null").join(chunks_of, "p")
    right = right.select("p", F.pmod(F.xxhash64("a"), F.col("nc")).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"), F.lit(False).alias("asks"), "near", F.col("a").alias("id"), "sketch", "s")
    blocks = left.unionByName(right).repartition(F.col("p"), F.col("c"), F.col("l")).sortWithinPartitions("p", "c", "l", "asks", "id")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (p, _, _), run in _groups(batches, ["p", "c", "l"]):
            there, asks = [r for r in run if not r[0]], [r for r in run if r[0]]
            if not there or not asks:
                continue
            g, tree, out = _sets([r[2:] for r in there]), Forest(), []
            for r in there:
                if r[1]:
                    tree.join(p, r[2])
            for i, sk, s in (r[2:] for r in asks):
                s = np.frombuffer(s, np.uint64)
                maybe = g.possible(len(s), np.frombuffer(sk, np.uint64), percent)
                if maybe.any():
                    for j in np.flatnonzero(maybe & g.linked(s, percent)).tolist():
                        if g.ids[j] != i and tree.join(i, g.ids[j]):
                            out.append((i, g.ids[j]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    two = blocks.mapInPandas(across, "a long, b long")
    return one.where("b is not null").select("a", "b").unionByName(two)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """(id, h, n, component, first) per row.

    h is a hash of its text; a null key is NO_ID; component is the smallest id of the
    row's group; of the documents (id, h) of a group, one is `first`.
    """
    sig, names = named(checkpoint(signatures(df, key, text, shingle)))
    comp = components(links(df, sig, key, text, shingle, percent))
    rep = sig.where("n > 0").groupBy("digest").agg(F.min("v").alias("rep"))
    d = sig.select("id", "h", "v", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    d = d.join(*dealt(d, rep, "digest"), "left")
    d = d.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    d = d.select("id", "h", "v", "n", F.coalesce("component", "rep", "v").alias("w"))
    if names is None:
        d = d.withColumn("component", F.col("w"))
    else:
        d = d.join(*dealt(d, names.select(F.col("v").alias("w"), F.col("id").alias("component")), "w"))
    return d.select("id", "h", "n", "component", (F.col("v") == F.col("w")).alias("first"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """One of the input's rows for each group: that of the smallest id, and of its smallest text hash."""
    g = groups(df, key, text, shingle, percent).where("first").groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg((F.count("*") > 1).alias("_more"))
    g = checkpoint(g)
    cols = df.columns
    d = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    k, t = f"c{cols.index(key)}", f"c{cols.index(text)}"
    d = d.withColumn("_k", F.coalesce(F.col(k).cast("long"), F.lit(NO_ID))).withColumn("_x", F.xxhash64(t))
    of = lambda more: d.join(g.where(F.col("_more") == more), (F.col("_k") == F.col("_id")) & (F.col("_x") == F.col("_h")), "left_semi")
    out = of(False)
    if g.where("_more").limit(1).count():  # rows that repeat id and text are combined before they are dealt
        out = out.unionByName(of(True).dropDuplicates(["_k", "_x"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
