"""Personal data: fixed expressions, and identifiers found by bootstrapped contexts.

1. One pass finds the expressions' matches (the seeds) and the lexical patterns
   around them: one or two words before, one or two after, one on either side, with
   the ends of the line.  Patterns that enough different seeds share are tried.
2. A second pass counts how often each tried pattern stands anywhere, whatever is in
   its slot.  Patterns with few seeds among all that are dropped: they are prose.
3. For the rest, patterns and the instances in their slots form a graph.  A pattern's
   confidence is the share of its occurrences whose instance is known, an instance is
   known if it is a seed or has a pattern of high confidence.  Spark scores both in
   turn until no pattern is added.
4. What stands in the slot of a confident pattern is added as a span of kind `found`:
   any token, or up to `RUN` tokens between two words.  Form only raises the bar: a
   plain lower-case word needs two such patterns.
5. The contexts of what was found are patterns to try again, until there are no new ones.

A pattern needs `SHARE` of all different known instances, `LEAST` at least, and an
instance gives five patterns; so no more than 5 / `SHARE` patterns are ever tried
(10,000), whatever the corpus, and they go to every task.  All else stays in tables,
summed up before shuffles: a hot pattern is a few rows per task.

Texts are read by linear scans only; a text of any length is scanned whole.

Defined results: a null text is empty; repeated rows count again and give their
rows again; an empty table gives an empty result; columns other than the key and
the text are not used.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SLICE, checkpoint, map_rows, own_id, safe_id
from graphloom.llm.spans import digest, matches, written


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(s: str) -> bool:
    d = [int(c) for c in _digits(s)][::-1]
    return sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")


def _mails(text: str) -> list[tuple[int, int]]:
    """Matches of `[local]+@[domain]+(.[domain]+)+`, from each @ to either side: no run is read twice."""
    out, last, at = [], 0, text.find("@")
    before = 0
    while at >= 0:
        own = text[max(before, last) : at]
        start = at - len(own) + len(own.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at)):
            last = m.end()
            out.append((start, last))
        before, at = at + 1, text.find("@", max(at + 1, last))
    return out


BASE = {
    "email": ("@", _mails, None),
    # a run of digits that fails from its first digit fails from the others too
    "ip": (".", re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"), lambda m: all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))),
    "card": ("", re.compile(r"[0-9](?:[\x20-]?[0-9])+"), lambda m: 12 <= len(_digits(m[0])) <= 19 and luhn(m[0])),
    "phone": ("+", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(_digits(m[0])) <= 15),
}
KINDS = [*BASE, "found"]
#: Least confidence of a pattern; share of known instances, and number of them, that it must have; least share of seeds among all occurrences for it to be scored.
CONFIDENCE, SHARE, LEAST, PROMISING = 0.9, 1 / 2000, 5, 0.3
#: Tokens that a slot between two words holds at most, and characters read on either side of a seed.
RUN, NEAR = 6, 256

_TOKEN = re.compile(r"\n|[^\x20\x09-\x0D:=]*[:=]+|[^\x20\x09-\x0D:=]+")
_EDGE = ".,;!?()[]{}<>\"'`"


def _word(token: str) -> str:
    return token.strip(_EDGE).lower() or token


def _beside(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Whole words of the line before and after a span, with ^ and $ where the line ends; none where a token goes on beside the span."""
    left, right = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    cut_l, cut_r = start > NEAR, end + NEAR < len(text)
    if (k := left.rfind("\n")) >= 0:
        left, cut_l = left[k + 1 :], False
    if (k := right.find("\n")) >= 0:
        right, cut_r = right[:k], False
    a, b = _TOKEN.findall(left), _TOKEN.findall(right)
    if a and left[-1:] not in "\x20\t\x0b\x0c\r:=":
        a = [] if a[-1].strip(_EDGE) else [*a[:-1], ""]
    elif a:
        a.append("")
    if b and right[0] not in "\x20\t\x0b\x0c\r":
        b = [] if b[0].strip(_EDGE) else ["", *b[1:]]
    elif b:
        b.insert(0, "")
    glued_l, glued_r = not a and bool(left.strip(_EDGE + "\x20\t\x0b\x0c\r")), not b and bool(right.strip(_EDGE + "\x20\t\x0b\x0c\r"))
    a, b = [_word(x) for x in a[:-1]], [_word(x) for x in b[1:]]
    a, b = a[1:] if cut_l else ["^", *a], b[:-1] if cut_r else [*b, "$"]
    return [] if glued_l else a[-2:], [] if glued_r else b[:2]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: whole words within its line, in lower case, `^` and `$` where the line ends.

    One word or two before, one or two after, one on either side; the line's end alone is no pattern.
    """
    left, right = _beside(text, start, end)
    b, c = left[-1:] if left[-1:] != ["^"] else [], right[:1] if right[:1] != ["$"] else []
    out = []
    if b:
        out.append(f"{b[0]} _")
        if len(left) == 2:
            out.append(f"{left[0]} {b[0]} _")
    if c:
        out.append(f"_ {c[0]}")
        if len(right) == 2:
            out.append(f"_ {c[0]} {right[1]}")
    if b and c and len(_TOKEN.findall(text[start : min(end, start + NEAR)])) <= RUN:
        out.append(f"{b[0]} _ {c[0]}")
    return out


class Patterns:
    """Tried patterns by the word next to their slot."""

    def __init__(self, known: Iterable[str]):
        self.left: dict[str, tuple[str | None, dict, dict]] = {}
        self.right: dict[str, tuple[str | None, dict]] = {}
        for p in known:
            before, after = (x.split() for x in f" {p} ".split(" _ ", 1))
            if before:
                one, two, both = self.left.get(before[-1], (None, {}, {}))
                if after:
                    both[after[0]] = p
                elif len(before) == 2:
                    two[before[0]] = p
                else:
                    one = p
                self.left[before[-1]] = one, two, both
            else:
                one, two = self.right.get(after[0], (None, {}))
                if len(after) == 2:
                    two[after[1]] = p
                else:
                    one = p
                self.right[after[0]] = one, two
        self.heads = frozenset(self.left) | frozenset(self.right)

    def slots(self, w: list[str]) -> Iterator[tuple[str, int, int]]:
        """(pattern, first, last token in its slot) for every place where a pattern stands."""
        heads, n = self.heads, len(w)
        for i in [i for i, x in enumerate(w) if x in heads]:
            if (x := self.left.get(w[i])) and i + 1 < n and w[i + 1] != "\n":
                one, two, both = x
                if one:
                    yield one, i + 1, i + 1
                if two and (p := two.get("^" if not i or w[i - 1] == "\n" else w[i - 1])):
                    yield p, i + 1, i + 1
                if both:
                    open_ = dict(both)
                    for j in range(i + 2, min(i + 2 + RUN, n)):
                        if w[j] == "\n":
                            break
                        if p := open_.pop(w[j], None):
                            yield p, i + 1, j - 1
            if (x := self.right.get(w[i])) and i and w[i - 1] != "\n":
                one, two = x
                if one:
                    yield one, i - 1, i - 1
                if two and (p := two.get("$" if i + 1 == n or w[i + 1] == "\n" else w[i + 1])):
                    yield p, i - 1, i - 1


def instance(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.lower()) - 2**63


SEEN = "doc_id long, h long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, seen array<struct<i:bigint,p:array<string>>>"
SLOTS = "doc_id long, h long, s int, e int, seed boolean, plain boolean, i long, p string, near array<string>"


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(safe_id(F.col(key)).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row the figures of the expressions' matches, and the patterns of each."""

    def make():
        def look(i: int, h: int, t: str | None) -> Iterator[tuple]:
            t = t or ""
            base = matches(t, BASE)
            n = Counter(k for k, _, _ in base)
            seen = [{"i": instance(t[s:e]), "p": patterns(t, s, e)} for _, s, e in base]
            yield i, h, n["email"], n["ip"], n["card"], n["phone"], digest(base, KINDS), written(base, KINDS), seen

        return look

    return map_rows(_texts(df, key, text), make, SEEN)


def occurrences(df: DataFrame, text: str, tried: list[str]) -> DataFrame:
    """(p, n): how often each tried pattern stands in the corpus, summed up in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Patterns(tried), Counter()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                for t in b.slice(i, SLICE).column(0).to_pylist():
                    if t:
                        n.update(p for p, _, _ in known.slots([x.strip(_EDGE) or x for x in _TOKEN.findall(t.lower())]))
        yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], names=["p", "n"])

    return df.select(F.col(text)).mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def filled(df: DataFrame, key: str, text: str, tried: list[str]) -> DataFrame:
    """What stands in the slots of the patterns, with the patterns around it."""

    def make():
        known = Patterns(tried)

        def look(i: int, h: int, t: str | None) -> Iterator[tuple]:
            spots = [m.span() for m in _TOKEN.finditer(t or "")]
            slots = [*known.slots([_word(t[s:e]) for s, e in spots])]
            if not slots:
                return
            base = sorted((s, e) for _, s, e in matches(t, BASE))
            starts = [s for s, _ in base]
            reach = [*itertools.accumulate((e for _, e in base), max)]
            for p, a, b in slots:
                s, e = spots[a][0], spots[b][1]
                piece = t[s:e]
                s, e = s + len(piece) - len(piece.lstrip(_EDGE)), e - len(piece) + len(piece.rstrip(_EDGE))
                if s >= e:
                    continue
                # base spans that start before the end, the furthest of them beyond the start
                k = bisect.bisect_left(starts, e)
                seed = k > 0 and reach[k - 1] > s
                own = next((x for x in reversed(base[:k]) if x[1] > s), (s, e)) if seed else (s, e)
                yield i, h, own[0], own[1], seed, t[s:e].isalpha() and t[s:e].islower(), instance(t[own[0] : own[1]]), p, patterns(t, *own)

        return look

    return map_rows(_texts(df, key, text), make, SLOTS)


def score(edges: DataFrame, least: int, confidence: float = CONFIDENCE) -> DataFrame:
    """(p): patterns of high confidence, from edges (p, i, n, seed), scored in turn with their instances until none is added."""
    known, before = edges.withColumn("w", F.col("seed").cast("double")), -1
    while True:
        scored = known.groupBy("p").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("c"), F.sum("w").alias("support"))
        good = checkpoint(scored.where((F.col("support") >= least) & (F.col("c") >= confidence)).select("p"))
        now = good.count()  # grows until it is the same: a known instance stays known
        if now == before or not now:
            return good
        before = now
        sure = edges.join(good, "p", "left_semi").select("i").distinct().withColumn("sure", F.lit(1.0))
        known = edges.join(sure, "i", "left").select("p", "i", "n", F.greatest(F.col("seed").cast("double"), F.coalesce("sure", F.lit(0.0))).alias("w"))


def learn(df: DataFrame, key: str, text: str, seen: DataFrame, confidence: float = CONFIDENCE, least: int = LEAST, share: float = SHARE) -> DataFrame | None:
    """Occurrences (doc_id, h, s, e) that confident patterns find; None where there is nothing to learn from."""
    known = checkpoint(seen.groupBy("i", "p").agg(F.count("*").alias("n")))  # different instances with their patterns
    tried, scored, found = set(), set(), None
    while True:
        total = known.select("i").distinct().count()
        enough = max(least, math.ceil(total * share))
        rows = known.groupBy("p").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where(F.col("k") >= enough).collect()  # at most 5 / share
        new = {r["p"]: r["n"] for r in rows if r["p"] not in tried}
        if not new:
            return found
        tried |= set(new)
        seeds = df.sparkSession.createDataFrame([*new.items()], "p string, m long")
        often = occurrences(df, text, sorted(new)).join(F.broadcast(seeds), "p")
        more = {r["p"] for r in often.where(F.col("m") >= PROMISING * F.col("n")).select("p").collect()}
        if not more:
            return found
        scored |= more
        slots = checkpoint(filled(df, key, text, sorted(scored)))
        good = score(checkpoint(slots.groupBy("p", "i").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))), enough, confidence)
        hit = slots.where(~F.col("seed")).join(good, "p", "left_semi")
        sure = hit.groupBy("doc_id", "h", "s", "e").agg(F.count_distinct("p").alias("k"), F.first("plain").alias("plain"), F.first("i").alias("i"), F.first("near").alias("near"))
        found = checkpoint(sure.where(~F.col("plain") | (F.col("k") > 1)))
        again = found.select("i", F.explode("near").alias("p")).groupBy("i", "p").agg(F.count("*").alias("n"))
        known = checkpoint(seen.groupBy("i", "p").agg(F.count("*").alias("n")).unionByName(again).groupBy("i", "p").agg(F.sum("n").alias("n")))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """One row per document with the counts and digest of the expressions' matches, and all spans."""
    d = checkpoint(extract(df, key, text))
    seen = d.select(F.explode("seen").alias("x")).select("x.i", F.explode("x.p").alias("p"))
    new = learn(df, key, text, seen, confidence, least)
    o = d.drop("seen")
    if new is None:
        o = o.withColumn("new", F.lit(None).cast("array<struct<s:int,e:int>>"))
    else:
        # spans that overlap are one; a partition is one text's
        by = Window.partitionBy("doc_id", "h").orderBy("s", "e")
        new = new.withColumn("g", F.coalesce((F.col("s") >= F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0)))
        new = new.withColumn("g", F.sum("g").over(by)).groupBy("doc_id", "h", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
        o = o.join(new.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("new")), ["doc_id", "h"], "left")
    item = lambda k, s, e: F.struct(s.cast("int").alias("s"), F.lit(k).cast("int").alias("k") if isinstance(k, int) else k.cast("int").alias("k"), e.cast("int").alias("e"))
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: item(F.array_position(names, F.split(x, ":")[0]), F.split(x, ":")[1], F.split(x, ":")[2]))
    found = F.transform(F.coalesce("new", F.array().cast("array<struct<s:int,e:int>>")), lambda x: item(len(KINDS), x["s"], x["e"]))
    every = F.transform(F.sort_array(F.concat(base, found)), lambda x: F.concat_ws(":", F.get(names, x["k"] - 1), x["s"].cast("string"), x["e"].cast("string")))
    o = o.withColumn("spans", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_join(every, ",")))
    o = o.withColumn("n_found", F.coalesce(F.size("new"), F.lit(0)).cast("long"))
    n = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_found")
    return o.select(own_id(F.col("doc_id")).alias(key), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found", n.alias("n_spans"))
