"""Quality rules by weak supervision.

Each rule looks at one figure of a text and votes: bad (-1), good (1) or nothing
(0).  No rule is trusted as such.  Expectation-maximisation over the counts of
vote patterns estimates how often each rule votes what on good and on bad texts,
and a text is kept when the posterior probability of "good" reaches a threshold.

Everything on the rows is built-in DataFrame functions.  The fit sees only the
table of vote patterns, at most 3**len(RULES) rows whatever the corpus size, and
that table counts every document.

Defined results: null and blank texts have no words and fail the base rule;
repeated rows are judged alike and all counted; an empty table gives an empty
result; columns that are already there keep their names and values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: 100 * repeated words over this many per cent of all words fails a text.
MAX_REPEAT = 50


@dataclass(frozen=True)
class Rule:
    """Bad at or beyond `bad`, good at or beyond `good`, else no vote; `bad` above `good` means that high figures are bad."""

    name: str
    figure: Callable[[str], Column]
    bad: float
    good: float

    def vote(self, f: str) -> Column:
        x = self.figure(f)
        high = self.bad > self.good
        bad, good = (x >= self.bad, x <= self.good) if high else (x <= self.bad, x >= self.good)
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def _share(part: str, of: str) -> Callable[[str], Column]:
    return lambda f: F.col(f"{f}.{part}") / F.greatest(F.col(f"{f}.{of}"), F.lit(1))


RULES = (
    Rule("symbols_per_word", _share("n_symbols", "n_words"), bad=0.25, good=0.05),
    Rule("wordless_share", _share("n_wordless", "n_words"), bad=0.25, good=0.05),
    Rule("upper_share", _share("n_upper", "word_chars"), bad=0.5, good=0.15),
    Rule("marks_per_word", _share("n_marks", "n_words"), bad=0.5, good=0.05),
    Rule("distinct_share", _share("n_distinct", "n_words"), bad=0.2, good=0.4),
    Rule("repeat_share", _share("n_repeat_words", "n_words"), bad=0.4, good=0.1),
    Rule("dup_line_share", _share("n_dup_lines", "n_lines"), bad=0.4, good=0.05),
    Rule("word_length", lambda f: F.abs(F.col(f"{f}.word_chars") / F.greatest(F.col(f"{f}.n_words"), F.lit(1)) - 6.5), bad=5.0, good=2.5),
)


def features(df: DataFrame, text: str = "text", out: str = "_f") -> DataFrame:
    """Add a struct of figures over each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, d = f"{out}_w", f"{out}_h", f"{out}_d"
    df = df.withColumn(w, words(F.col(text)))
    # hashes of three-word windows; windows of shorter texts do not exist
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn(
        h,
        F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # only texts in which some window comes twice pay for the sort
    sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(d, F.when(F.size(F.array_distinct(h)) < F.size(h), sorted_))
    at = lambda i: F.get(F.col(d), i)["h"]
    twice = F.filter(d, lambda x, i: x["h"].eqNullSafe(at(i - 1)) | x["h"].eqNullSafe(at(i + 1)))
    df = df.withColumn(d, F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(d), k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ls = f"{out}_l"
    df = df.withColumn(ls, lines)
    # lower-case and digit runs shrink to one letter first: the patterns below then pass over a third of the text
    z = f"{out}_z"
    df = df.withColumn(z, F.regexp_replace(t, r"[\p{Ll}\p{N}]+", "a"))
    joined = F.array_join(w, "")
    df = df.withColumn(
        out,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            F.regexp_count(z, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.regexp_count(z, F.lit(r"(?:^|\s)[^\p{L}\p{N}\s]+(?=\s|$)")).cast("long").alias("n_wordless"),
            F.regexp_count(z, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(z, F.lit(r"[!?]{2}|[^\w\s]{3}")).cast("long").alias("n_marks"),
        ),
    )
    return df.drop(w, h, d, ls, z)


def votes(f: str = "_f") -> Column:
    return F.array(*[r.vote(f) for r in RULES])


def base_failed(f: str = "_f") -> Column:
    n, repeated = F.col(f"{f}.n_words"), F.col(f"{f}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT * n)


@dataclass(frozen=True)
class Model:
    """Class prior and, for each rule and vote, log P(vote | good) - log P(vote | bad)."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def log_odds(self, v: Iterable[int]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(w[x + 1] for w, x in zip(self.weights, v))

    def posterior(self, v: Column) -> Column:
        """Posterior probability of good as a column expression."""
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, w in enumerate(self.weights):
            x = F.get(v, F.lit(k))
            z = z + F.when(x < 0, w[0]).when(x > 0, w[2]).otherwise(w[1])
        return 1 / (1 + F.exp(-z))


def fit(patterns: Iterable[tuple[tuple[int, ...], int]], rules: int = len(RULES), rounds: int = 50, smooth: float = 1.0) -> Model:
    """Expectation-maximisation on (votes, count) pairs.

    Starts from the belief that rules beat chance: a pattern with a bad vote starts
    as bad with probability 0.9.  Counts are smoothed and the prior is kept off 0 and
    1, so the result exists for empty input, and for input of one pattern, too.  Should
    the classes have changed places (bad votes more likely from what is called good),
    they are named the other way round.
    """
    data = sorted((tuple(v), n) for v, n in patterns)
    q = [0.1 if -1 in v else 0.95 for v, _ in data]
    model = None
    for _ in range(rounds):
        good = [[smooth] * 3 for _ in range(rules)]
        bad = [[smooth] * 3 for _ in range(rules)]
        g = b = smooth
        for (v, n), p in zip(data, q):
            g, b = g + n * p, b + n * (1 - p)
            for k, x in enumerate(v):
                good[k][x + 1] += n * p
                bad[k][x + 1] += n * (1 - p)
        weights = tuple(tuple(math.log(x / sum(gk)) - math.log(y / sum(bk)) for x, y in zip(gk, bk)) for gk, bk in zip(good, bad))
        model = Model(min(max(g / (g + b), 1e-6), 1 - 1e-6), weights)
        new = [1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(v))))) for v, _ in data]
        done = max([abs(x - y) for x, y in zip(q, new)], default=0.0) < 1e-9
        q = new
        if done:
            break
    # weight of a bad vote: log P(bad vote | good) - log P(bad vote | bad), below 0 where a rule beats chance
    if sum(w[0] - w[2] for w in model.weights) > 0:
        model = Model(1 - model.prior, tuple(tuple(-x for x in w) for w in model.weights))
    return model


def fit_frame(df: DataFrame, v: str = "_v") -> Model:
    """Fit on all rows of a frame with a column of votes; base failures take part."""
    rows = df.groupBy(v).count().collect()  # at most 3 ** len(RULES) rows
    return fit((tuple(r[0]), r[1]) for r in rows)


def judge(df: DataFrame, threshold: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with the base figures, its posterior and the verdict."""
    f = features(df.select(F.col(key), F.col(text)), text, "_f").select(key, "_f", votes().alias("_v"))
    f = checkpoint(f)  # figures only; texts are read once
    model = fit_frame(f)
    post = model.posterior(F.col("_v"))
    return f.select(
        key,
        *[F.col(f"_f.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        (~base_failed() & (post >= threshold)).alias("kept"),
        post.alias("posterior"),
        F.col("_v").alias("votes"),
    )


def keep(df: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the input's columns alone.

    The figures are computed twice, once to fit and once to filter: that moves no
    text between machines, where joining verdicts back would move all of it.
    """
    model = fit_frame(features(df.select(text), text).select(votes().alias("_v")))
    cols = df.columns
    f = features(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]), f"c{cols.index(text)}", "_f")
    # a generator of one row: the filter stays above it, else its expressions would be copied into every vote
    f = f.select(*[f"c{i}" for i in range(len(cols))], F.explode(F.array("_f")).alias("_f"))
    f = f.where(~base_failed() & (model.posterior(votes()) >= threshold))
    return f.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
