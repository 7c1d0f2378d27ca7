"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A text is cut into paragraphs: runs of up to three sentences of one line, long ones
cut at a fixed length, so that an edit changes the paragraphs it touches and those
up to the next line end.  Distinct paragraph digests go into a table: each is added
to three cells, one in each third, and a cell holds how many digests it got, their
exclusive or, and the exclusive or of their checks.

The fingerprint of a text is the number of its digests, the size of its table and the
cells in use.  A table's thirds are the smallest power of two that is no less than the
number of digests, so tables come in few sizes, and a fingerprint can be peeled by
itself: that lists its digests.

Two fingerprints of one size subtract cell by cell; what both texts have cancels out.
A cell with one digest left names it; taking that digest out of its other two cells
frees more.  Peeled to the end, this gives the digests of the differing paragraphs.  Of
two sizes, the smaller table is raised to the larger size first (peeled, and its digests
added to a larger table), so two fingerprints are enough: `decode`.  The likeness of two
texts is read off what that gives.  If cells remain, the tables were too small, and
larger ones with another hash are tried, of `TIMES` their size; should all fail (never
seen), the digests are compared directly.

All of it is built-in functions on arrays within a row; cells are merged by sorting,
so the work grows with n log n of the paragraphs of a text.

Defined results: null texts count as empty; two texts without paragraphs are alike
(1.0); rows of one id follow each other by hash of the text; null ids come last; ids may
be any 64-bit numbers; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import hidden

PARAGRAPH = r"(?:[^.!?\n]{1,160}+[.!?]*+|[.!?]++){1,3}+"
#: How many times larger the tables of the second and the third try are, and rounds of peeling.
TIMES, ROUNDS = (2, 8), 24
#: Cells of a third for each digest, and the fewest.
ROOM, LEAST = 1.5, 8
#: Documents next to each other by id that one task orders, on average.
NEIGHBOURS = 200
#: Most ranges of ids; so many rows of four numbers go to every executor.
MOST_RANGES = 50_000

CELL = "struct<c:int,n:int,k:bigint,x:int>"
DIFF = "struct<a:array<bigint>,b:array<bigint>>"


def _let(x: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _cells_of(k: Column, n: Column, third: Column, seed: Column | int) -> Column:
    """The three cells that a digest is added to, one in each third of the table."""
    cell = lambda h, j: F.struct((F.pmod(F.shiftright(h, 20 * j), third) + third * j).cast("int").alias("c"), n.alias("n"), k.alias("k"), F.hash(k).alias("x")).cast(CELL)
    return _let(F.xxhash64(k, F.lit(seed) if isinstance(seed, int) else seed), lambda h: F.array(cell(h, 0), cell(h, 1), cell(h, 2)))


def _merge(cells: Column) -> Column:
    """One entry per cell, those that have cancelled out left away."""

    def groups(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | (F.get(s, i - 1)["c"] != e["c"]), i)), lambda i: i.isNotNull())

        def merged(at: Column) -> Column:
            own = lambda b, j: F.slice(s, b + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - b)
            zero = lambda b: F.struct(F.get(s, b)["c"].alias("c"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).alias("x")).cast(CELL)
            add = lambda a, e: F.struct(a["c"].alias("c"), (a["n"] + e["n"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["x"].bitwiseXOR(e["x"]).alias("x")).cast(CELL)
            return F.transform(at, lambda b, j: F.aggregate(own(b, j), zero(b), add))

        return _let(first, merged)

    live = lambda e: (e["n"] != 0) | (e["k"] != 0) | (e["x"] != 0)
    return F.filter(_let(F.sort_array(cells), groups), live)


def _table(keys: Column, n: int, third: Column, seed: Column | int) -> Column:
    """Unmerged entries of all digests, each counted n times."""
    return F.flatten(F.transform(keys, lambda k: _cells_of(k, F.lit(n), third, seed)))


def _peel(cells: Column, third: Column, seed: Column | int) -> Column:
    """(cells left, digests of the first text only, of the second only)."""

    def round_(s: Column) -> Column:
        pure = F.filter(s["cells"], lambda e: (F.abs(e["n"]) == 1) & (F.hash(e["k"]) == e["x"]))
        pure = F.array_distinct(F.transform(pure, lambda e: F.struct(e["n"].alias("n"), e["k"].alias("k"))))

        def take(p: Column) -> Column:
            out = F.flatten(F.transform(p, lambda e: _cells_of(e["k"], -e["n"], third, seed)))
            side = lambda v: F.transform(F.filter(p, lambda e: e["n"] == v), lambda e: e["k"])
            new = F.struct(_merge(F.concat(s["cells"], out)).alias("cells"), F.concat(s["a"], side(1)).alias("a"), F.concat(s["b"], side(-1)).alias("b"))
            return F.when(F.size(p) == 0, s).otherwise(new)

        return F.when(F.size(s["cells"]) == 0, s).otherwise(_let(pure, take))

    none = F.array().cast("array<bigint>")
    start = F.struct(_merge(cells).alias("cells"), none.alias("a"), none.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: round_(s))


def sized(keys: Column, third: Column, seed: Column | int = 0) -> Column:
    """(n, third, cells): the table of a text's digests."""
    return F.struct(F.size(keys).alias("n"), third.alias("third"), _merge(_table(keys, 1, third, seed)).alias("cells"))


def third_of(keys: Column) -> Column:
    """Cells of a third of the table that a number of digests gets: a power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(keys) * ROOM, F.lit(float(LEAST)))))).cast("int")


def _negative(cells: Column) -> Column:
    return F.transform(cells, lambda e: e.withField("n", (-e["n"]).cast("int")))


def _subtracted(x: Column, y: Column, seed: Column | int) -> Column:
    """(a, b) of two tables of one size: digests of the first only, of the second only; null where cells remain."""
    s = _peel(F.concat(x["cells"], _negative(y["cells"])), x["third"], seed)
    whole = lambda s: (F.size(s["cells"]) == 0) & (x["n"] - F.size(s["a"]) == y["n"] - F.size(s["b"]))
    return _let(s, lambda s: F.when(whole(s), F.struct(s["a"].alias("a"), s["b"].alias("b"))))


def raised(x: Column, third: Column, keys: Column | None = None) -> Column:
    """The table at a larger size; null where it can't be peeled.  Known digests spare the peeling."""
    if keys is None:
        mine = _let(_peel(x["cells"], x["third"], 0), lambda s: F.when((F.size(s["cells"]) == 0) & (F.size(s["a"]) == x["n"]), s["a"]))
        return F.when(x["third"] >= third, x).otherwise(_let(mine, lambda k: F.when(k.isNotNull(), sized(k, third))))
    return F.when(x["third"] >= third, x).otherwise(sized(keys, third))


def decode(x: Column, y: Column, x_keys: Column | None = None, y_keys: Column | None = None) -> Column:
    """(a, b) of two tables of any sizes, from the tables alone; null where that fails."""
    third = F.greatest(x["third"], y["third"])
    both = lambda t: _let(F.struct(raised(x, t, x_keys).alias("x"), raised(y, t, y_keys).alias("y")), lambda r: F.when(r["x"].isNotNull() & r["y"].isNotNull(), _subtracted(r["x"], r["y"], 0)))
    return _let(third, both)


def differences(df: DataFrame, base: str, others: list[str], keys: dict[str, str], out: str = "_diff") -> DataFrame:
    """Add an array of (a, b), for each other column of tables: digests only in the base, only in the other.

    `keys` names the columns of digests that the tables were made of: where tables
    fail, larger ones are made of them.
    """
    x, p = F.col(base), F.col(keys[base])
    tables = F.array(*[F.struct(F.col(o).alias("t"), F.col(keys[o]).alias("q")) for o in others])
    df = df.withColumn(out, F.transform(tables, lambda o: F.struct(o["q"].alias("q"), decode(x, o["t"], p, o["q"]).alias("d"))))

    def larger(k: int, times: int):
        again = lambda o, n: _let(F.struct(sized(p, n, k).alias("x"), sized(o["q"], n, k).alias("y")), lambda r: _subtracted(r["x"], r["y"], k))
        return lambda o: F.when(o["d"].isNotNull(), o).otherwise(o.withField("d", _let(F.greatest(third_of(p), third_of(o["q"])) * times, lambda n: again(o, n))))

    for k, times in enumerate(TIMES, 1):
        df = df.withColumn(out, F.when(F.exists(out, lambda o: o["d"].isNull()), F.transform(out, larger(k, times))).otherwise(F.col(out)))
    direct = lambda o: F.coalesce(o["d"], F.struct(F.array_except(p, o["q"]).alias("a"), F.array_except(o["q"], p).alias("b")))
    return df.withColumn(out, F.transform(out, direct))


def likeness(x: Column, y: Column, d: Column) -> Column:
    """Paragraphs that both texts have over those that either has, of two tables and their difference."""
    both, either = x["n"] - F.size(d["a"]), x["n"] + F.size(d["b"])
    return F.when(either == 0, 1.0).otherwise(both / either)


def written(t: Column) -> Column:
    """A table as text: digests and cells of a third, then cell:count:digests:checks."""
    one = lambda e: F.concat_ws(":", e["c"].cast("string"), e["n"].cast("string"), F.lower(F.hex(e["k"])), F.lower(F.hex(e["x"].cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.concat_ws(",", t["n"].cast("string"), t["third"].cast("string"), F.transform(t["cells"], one))


def _long(hex_: Column) -> Column:
    """A 64-bit number from its hexadecimal digits, two's complement."""
    h = F.lpad(hex_, 16, "0")
    half = lambda a: F.conv(F.substr(h, F.lit(a), F.lit(8)), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def parsed(fingerprint: Column) -> Column:
    """The reverse of `written`."""
    parts = F.split(fingerprint, ",")

    def cell(p: Column) -> Column:
        f = F.split(p, ":")
        x = F.conv(f[3], 16, 10).cast("bigint")
        return F.struct(f[0].cast("int").alias("c"), f[1].cast("int").alias("n"), _long(f[2]).alias("k"), F.when(x >= 2**31, x - 2**32).otherwise(x).cast("int").alias("x")).cast(CELL)

    return _let(parts, lambda p: F.struct(p[0].cast("int").alias("n"), p[1].cast("int").alias("third"), F.transform(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(0))), cell).alias("cells")))


def compare(df: DataFrame, a: str, b: str, out: str = "near") -> DataFrame:
    """Add the likeness of two columns of written fingerprints, from these alone; null where they can't be decoded."""
    x, y, d = hidden(df, "_x", "_y", "_d")
    df = df.withColumn(x, parsed(F.col(a))).withColumn(y, parsed(F.col(b))).withColumn(d, decode(F.col(x), F.col(y)))
    return df.withColumn(out, F.when(F.col(d).isNotNull(), likeness(F.col(x), F.col(y), F.col(d)))).drop(x, y, d)


def _count(bounds: list[float], x: Column, within: bool) -> Column:
    """How many of the sorted bounds are below x, or no more than x: a binary search."""
    if not bounds:
        return F.lit(0)
    b = F.lit(bounds)
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    left = lambda v: (v <= x) if within else (v < x)

    def step(s: Column, _: Column) -> Column:
        at = lambda m: F.when(s["lo"] >= s["hi"], s).when(left(F.get(b, m)), F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi")))
        return _let(mid(s), at)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, step, lambda s: s["lo"])


def ranges(df: DataFrame, key: str, t: str) -> Column:
    """A number for each row's range of ids, ascending as (id, t), with about `NEIGHBOURS` rows whatever the ids are.

    Bounds are quantiles of the ids.  An id that is several quantiles, and rows without
    one, are divided by their hash.  Ids that are one number as a double stay together.
    """
    x = F.col(key).cast("double")
    s = df.agg(F.count("*").alias("n"), F.count(key).alias("have")).first()
    parts = lambda n: min(max(1, n // NEIGHBOURS), MOST_RANGES)
    own, none = parts(s["have"]), parts(s["n"] - s["have"])
    cuts = [k / own for k in range(1, own)]
    bounds = (df.agg(F.percentile_approx(x, F.lit(cuts), F.lit(max(10_000, 10 * own))).alias("b")).first()["b"] or []) if cuts and s["have"] else []
    share = lambda n: F.least(F.floor((F.col(t).cast("double") / 2.0**64 + 0.5) * n).cast("int"), n - 1)
    lo, hi = _count(bounds, x, False), _count(bounds, x, True)
    split = _let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda c: F.when((c["hi"] - c["lo"] > 1) & (F.abs(x) < 2.0**53), c["lo"] + share(c["hi"] - c["lo"])).otherwise(c["lo"]))
    return F.when(F.col(key).isNull(), share(F.lit(none)) - none).otherwise(split).cast("long")


def with_next(df: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """Add `next`, a struct of the carried columns of the row with the next smaller id; after the last comes the first.

    Rows are dealt over ranges of ids.  Of each range the largest id is copied to
    the range above, where the smallest looks for it; the very first row is copied
    to the lowest range.  The table of ranges holds two numbers for each.
    """
    d = df.withColumn("_t", F.xxhash64(text))
    d = d.withColumn("_r", ranges(d.select(key, "_t"), key, "_t"))
    top = d.groupBy("_r").agg(F.max(F.struct(key, "_t")).alias("top"))
    by = Window.orderBy("_r")
    above = F.lead("_r").over(by)
    top = top.withColumn("_to", F.coalesce(above, F.min("_r").over(Window.partitionBy()))).withColumnRenamed("_r", "_q")
    # at most 2 * MOST_RANGES rows: texts need not be dealt out to meet them
    d = d.join(F.broadcast(top), F.col("_r") == F.col("_q"))
    ghost = F.struct(F.col(key), F.col("_t")).eqNullSafe(F.col("top"))
    d = d.withColumn("_copy", F.explode(F.when(ghost, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    d = d.withColumn("_r", F.when(F.col("_copy"), F.col("_to")).otherwise(F.col("_r"))).drop("_q", "_to", "top")
    order = Window.partitionBy("_r").orderBy("_copy", F.col(key).desc_nulls_last(), F.col("_t").desc())
    d = d.withColumn("next", F.lead(F.struct(*carry)).over(order))
    return d.where(~F.col("_copy")).drop("_copy", "_r", "_t")


def versions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the version whose last half is taken from the next document, and how alike fingerprints are."""
    d = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = with_next(d, "id", "t", ["t"])
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - half), F.substr(F.col("next.t"), F.lit(1), half))
    d = d.select("id", n.cast("long").alias("n_chars"), edited.alias("e"), digests(F.col("t")).alias("p"), digests(F.col("next.t")).alias("q"))
    d = d.select("id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), digests(F.col("e")).alias("pe"), "p", "q")
    for k in ("p", "pe", "q"):
        d = d.withColumn(f"{k}_t", _let(F.col(k), lambda x: sized(x, third_of(x))))
    d = differences(d, "p_t", ["pe_t", "q_t"], {"p_t": "p", "pe_t": "pe", "q_t": "q"})
    at = lambda k: F.get("_diff", F.lit(k))
    near = lambda o, k: likeness(F.col("p_t"), F.col(o), at(k))
    return d.select(
        F.col("id").alias(key),
        "n_chars",
        "edited_sha256",
        written(F.col("p_t")).alias("fingerprint"),
        written(F.col("pe_t")).alias("edited_fingerprint"),
        near("pe_t", 0).alias("near_edited"),
        near("q_t", 1).alias("near_next"),
        F.array_join(F.transform(at(0)["a"], lambda k: F.lower(F.hex(k))), ",").alias("gone"),
    )
