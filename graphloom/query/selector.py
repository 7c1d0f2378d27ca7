"""Selectors over node tables: `nav > a[href^="/"]`, `li:has(a):not(:first-child)`.

A selector is compiled into flag columns on the node table.  With preorder numbers
and subtree ends, "has an ancestor in A" is a running maximum of the subtree ends of
A's nodes, and "has a descendant in B" the next node of B: one window over each
page's nodes, no join of nodes with nodes.  The child step alone is an equi-join.

Supported: kinds and `*`, `[a]`, `[a=v]` with `= ^= $= *= ~=`, descendant, `>`, `+`, `~`,
`:first-child`, `:last-child`, `:nth-child(n)`, `:has()`, `:not()`, `:is()`, and `,`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpoint

_PART = re.compile(r"""\s*(?:(?P<comb>[>+~,])|(?P<kind>[#\w-]+|\*)|\[\s*(?P<attr>[\w.:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[^\]\s]+))\s*)?\]|:(?P<pseudo>[\w-]+)(?P<paren>\()?)""")


class SelectorError(ValueError):
    """A selector that is not in the grammar."""


def _close(text: str, at: int) -> int:
    depth = 1
    while depth:
        if at >= len(text):
            raise SelectorError(f"no closing parenthesis in {text!r}")
        depth += {"(": 1, ")": -1}.get(text[at], 0)
        at += 1
    return at


def parse(text: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives, each a list of (combinator, tests)."""
    out, now, tests, comb, at = [], [], [], "", 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            raise SelectorError(f"unexpected {text[at : at + 10]!r} in {text!r}")
        blank = m[0][:1].isspace()
        if m["comb"]:
            if not tests:
                raise SelectorError(f"nothing before {m['comb']!r} in {text!r}")
            now.append((comb, tests))
            tests, comb = [], m["comb"]
            if comb == ",":
                out.append(now)
                now, comb = [], ""
            at = m.end()
            continue
        if blank and tests:
            now.append((comb, tests))
            tests, comb = [], " "
        at = m.end()
        if m["kind"]:
            tests.append(("kind", m["kind"]))
        elif m["attr"]:
            tests.append(("attr", m["attr"], m["op"], next((x for x in (m["q"], m["s"], m["v"]) if x is not None), None)))
        elif m["paren"]:
            end = _close(text, at)
            tests.append(("call", m["pseudo"], text[at : end - 1].strip()))
            at = end
        else:
            tests.append(("call", m["pseudo"], ""))
    if not tests:
        raise SelectorError(f"incomplete selector {text!r}")
    return [*out, [*now, (comb, tests)]]


class _Compiler:
    def __init__(self, nodes: DataFrame, key: str):
        self.d, self.key, self.n = nodes, key, 0

    def keep(self, c: Column) -> str:
        self.n += 1
        name = f"_s{self.n}"
        self.d = self.d.withColumn(name, F.coalesce(c, F.lit(False)))
        return name

    def within(self) -> tuple:
        w = Window.partitionBy(self.key).orderBy("node_id")
        return w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)

    def siblings(self):
        return Window.partitionBy(self.key, "parent_id")

    def has_below(self, name: str) -> Column:
        return F.min(F.when(F.col(name), F.col("node_id"))).over(self.within()[1]) <= F.col("subtree_end")

    def has_above(self, name: str) -> Column:
        return F.max(F.when(F.col(name), F.col("subtree_end"))).over(self.within()[0]) >= F.col("node_id")

    def child_of(self, name: str) -> Column:
        up = self.d.select(F.col(self.key).alias("_k"), F.col("node_id").alias("_p"), F.col(name).alias("_up"))
        self.d = self.d.drop("_up").join(up, (F.col(self.key) == F.col("_k")) & (F.col("parent_id") == F.col("_p")), "left").drop("_k", "_p")
        return F.col("_up")

    def attr(self, name: str) -> Column:
        return {"value": F.col("value"), "kind": F.col("kind")}.get(name, F.element_at("attrs", name))

    def test(self, t: tuple) -> Column:
        if t[0] == "kind":
            return F.lit(True) if t[1] == "*" else F.col("kind") == t[1]
        if t[0] == "attr":
            a, v = self.attr(t[1]), t[3]
            words = F.split(a, r"\s+")
            return a.isNotNull() if t[2] is None else {"=": a == v, "^=": a.startswith(v or ""), "$=": a.endswith(v or ""), "*=": a.contains(v or ""), "~=": F.array_contains(words, v)}[t[2]]
        elements = F.when(~F.col("kind").startswith("#"), F.col("ordinal"))
        nth = F.count(elements).over(self.siblings().orderBy("ordinal"))
        call = {
            "has": lambda x: self.has_below(self.any(x)),
            "not": lambda x: ~F.col(self.any(x)),
            "is": lambda x: F.col(self.any(x)),
            "first-child": lambda _: (nth == 1) & ~F.col("kind").startswith("#"),
            "last-child": lambda _: F.col("ordinal") == F.max(elements).over(self.siblings()),
            "nth-child": lambda x: (nth == int(x)) & ~F.col("kind").startswith("#"),
        }
        if t[1] not in call:
            raise SelectorError(f"unknown :{t[1]}")
        return call[t[1]](t[2])

    def any(self, text: str) -> str:
        """Name of a flag for the nodes that a selector matches."""
        flags = []
        for steps in parse(text):
            last = None
            for comb, tests in steps:
                own = F.lit(True)
                for t in tests:
                    own = own & self.test(t)
                if last is not None:
                    order = self.siblings().orderBy("ordinal")
                    own = own & {
                        " ": lambda: self.has_above(last),
                        ">": lambda: self.child_of(last),
                        "+": lambda: F.lag(last).over(order),
                        "~": lambda: F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                    }[comb]()
                last = self.keep(own)
            flags.append(F.col(last))
        hit = flags[0]
        for f in flags[1:]:
            hit = hit | f
        return self.keep(hit)


def select(nodes: DataFrame, key: str, selector: str) -> DataFrame:
    """The nodes that match, with the columns of the node table; a child step meets the table itself, which is then written once."""
    c = _Compiler(checkpoint(nodes) if ">" in selector else nodes, key)
    name = c.any(selector)
    return c.d.where(name).select(nodes.columns)
