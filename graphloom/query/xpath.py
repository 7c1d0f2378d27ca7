"""Tree patterns from an example: an XPath expression for candidates, an alignment for matches.

Trees are XML in the form `<node id kind start end value><field name collection>...`.
A template is a node with fields; `gap` stands for any run of elements of a
collection and `any` for one value of whatever kind.  Exact patterns compare the
values of leaves, shape patterns do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import xpath_literal


@dataclass
class Node:
    kind: str
    value: str | None = None
    #: name -> (is a collection, nodes)
    fields: dict[str, tuple[bool, list["Node"]]] = field(default_factory=dict)


GAP, ANY = Node("#gap"), Node("#any")


def predicate(t: Node, exact: bool = True) -> str:
    """Conditions of a template node, in XPath 1.0."""
    parts = [f"@kind={xpath_literal(t.kind)}"]
    if exact and t.value is not None:
        parts.append(f"@value={xpath_literal(t.value)}")
    names = " or ".join(f"@name={xpath_literal(n)}" for n in t.fields)
    parts.append(f"not(field[not({names})])" if names else "not(field)")
    for name, (_, nodes) in t.fields.items():
        own = f"field[@name={xpath_literal(name)}]"
        fixed = [n for n in nodes if n.kind != GAP.kind]
        parts.append(f"{own}[count(node)={len(nodes)}]" if len(fixed) == len(nodes) else f"{own}[count(node)>={len(fixed)}]")
        chain, anchored = "", True
        for n in nodes:
            if n.kind == GAP.kind:
                anchored = False
                continue
            cond = "" if n.kind == ANY.kind else f"[{predicate(n, exact)}]"
            if not chain:
                chain = f"{own}/node{'[1]' if anchored else ''}{cond}"
            else:
                chain += f"/following-sibling::node{'[1]' if anchored else ''}{cond}"
            anchored = True
        if chain:
            parts.append(chain)
    return " and ".join(parts)


def expression(t: Node, exact: bool = True) -> str:
    return f"//node[{predicate(t, exact)}]"


def candidates(df: DataFrame, key: str, xml: str, xpath: str) -> DataFrame:
    """(key, node): ids of the nodes that an expression finds, by Spark's own evaluator."""
    return df.select(key, F.explode(F.xpath(F.col(xml), F.lit(f"{xpath}/@id"))).alias("node"))


def _tree(e: ElementTree.Element) -> Node:
    return Node(e.get("kind"), e.get("value"), {f.get("name"): (f.get("collection") == "true", [_tree(x) for x in f]) for f in e})


def aligned(t: Node, c: Node, exact: bool = True) -> bool:
    """A template fits a node with the same fields, gaps taking any run of elements."""
    if t.kind == ANY.kind:
        return True
    if t.kind != c.kind or exact and t.value != c.value or t.fields.keys() != c.fields.keys():
        return False
    return all(_run(nodes, c.fields[name][1], exact) for name, (_, nodes) in t.fields.items())


def _run(ts: list[Node], cs: list[Node], exact: bool) -> bool:
    if not ts:
        return not cs
    if ts[0].kind == GAP.kind:
        return len(ts) == 1 or any(_run(ts[1:], cs[k:], exact) for k in range(len(cs) + 1))
    return bool(cs) and aligned(ts[0], cs[0], exact) and _run(ts[1:], cs[1:], exact)


def matches(df: DataFrame, key: str, xml: str, template: Node, exact: bool = True) -> DataFrame:
    """(key, node, start, end, matched) for every candidate of the template's expression."""
    kind = df.schema[key].dataType.simpleString()
    found = df.select(key, xml, F.xpath(F.col(xml), F.lit(f"{expression(template, exact)}/@id")).alias("_ids")).where(F.size("_ids") > 0)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, x, ids in zip(b[key], b[xml], b["_ids"]):
                at = {e.get("id"): e for e in ElementTree.fromstring(x).iter("node")}
                out += [(k, i, int(at[i].get("start")), int(at[i].get("end")), aligned(template, _tree(at[i]), exact)) for i in ids]
            yield pd.DataFrame(out, columns=[key, "node", "start", "end", "matched"])

    return found.mapInPandas(align, f"`{key}` {kind}, node string, start long, end long, matched boolean")


def summary(m: DataFrame) -> DataFrame:
    """Candidates, those that did not align, and matches."""
    return m.agg(F.count("*").alias("xpath_candidates"), F.count_if(~F.col("matched")).alias("rejected"), F.count_if("matched").alias("matches"))


def to_xml(n: Node, counter: list[int] | None = None) -> str:
    """XML of a tree; ids n1, n2 ... in preorder, places equal to the ids."""
    from xml.sax.saxutils import quoteattr

    counter = counter if counter is not None else [0]
    counter[0] += 1
    i = counter[0]
    value = "" if n.value is None else f" value={quoteattr(n.value)}"
    inner = "".join(f'<field name={quoteattr(f)} collection="{str(c).lower()}">{"".join(to_xml(x, counter) for x in ns)}</field>' for f, (c, ns) in n.fields.items())
    return f'<node id="n{i}" kind={quoteattr(n.kind)} start="{i}" end="{counter[0]}"{value}>{inner}</node>'
