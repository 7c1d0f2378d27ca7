"""Node tables of HTML pages.

Rows are (key, node_id, parent_id, ordinal, depth, kind, subtree_end, value, attrs):
node ids count in preorder from 1, and a node's subtree is (node_id, subtree_end].
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NODE = "node_id long, parent_id long, ordinal int, depth int, kind string, subtree_end long, value string, attrs map<string,string>"


class _Tree(HTMLParser):
    """Nodes of one page; an end tag closes what is open above its own, one without a start is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.children = [], [], {}

    def _add(self, kind: str, value: str | None, attrs: dict) -> int:
        parent = self.open[-1] if self.open else 0
        n = self.children[parent] = self.children.get(parent, 0) + 1
        self.rows.append([len(self.rows) + 1, parent or None, n, len(self.open), kind, len(self.rows) + 1, value, attrs])
        return len(self.rows)

    def handle_starttag(self, tag, attrs):
        n = self._add(tag, None, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, None, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        if any(self.rows[n - 1][4] == tag for n in self.open):
            while self.rows[(n := self.open.pop()) - 1][4] != tag:
                self.rows[n - 1][5] = len(self.rows)
            self.rows[n - 1][5] = len(self.rows)

    def handle_data(self, data):
        if data.strip():
            self._add("#text", data, {})

    def handle_comment(self, data):
        self._add("#comment", data, {})

    def done(self) -> list[list]:
        for n in self.open:
            self.rows[n - 1][5] = len(self.rows)
        return self.rows


def html_nodes(df: DataFrame, key: str, html: str) -> DataFrame:
    """All nodes of each page; a worker holds one batch of pages and a few thousand nodes."""
    kind = df.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=[key, "node_id", "parent_id", "ordinal", "depth", "kind", "subtree_end", "value", "attrs"]).astype({"parent_id": "Int64"})
        for b in batches:
            out = []
            for k, t in zip(b[key], b[html]):
                tree = _Tree()
                tree.feed(t or "")
                tree.close()
                out += [(k, *r) for r in tree.done()]
                if len(out) >= 5_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    return df.select(key, html).mapInPandas(walk, f"`{key}` {kind}, {NODE}")
