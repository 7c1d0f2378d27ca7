"""A tolerant lexer for JavaScript and TypeScript: package references and declarations.

It knows comments, strings, templates with nested code, and regular expressions by
what stands before them.  It resolves no symbols: what needs a type checker is read
as facts (`sources.facts`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.joins import prefix_join

_WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_NUMBER = re.compile(r"\d[\w.]*")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % < > ~ ^".split()) | frozenset("return typeof case in of delete void throw new else do".split())


@dataclass
class Token:
    kind: str  # word, string, number, template, regex, mark
    text: str
    start: int
    end: int
    depth: int


def tokens(s: str) -> Iterator[Token]:
    """Tokens with their depth in braces; template texts are one token each, their code is lexed too."""
    i, n, depth, last, templates = 0, len(s), 0, "", []
    while i < n:
        c = s[i]
        if c.isspace():
            i += 1
        elif s.startswith("//", i):
            i = s.find("\n", i) if s.find("\n", i) >= 0 else n
        elif s.startswith("/*", i):
            i = s.find("*/", i + 2) + 2 if s.find("*/", i + 2) >= 0 else n
        elif c in "\"'":
            j = i + 1
            while j < n and s[j] != c and s[j] != "\n":
                j += 2 if s[j] == "\\" else 1
            yield Token("string", s[i + 1 : j], i, min(j + 1, n), depth)
            i, last = j + 1, "string"
        elif c == "`" or c == "}" and templates and templates[-1] == depth:
            if c == "}":
                templates.pop()
            j = i + 1
            while j < n and s[j] != "`" and not s.startswith("${", j):
                j += 2 if s[j] == "\\" else 1
            yield Token("template", s[i + 1 : j], i, min(j + 1, n), depth)
            if s.startswith("${", j):
                templates.append(depth)
                j += 1
            i, last = j + 1, "{" if templates and s.startswith("{", j) else "template"
        elif (m := _WORD.match(s, i)) or (m := _NUMBER.match(s, i)):
            yield Token("number" if c.isdigit() else "word", m[0], i, m.end(), depth)
            i, last = m.end(), m[0]
        elif c == "/" and (not last or last in _BEFORE_REGEX) and (m := _REGEX.match(s, i)):
            yield Token("regex", m[0], i, m.end(), depth)
            i, last = m.end(), "regex"
        else:
            text = next((x for x in ("?.", "=>", "...") if s.startswith(x, i)), c)
            depth -= text == "}"
            yield Token("mark", text, i, i + len(text), depth)
            depth += text == "{"
            i, last = i + len(text), text


def _shadowed(ts: list[Token]) -> bool:
    """Whether a file declares `require` itself."""
    for a, b in zip(ts, ts[1:]):
        if b.kind == "word" and b.text == "require" and a.text in ("const", "let", "var", "function", "class"):
            return True
    return False


def references(s: str) -> list[tuple[str, str]]:
    """(specifier, kind) of a source's imports, each once: import, import-type, import-equals, require."""
    ts = list(tokens(s))
    at = lambda i: ts[i].text if 0 <= i < len(ts) else ""
    kind = lambda i: ts[i].kind if 0 <= i < len(ts) else ""
    out: dict[tuple[str, str], None] = {}
    own = _shadowed(ts)
    for i, t in enumerate(ts):
        if t.kind != "word":
            continue
        if t.text == "import" and t.depth == 0 and at(i - 1) not in (".", "?."):
            if kind(i + 1) == "string":
                out[ts[i + 1].text, "import"] = None
            elif at(i + 1) not in ("(", "."):
                j = i + 1
                while j < len(ts) and at(j) not in ("from", "=", ";") :
                    j += 1
                if at(j) == "from" and kind(j + 1) == "string":
                    out[ts[j + 1].text, "import-type" if _types_only(ts[i + 1 : j]) else "import"] = None
                elif at(j) == "=" and at(j + 1) == "require" and at(j + 2) == "(" and kind(j + 3) == "string":
                    out[ts[j + 3].text, "import-equals"] = None
        elif t.text == "require" and not own and at(i - 1) not in (".", "?.") and at(i + 1) == "(" and kind(i + 2) == "string" and at(i + 3) in (")", ",") and (at(i + 3) == ")" or at(i + 4) == ")"):
            if not (at(i - 1) == "=" and _import_equals(ts, i - 1)):
                out[ts[i + 2].text, "require"] = None
    return list(out)


def _import_equals(ts: list[Token], i: int) -> bool:
    return i >= 2 and ts[i - 1].kind == "word" and (ts[i - 2].text == "import" or i >= 3 and ts[i - 2].text == "type" and ts[i - 3].text == "import")


def _types_only(clause: list[Token]) -> bool:
    """`type` before the whole clause, or before each of its names."""
    texts = [t.text for t in clause]
    if texts[:1] == ["type"] and len(texts) > 1 and texts[1] != ",":
        return True
    if texts[:1] != ["{"]:
        return False
    names = " ".join(texts[1:-1]).split(" , ")
    names = [x.strip(" ,") for x in names if x.strip(" ,")]
    return bool(names) and all(x.startswith("type ") and x != "type as" for x in names)


def import_references(files: DataFrame, packages: DataFrame, path: str = "path", text: str = "text", package: str = "package") -> DataFrame:
    """(path, package, specifier, kind) for the references of each file that a package owns."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, s, k) for p, t in zip(b[path], b[text]) for s, k in references(t or "")], columns=[path, "specifier", "kind"])

    found = files.select(path, text).mapInPandas(scan, f"`{path}` string, specifier string, kind string")
    return prefix_join(found, packages, "specifier", package).select(path, package, "specifier", "kind")


def utf16(s: str, i: int) -> int:
    """Offset in UTF-16 code units of a code point offset."""
    return i if s.isascii() else len(s[:i].encode("utf-16-le", "surrogatepass")) // 2


_CALLABLE = re.compile(r"^(if|for|while|switch|catch|function|return|typeof|new|super|await|async|import|require|constructor)$")


def declarations(s: str) -> list[tuple[str, str, str, int, int, int, int]]:
    """(kind, name, qualified name, start, end, line, column): functions, classes, methods, interfaces, type aliases, enums, arrow functions of variables."""
    ts, out, classes = list(tokens(s)), [], []
    at = lambda i: ts[i].text if 0 <= i < len(ts) else ""

    def close(i: int, opens: str = "{", closes: str = "}") -> int:
        depth = 0
        for j in range(i, len(ts)):
            if ts[j].kind == "mark":
                depth += (ts[j].text == opens) - (ts[j].text == closes)
                if depth == 0:
                    return j
        return len(ts) - 1

    def body(i: int) -> int:
        """Index of the token that ends a declaration whose head starts at i."""
        j = i
        while j < len(ts) and at(j) not in ("{", ";"):
            j = close(j, "(", ")") + 1 if at(j) == "(" else j + 1
        return close(j) if at(j) == "{" else min(j, len(ts) - 1)

    def add(kind: str, i: int, name: str, end: int) -> None:
        owner = next((n for n, a, b in reversed(classes) if a < i < b), None)
        line = s.count("\n", 0, ts[i].start)
        col = ts[i].start - (s.rfind("\n", 0, ts[i].start) + 1)
        out.append((kind, name, f"{owner}.{name}" if owner else name, utf16(s, ts[i].start), utf16(s, ts[end].end), line + 1, utf16(s[ts[i].start - col :], col) + 1))

    for i, t in enumerate(ts):
        named = i + 1 < len(ts) and ts[i + 1].kind == "word"
        if t.text in ("class", "interface", "enum") and named and at(i - 1) != ".":
            end = body(i + 2)
            add(t.text, i, at(i + 1), end)
            if t.text == "class":
                classes.append((at(i + 1), i, end))
        elif t.text == "function" and (named or at(i + 1) == "*"):
            name = at(i + 1) if named else at(i + 2)
            add("function", i, name, body(i + 1))
        elif t.text == "type" and named and at(i + 2) in ("=", "<") and at(i - 1) != ".":
            j = i
            while j + 1 < len(ts) and at(j) != ";":
                j = close(j) if at(j) == "{" else j
                j += 1
            add("type", i, at(i + 1), j)
        elif t.text in ("const", "let", "var") and named and at(i + 2) == "=":
            j = i + 3 + (at(i + 3) == "async")
            k = close(j, "(", ")") if at(j) == "(" else j
            while k + 1 < len(ts) and at(k + 1) not in ("=>", ";", ",", "{", "="):
                k += 1
            if at(k + 1) == "=>":
                end = close(k + 2) if at(k + 2) == "{" else next((x for x in range(k + 2, len(ts)) if at(x) == ";"), len(ts) - 1)
                add("arrow", i + 1, at(i + 1), end)
        elif t.kind == "word" and at(i + 1) == "(" and any(a < i < b and t.depth == ts[a].depth + 1 for _, a, b in classes) and not (_CALLABLE.match(t.text) and t.text != "constructor"):
            j = close(i + 1, "(", ")") + 1
            while j < len(ts) and at(j) not in ("{", ";", "}", "=", "(", ")"):
                j += 1
            if at(j) == "{" and at(i - 1) not in (".", "?.", "new", "=", "return", "("):
                add("method", i, t.text, close(j))
    return out


def calls(s: str) -> list[tuple[str, int]]:
    """(callee text, start) of calls and `new` expressions."""
    ts, out = list(tokens(s)), []
    for i, t in enumerate(ts):
        if t.kind == "word" and i + 1 < len(ts) and ts[i + 1].text == "(" and not _CALLABLE.match(t.text) and (i == 0 or ts[i - 1].text != "function"):
            out.append((t.text, utf16(s, t.start)))
    return out


DECLARATIONS = "path string, id string, name string, qualified_name string, kind string, start_off long, end_off long, line long, col long"


def declaration_facts(files: DataFrame) -> DataFrame:
    """Declarations of files (path, text)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, f"{p}:{l}:{c}:{n}", n, q, k, s, e, l, c) for p, t in zip(b["path"], b["text"]) for k, n, q, s, e, l, c in declarations(t or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DECLARATIONS.split(", ")])

    return files.select("path", "text").mapInPandas(scan, DECLARATIONS)


def call_graph(files: DataFrame) -> DataFrame:
    """(id, name, calls): a call counts for every function around it; callees bind by name within the file, else across files, else are external."""
    d = declaration_facts(files)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, n, o) for p, t in zip(b["path"], b["text"]) for n, o in calls(t or "")], columns=["path", "callee", "at"])

    c = files.select("path", "text").mapInPandas(scan, "path string, callee string, at long")
    own = d.where(F.col("kind").isin("function", "method", "arrow"))
    bodies = own.select("path", "id", F.col("qualified_name").alias("name"), "start_off", "end_off")
    inside = bodies.join(c, "path").where("start_off < at and at < end_off")
    here = d.where("kind <> 'interface'").groupBy("path", F.col("name").alias("callee")).agg(F.min("id").alias("here"))
    there = d.where("kind <> 'interface'").groupBy(F.col("name").alias("callee")).agg(F.min("id").alias("there"))
    to = inside.join(here, ["path", "callee"], "left").join(there, "callee", "left")
    to = to.withColumn("to", F.coalesce("here", "there", F.concat(F.lit("external:"), "callee")))
    got = to.groupBy("id").agg(F.array_sort(F.collect_set("to")).alias("calls"))
    return bodies.select("id", "name").join(got, "id", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
