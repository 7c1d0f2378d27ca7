"""Choices of symbols, nodes, edges and declarations that questions about code ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.joins import sized


def symbol_lookup(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request, status, id, candidates, n) of names (request, name, file) among symbols (id, name, qualified_name, file_path).

    A name matches a simple or a qualified one, in the file if one is given.  One match
    is found; several (n) are ambiguous, and their ids are listed.  Matches are counted
    once for each name, and name and file, not for each request; lists that are not
    selected are not made.
    """
    s = symbols.where("id is not null").select("id", "file_path", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    anywhere = s.select("name", F.lit(None).cast("string").alias("file"), "id")
    within = s.where("file_path is not null").select("name", F.col("file_path").alias("file"), "id")
    found = anywhere.unionByName(within).distinct().groupBy("name", "file")
    found = found.agg(F.count("*").alias("n"), F.min("id").alias("_id"), F.array_sort(F.collect_list("id")).alias("candidates"))
    r = requests.select("request", F.col("name").alias("_name"), F.col("file").alias("_file"))
    d = r.join(found.hint("merge"), (F.col("_name") == F.col("name")) & F.col("_file").eqNullSafe(F.col("file")), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    status = F.when(n == 0, "not-found").when(n == 1, "found").otherwise("ambiguous")
    return d.select("request", status.alias("status"), F.when(n == 1, F.col("_id")).alias("id"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), n.alias("n"))


def between(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, ...) both of whose ends are selected (id)."""
    for end in ("from_id", "to_id"):
        edges = edges.join(selected.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(id, neighbour): direct callees of ids, or with `incoming` direct callers."""
    a, b = ("from_id", "to_id") if direction == "outgoing" else ("to_id", "from_id")
    return edges.select(F.col(a).alias("id"), F.col(b).alias("neighbour")).distinct().join(ids.select("id"), "id", "left_semi")


def declared_here(path: Column, modules: bool = True, libraries: bool = False) -> Column:
    """Whether a declaration's file takes part: packages below node_modules, and the language's own `lib.*.d.ts`, by switches."""
    library = path.rlike(r"(^|/)typescript/lib/lib\.[^/]*\.d\.ts$|(^|/)lib\.[^/]*\.d\.ts$")
    return F.when(library, F.lit(libraries)).when(path.contains("node_modules/"), F.lit(modules)).otherwise(F.lit(True))


def schema_candidates(types: DataFrame, text: str | None = None, file: str | None = None) -> DataFrame:
    """Types (name, file_path) in a file, and whose name or path holds a text in any case; by path, then name."""
    if file is not None:
        types = types.where(F.col("file_path") == file)
    if text is not None:
        types = types.where(F.contains(F.lower(F.concat_ws("\0", "name", "file_path")), F.lit(text.lower())))
    return types.orderBy("file_path", "name")


def _around(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds)).select(F.col("file").alias("_f"), F.col("start").alias("_s"), F.col("end").alias("_e"))


def inside_kinds(nodes: DataFrame, inner: list[str], outer: list[str]) -> DataFrame:
    """Nodes (file, kind, start, end) of the inner kinds that a node of an outer kind of the file holds."""
    n, o = nodes.where(F.col("kind").isin(*inner)), _around(nodes, outer)
    return n.join(o, (F.col("file") == F.col("_f")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")), "left_semi")


def without_kinds(nodes: DataFrame, outer: list[str], forbidden: list[str]) -> DataFrame:
    """Nodes of the outer kinds that hold no node of a forbidden kind."""
    n, o = nodes.where(F.col("kind").isin(*outer)), _around(nodes, forbidden)
    return n.join(o, (F.col("file") == F.col("_f")) & (F.col("start") <= F.col("_s")) & (F.col("_e") <= F.col("end")), "left_anti")


def within_declarations(points: DataFrame, declarations: DataFrame) -> DataFrame:
    """Detections (file, start, end) that lie in a selected declaration (file, start, end)."""
    o = declarations.select(F.col("file").alias("_f"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return points.join(o, (F.col("file") == F.col("_f")) & (F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")), "left_semi")


def aligned_sites(candidates: DataFrame, sites: DataFrame, compatible: DataFrame) -> DataFrame:
    """(candidate, site, status) of candidates (candidate, file, start, kind) and call sites (site, file, start, site_kind).

    They meet at one place with a compatible kind (kind, site_kind); exactly one site is
    a match, none or several reject the candidate.
    """
    hit = candidates.join(sized(compatible), "kind").join(sites, ["file", "start", "site_kind"])
    n = hit.groupBy("candidate").agg(F.count("*").alias("n"), F.min("site").alias("site"))
    d = candidates.select("candidate").join(n, "candidate", "left")
    status = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "several").otherwise("none")
    return d.select("candidate", F.when(F.col("n") == 1, F.col("site")).alias("site"), status.alias("status"))


def imports_of(snippets: DataFrame, references: DataFrame, imports: DataFrame) -> DataFrame:
    """(snippet, statements): import statements whose symbol a snippet refers to, each once, in order of the text."""
    r = references.select("snippet", "file", "symbol").join(snippets.select("snippet"), "snippet", "left_semi")
    return r.join(imports.select("file", "symbol", "statement"), ["file", "symbol"]).groupBy("snippet").agg(F.array_sort(F.collect_set("statement")).alias("statements"))


def logical_declarations(declarations: DataFrame, kinds: tuple[str, ...] = ("function", "method")) -> DataFrame:
    """Declarations (id, file, kind, name, start) with the id of their logical target and their overload index from 0.

    Overloads are declarations of one name and kind in a file; the first stands for all.
    """
    w = Window.partitionBy("file", "kind", "name").orderBy("start", "id")
    own = ~F.col("kind").isin(*kinds)
    return declarations.withColumn("target", F.when(own, F.col("id")).otherwise(F.first("id").over(w))).withColumn("overload", F.when(own, 0).otherwise(F.row_number().over(w) - 1).cast("int"))
