"""Outputs: JSON, lines, Markdown, text, Cypher, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import fence_for, json_string, safe_path


def to_json_rows(df: DataFrame) -> DataFrame:
    """(value): one JSON text per row, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    to_json_rows(df).write.text(path)


def match_line(file: Column, line: Column, col: Column, kind: Column, text: Column) -> Column:
    """`file:line:col`, kind and text by tabs, on one line."""
    place = F.concat_ws(":", file, line.cast("string"), col.cast("string"))
    return F.concat_ws("\t", place, kind, F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")))


def markdown_chunk(title: Column, text: Column, language: str = "") -> Column:
    """A heading and the text inside a fence that no line of it closes."""
    f = fence_for(text)
    return F.concat(F.lit("### "), title, F.lit("\n\n"), f, F.lit(f"{language}\n"), text, F.lit("\n"), f, F.lit("\n"))


def cypher(nodes: DataFrame, edges: DataFrame, label: str, relation: str) -> DataFrame:
    """(seq, statement): a constraint, a MERGE per node (id, name), a MATCH and MERGE per edge."""
    head = nodes.sparkSession.createDataFrame([(0, f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{label}) REQUIRE n.id IS UNIQUE;")], "seq int, statement string")
    n = nodes.select(F.lit(1).alias("seq"), F.format_string(f"MERGE (n:{label} {{id: %s}}) SET n.name = %s;", json_string(F.col("id")), json_string(F.col("name"))).alias("statement"))
    e = edges.select(F.lit(2).alias("seq"), F.format_string(f"MATCH (a:{label} {{id: %s}}), (b:{label} {{id: %s}}) MERGE (a)-[:{relation}]->(b);", json_string(F.col("from_id")), json_string(F.col("to_id"))).alias("statement"))
    return head.unionByName(n).unionByName(e)


def cypher_records(records: DataFrame) -> DataFrame:
    """(seq, statement) for definition-use records: symbols, their functions, files, expressions and read sites."""
    q = json_string
    key = lambda label, name, c: F.format_string(f"MERGE (n:{label} {{{name}: %s}});", q(c))
    link = lambda la, ka, a, rel, lb, kb, b: F.format_string(f"MATCH (a:{la} {{{ka}: %s}}), (b:{lb} {{{kb}: %s}}) MERGE (a)-[:{rel}]->(b);", q(a), q(b))
    kinds = (("Symbol", "id"), ("Function", "name"), ("File", "path"), ("Expression", "text"), ("Reference", "id"))
    head = records.sparkSession.createDataFrame([(0, f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{a}) REQUIRE n.{b} IS UNIQUE;") for a, b in kinds], "seq int, statement string")
    c = F.col
    a = records.select("id", F.explode("assignments").alias("a"))
    s = records.select("id", F.explode("read_sites").alias("s")).withColumn("site", F.concat_ws(":", "s.file_path", c("s.line").cast("string"), c("s.col").cast("string"), "s.text"))
    d = records.select("id", F.explode("initializer.dependency_ids").alias("to"))
    out = lambda df, seq, col: df.where(col.isNotNull()).select(F.lit(seq).alias("seq"), col.alias("statement"))
    parts = [
        out(records, 1, F.format_string("MERGE (n:Symbol {id: %s}) SET n.name = %s, n.kind = %s;", q(c("id")), q(c("name")), q(c("kind")))),
        out(records.where("owner is not null").select("owner").distinct(), 1, key("Function", "name", c("owner"))),
        out(records.select(c("declared_at.file_path").alias("f")).where("f is not null").distinct(), 1, key("File", "path", c("f"))),
        out(records.select(c("initializer.defined_by").alias("x")).union(a.select("a.defined_by")).where("x is not null").distinct(), 1, key("Expression", "text", c("x"))),
        out(s.select("site").distinct(), 1, key("Reference", "id", c("site"))),
        out(records.where("owner is not null"), 2, link("Function", "name", c("owner"), "OWNS", "Symbol", "id", c("id"))),
        out(records.where("declared_at.file_path is not null"), 2, link("Symbol", "id", c("id"), "DECLARED_IN", "File", "path", c("declared_at.file_path"))),
        out(records.where("initializer.defined_by is not null"), 2, link("Symbol", "id", c("id"), "INITIALIZED_BY", "Expression", "text", c("initializer.defined_by"))),
        out(a.where("a.defined_by is not null"), 2, link("Symbol", "id", c("id"), "ASSIGNED", "Expression", "text", c("a.defined_by"))),
        out(d, 2, link("Symbol", "id", c("id"), "DEPENDS_ON", "Symbol", "id", c("to"))),
        out(s, 2, link("Reference", "id", c("site"), "READS", "Symbol", "id", c("id"))),
    ]
    for p in parts:
        head = head.unionByName(p)
    return head


def snapshot(files: DataFrame, out: str) -> DataFrame:
    """Write (repository, sha, path, text) as a table by repository, and return its manifest; unsafe paths fail the query."""
    ok = files.withColumn("path", F.when(safe_path(F.col("path")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), "path"))))
    ok.write.mode("overwrite").partitionBy("repository").parquet(f"{out}/files")
    done = files.sparkSession.read.parquet(f"{out}/files")
    return done.groupBy("repository").agg(F.count("*").alias("files"), F.count_distinct("sha").alias("blobs"), F.sum(F.octet_length("text")).alias("bytes"))


def guarded(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Output paths, failing the query where one is a source."""
    hit = targets.join(sources.select("path", F.lit(True).alias("_src")), "path", "left")
    return hit.withColumn("path", F.when(F.col("_src"), F.raise_error(F.concat(F.lit("output is a source: "), "path"))).otherwise(F.col("path"))).drop("_src")
