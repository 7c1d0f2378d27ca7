"""Facts that a checker has written as JSON: call, owner-reference and definition-use graphs, type tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layouts of the graph and type documents.
_PLACE = "struct<filePath:string,line:int,column:int>"
_SOURCE = "definedBy:string,dependsOn:array<string>,dependencyIds:array<string>"
CALLS = "id string, name string, calls array<string>"
REFERENCES = "id string, name string, references array<struct<id:string,name:string>>"
RECORDS = f"id string, name string, owner string, ownerId string, kind string, declaredAt {_PLACE}, initializer struct<{_SOURCE}>, assignments array<struct<{_SOURCE},location:{_PLACE}>>, reads array<string>, readSites array<struct<text:string,filePath:string,line:int,column:int,ownerId:string>>"
SYMBOLS = "id string, name string, qualifiedName string, kind string, flags array<string>, external boolean, aliasTarget string, declaredType string, valueType string"
SIGNATURES = "id string, kind string, parameters array<struct<name:string,type:string,optional:boolean,rest:boolean,annotation:string>>, returnType string, returnAnnotation string"
CALL_SITES = "id string, kind string, filePath string, line int, column int, resolution string, resultType string, calleeSymbol string, declarationSignature string, resolvedSignature string"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def call_graph(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, CALLS)


def owner_references(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, REFERENCES)


def definition_use(spark: SparkSession, path: str) -> DataFrame:
    """Records under the names that `plans.graph.property_edges` reads."""
    d = _rows(spark, path, RECORDS)
    place = lambda c: f"struct({c}.filePath as file_path, {c}.line as line, {c}.column as col)"
    source = lambda c: f"{c}.definedBy as defined_by, {c}.dependsOn as depends_on, {c}.dependencyIds as dependency_ids"
    return d.select(
        "id", "name", "owner", F.col("ownerId").alias("owner_id"), "kind",
        F.expr(place("declaredAt")).alias("declared_at"),
        F.expr(f"struct({source('initializer')})").alias("initializer"),
        F.expr(f"transform(assignments, a -> struct({source('a')}, {place('a.location')} as location))").alias("assignments"),
        "reads",
        F.expr("transform(readSites, s -> struct(s.text as text, s.filePath as file_path, s.line as line, s.column as col, s.ownerId as owner_id))").alias("read_sites"),
    )


def type_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """symbols, types (payload as VARIANT), signatures and call sites of type documents, one row per id."""
    doc = spark.read.text(path, wholetext=True)
    part = lambda name, schema: doc.select(F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), f"array<struct<{schema}>>")).alias("x")).select("x.*")
    typed = lambda s: ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in s.split(", "))
    types = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.types"), "array<string>")).alias("t"))
    types = types.select(F.get_json_object("t", "$.id").alias("id"), F.get_json_object("t", "$.kind").alias("kind"), F.get_json_object("t", "$.displayText").alias("display_text"), F.parse_json("t").alias("payload"))
    return {"symbols": part("symbols", typed(SYMBOLS)), "types": types, "signatures": part("signatures", typed(SIGNATURES)), "call_sites": part("callSites", typed(CALL_SITES))}
