"""Sources and sinks on small inline inputs."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.sources import code_search, documents, facts, files, sinks, tree
from graphloom.streaming import incremental


@pytest.fixture
def project(tmp_path):
    for p, t in {"src/a.ts": "export const a = 1;\n", "src/lib/b.d.ts": "declare const b: 1;\n", "test/a.test.ts": "a;\n", "node_modules/x/i.js": "x", "README.md": "# Top\ntext\n", "docs/secret.md": "no", "docs/d.md": "# D\n"}.items():
        (tmp_path / "p" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / p).write_text(t)
    (tmp_path / "p" / "bin.ts").write_bytes(b"a\0b")
    return str(tmp_path / "p")


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_files(spark, project):
    f = files.text_files(spark, project)
    assert paths(f) == ["README.md", "docs/d.md", "docs/secret.md", "src/a.ts", "src/lib/b.d.ts", "test/a.test.ts"]
    assert {r.path: (r.is_test, r.is_declaration) for r in f.collect()}["src/lib/b.d.ts"] == (False, True)
    assert paths(files.source_files(f)) == ["src/a.ts", "test/a.test.ts"]
    assert paths(files.text_files(spark, project, ["src/**/*.ts"])) == ["src/a.ts", "src/lib/b.d.ts"]
    assert paths(files.documentation(f)) == ["README.md", "docs/d.md"]
    with pytest.raises(files.NothingMatched):
        files.text_files(spark, project, ["lib/**"], required=True)


def test_memory_and_overlay(spark):
    m = files.in_memory(spark, [("a.ts", "﻿one"), ("b.ts", "two")])
    assert {r.path: r.text for r in m.collect()}["a.ts"] == " one"
    o = files.overlaid(m, spark.createDataFrame([("b.ts", "new")], "path string, text string"))
    assert {r.path: r.text for r in o.collect()} == {"a.ts": " one", "b.ts": "new"}
    with pytest.raises(PySparkException):
        files.overlaid(m, spark.createDataFrame([("c.ts", "x")], "path string, text string")).collect()
    with pytest.raises(PySparkException):
        files.in_memory(spark, [("../a.ts", "x")]).collect()


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}')
    (tmp_path / "c.json").write_text("{broken")
    d = documents.json_documents(spark, str(tmp_path))
    assert d.where("error is not null").count() == 1
    e = documents.elements(d)
    assert sorted((r.element_pos, r.x) for r in e.select("element_pos", F.try_variant_get("value", "$.x", "int").alias("x")).collect()) == [(0, 1), (0, 3), (1, 2)]
    with pytest.raises(Exception, match="(?s)(?i)json"):
        documents.json_documents(spark, str(tmp_path), tolerant=False).collect()


def test_facts(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "f:1:1:a", "name": "a", "calls": ["f:2:1:b", "external:x"]}, {"id": "f:2:1:b", "name": "b", "calls": []}]))
    (tmp_path / "r.json").write_text(json.dumps([{"id": "f:1:1:a", "name": "a", "references": [{"id": "f:2:1:b", "name": "b"}]}]))
    rec = {"id": "f:3:1:v", "name": "v", "owner": "a", "ownerId": "f:1:1:a", "kind": "variable", "declaredAt": {"filePath": "f", "line": 3, "column": 1}, "initializer": {"definedBy": "b()", "dependsOn": ["b"], "dependencyIds": ["f:2:1:b"]}, "assignments": [{"definedBy": "c", "dependsOn": ["c"], "dependencyIds": ["f:3:1:v"], "location": {"filePath": "f", "line": 4, "column": 1}}], "reads": ["v"], "readSites": [{"text": "v", "filePath": "f", "line": 5, "column": 2, "ownerId": "f:2:1:b"}]}
    (tmp_path / "d.json").write_text(json.dumps([rec]))
    from graphloom.plans import graph

    records = facts.definition_use(spark, str(tmp_path / "d.json"))
    e = graph.property_edges(facts.call_graph(spark, str(tmp_path / "c.json")), facts.owner_references(spark, str(tmp_path / "r.json")), records)
    got = {(r.from_id, r.to_id, r.relation): r.evidence for r in e.collect()}
    assert got == {("f:1:1:a", "f:2:1:b", "calls"): None, ("f:1:1:a", "external:x", "calls"): None, ("f:1:1:a", "f:2:1:b", "references"): "b", ("f:3:1:v", "f:2:1:b", "initializes_from"): "v = b()", ("f:2:1:b", "f:3:1:v", "reads"): "a reads v"}
    s = [r.statement for r in sinks.cypher_records(records).orderBy("seq").collect()]
    assert len([x for x in s if x.startswith("CREATE")]) == 5 and any("DEPENDS_ON" in x for x in s) and any("READS" in x for x in s)
    (tmp_path / "t.json").write_text(json.dumps({"symbols": [{"id": "s1", "name": "A", "flags": ["x"]}], "types": [{"id": "type:000001", "kind": "array", "displayText": "A[]", "elementType": "type:000002"}], "signatures": [], "callSites": [{"id": "c1", "kind": "call", "line": 2}]}))
    t = facts.type_tables(spark, str(tmp_path / "t.json"))
    assert t["symbols"].first().name == "A" and t["signatures"].count() == 0 and t["call_sites"].first().line == 2
    assert t["types"].select(F.variant_get("payload", "$.elementType", "string")).first()[0] == "type:000002"


def test_trees(spark, project, tmp_path):
    assert "src/lib/b.d.ts" in paths(tree.listing(spark, project)) and not any("node_modules" in p for p in paths(tree.listing(spark, project)))
    e = {r.path: r.is_dir for r in tree.entries(tree.listing(spark, project)).collect()}
    assert e["src"] and e["src/lib"] and not e["src/a.ts"]
    plan = tree.flattened(spark.createDataFrame([('{"a": {"b": null, "c": {}}, "d.txt": 0}',)], "text string"), "text")
    assert {r.path: r.is_dir for r in plan.collect()} == {"a": True, "a/b": False, "a/c": True, "d.txt": False}
    out = str(tmp_path / "out")
    assert tree.skeleton(plan, out) == {"folders": 2, "files": 2, "skipped": 0}
    assert tree.skeleton(plan, out)["skipped"] == 2
    with pytest.raises(PySparkException):
        tree.flattened(spark.createDataFrame([('{"..": {}}',)], "text string"), "text").collect()
    x = tree.expanded(spark.createDataFrame([("s/*/i.ts",), ("k",)], "path string"), spark.createDataFrame([("a",), ("b",)], "service string"))
    assert paths(x) == ["k", "s/a/i.ts", "s/b/i.ts"]


def test_code_search(spark):
    def fetch(package, extension, page):
        if extension not in ("js", "ts"):
            return [], 0, False
        return [(f"{package}/r{page}", f"src/{extension}{page}.{extension}", f"sha{page}")], 3, page < 3

    h = code_search.search(spark, ["p", "q"], fetch, pages=2)
    assert h.count() == 8
    assert code_search.candidates(h).count() == 8 and code_search.blobs(code_search.candidates(h)).count() == 2
    assert code_search.candidates(h, 3).count() == 3
    waits = []

    def broken(*_):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        code_search.retried(broken, attempts=5, sleep=waits.append)
    assert waits == [1, 2, 4, 8]


def test_fair_sample(spark):
    """Three queues that share one path, cap 4, whatever the order of rows."""
    from graphloom.operators.sets import fair_sample

    rows = [("a", "src/x.ts"), ("a", "src/a1.ts"), ("a", "src/a2.ts"), ("b", "src/x.ts"), ("b", "src/b1.ts"), ("c", "src/c1.ts"), ("c", "src/c2.ts")]
    got = [paths(fair_sample(spark.createDataFrame(r, "q string, path string"), "q", ["path"], ["path"], 4)) for r in (rows, rows[::-1])]
    assert got[0] == got[1] == ["src/a1.ts", "src/a2.ts", "src/b1.ts", "src/c1.ts"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("f.ts", 1, 2, "Id", "a\nb")], "f string, l int, c int, k string, t string")
    assert d.select(sinks.match_line(F.col("f"), F.col("l"), F.col("c"), F.col("k"), F.col("t"))).first()[0] == "f.ts:1:2\tId\ta\\nb"
    assert d.select(sinks.markdown_chunk(F.lit("T"), F.lit("a ```` b"))).first()[0] == "### T\n\n`````\na ```` b\n`````\n"
    sinks.write_json_lines(d, str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()[0])["t"] == "a\nb"
    s = spark.createDataFrame([("r", "s1", "a.ts", "x"), ("r", "s1", "b.ts", "x")], "repository string, sha string, path string, text string")
    m = sinks.snapshot(s, str(tmp_path / "snap")).first()
    assert (m.files, m.blobs, m.bytes) == (2, 1, 2)
    with pytest.raises(PySparkException):
        sinks.snapshot(s.withColumn("path", F.lit("/etc/x")), str(tmp_path / "bad"))


def test_waits(spark):
    d = spark.createDataFrame([("7", None, None), (None, "0", 130.0), ("Thu, 01 Jan 1970 00:02:00 GMT", None, None), (None, "3", 1.0)], "h string, r string, s double")
    got = [x[0] for x in d.select(T.retry_after_ms(F.col("h"), F.col("r"), F.col("s"), F.lit(100.0))).collect()]
    assert got == [7000.0, 31000.0, 20000.0, None]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 60}\n{"k": 3}\nbroken\n')
    q = incremental.path_matches(incremental.json_lines(spark, str(tmp_path / "in")), ".k{. > 50}")
    w = q.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert w.awaitTermination(60)
    assert [r.value for r in spark.table("found").collect()] == ["60"]
