"""A project's files, symbols and reports, laid over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import filters, intervals, joins, ordered, sets
from graphloom.plans import graph, scoring, specs
from graphloom.queries import relational
from graphloom.queries.graphs import EDGES, key_edges
from graphloom.session import table
from graphloom.sources import code_search, files, sinks, tree

_TAILS = ["tests/a.test.ts", "index.d.ts", "b.spec.jsx", "../x.mjs", "node_modules/c.js", "win\\d.ts", "README.md", "main.tsx"]
_PATH = "concat('src/', replace(p_name, ' ', '_'), '_', p_partkey, '/', element_at(array({}), cast(p_partkey % 8 + 1 as int)))".format(", ".join("r'{}'".format(t) for t in _TAILS))
_SQL_PATH = "('src/' || replace(p_name, ' ', '_') || '_' || p_partkey || '/' || ([{}])[p_partkey % 8 + 1])".format(", ".join(f"'{t}'" for t in _TAILS))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(_PATH).alias("path"))


def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, d).select(
        "p_partkey",
        text.is_test_path(p).alias("is_test"),
        text.is_declaration_path(p).alias("is_declaration"),
        text.is_source_path(p).alias("is_source"),
        text.safe_path(p).alias("safe"),
        text.excluded(p, "node_modules", "README").alias("excluded"),
        text.posix(p).alias("posix"),
        text.without_extension(p).alias("stem"),
        F.array_join(text.ancestors(p), "|").alias("folders"),
    )


def text_shapes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ticks = F.concat("p_name", F.repeat(F.lit("`"), (F.col("p_partkey") % 7).cast("int")), F.lit(' "x"'))
    return p.select(
        "p_partkey",
        text.slug(F.concat(F.lit("--"), "p_name", F.lit(" & Co. "), "p_brand", F.lit("!"))).alias("slug"),
        text.title_case(F.concat(F.replace("p_name", F.lit(" "), F.lit("-_")), F.lit(" part"))).alias("title"),
        text.fence_for(ticks).alias("fence"),
        text.json_string(ticks).alias("literal"),
        sinks.markdown_chunk(F.col("p_name"), ticks, "ts").alias("chunk"),
        sinks.match_line(F.col("p_brand"), F.col("p_size"), F.col("p_partkey"), F.col("p_type"), F.concat("p_name", F.lit("\nx"))).alias("line"),
    )


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.line_count(t).alias("n_lines"), F.sha2(t, 256).alias("sha256"), F.length(files.tidy(F.concat(t, F.lit("\r\n\n")))).cast("long").alias("tidy_chars"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    own = text.stable_id(F.concat(F.lit("f"), "l_partkey", F.lit(".ts")), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_returnflag"))
    id_ = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("external:"), "l_returnflag")).otherwise(own)
    return li.select("l_orderkey", "l_linenumber", id_.alias("id"), text.parse_stable_id(id_).alias("x")).select("l_orderkey", "l_linenumber", "id", "x.file", "x.line", "x.col", "x.name")


def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """Waits by header, date, rate limit, and growing back-off."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 4
    header = F.when(k == 0, "120").when(k == 1, F.concat(F.lit("Wed, "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    wait = text.retry_after_ms(header, F.when(k == 2, "0").otherwise("5"), F.lit(800_000_060.0), F.lit(800_000_000.0))
    return o.select("o_orderkey", wait.alias("wait_ms"), text.backoff(F.col("o_orderkey") % 9 + 1, 1.0, 30.0).alias("backoff_s"))


def containment_join(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    ids = table(spark, d, "part").where("p_type = 'ECONOMY'").select("p_partkey")
    return joins.contains_join(li, ids, "parts", "p_partkey").select("l_orderkey", "p_partkey")


def bijective_binding(spark: SparkSession, d: str) -> DataFrame:
    return joins.bijective(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("end"))


_NODES = "n AS (SELECT l_orderkey AS file, l_returnflag AS kind, CAST(l_linenumber * 10 AS BIGINT) AS start, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS \"end\" FROM lineitem)"


def preorder_numbers(spark: SparkSession, d: str) -> DataFrame:
    return graph.preorder(_nodes(spark, d).select("file", "start", "end"), "file", "start", "end")


def type_context(spark: SparkSession, d: str) -> DataFrame:
    return filters.inside_kinds(_nodes(spark, d), ["A"], ["R"])


def forbidden_syntax(spark: SparkSession, d: str) -> DataFrame:
    return filters.without_kinds(_nodes(spark, d), ["N"], ["A", "R"])


def selected_detections(spark: SparkSession, d: str) -> DataFrame:
    """Ranges within the declarations of their file, one for each order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.lit(20).cast("long").alias("start"), (F.lit(20) + F.col("o_custkey") % 60).cast("long").alias("end"))
    return filters.within_declarations(_nodes(spark, d), o)


def code_slice_roles(spark: SparkSession, d: str) -> DataFrame:
    e = key_edges(spark, d)
    types = e.where("relation = 'part_of'")
    own = e.select(F.col("from_id").alias("id")).distinct().select("id", F.lit("f").alias("file_path"), F.lit(0).alias("start_off"), F.lit(1).alias("end_off"), F.lit(False).alias("external"))
    s = graph.code_slice(own, e, types, spark.createDataFrame([("nation:3",)], "id string"), 1, 2**31 - 2)["selections"]
    return s.select("id", F.array_join("roles", ",").alias("roles"), F.col("distance").cast("int"))


def impact_truncated(spark: SparkSession, d: str) -> DataFrame:
    """The report's flag for caps below and above what is reached."""
    e, t, rows = key_edges(spark, d), spark.createDataFrame([("nation:3",)], "id string"), []
    for cap in (5, 2**31 - 2):
        r, cut = graph.impact_report(e, t, 2, cap, "incoming")
        rows.append((cap, r.count(), cut))
    return spark.createDataFrame(rows, "cap long, nodes long, truncated boolean")


def confident_detections(spark: SparkSession, d: str) -> DataFrame:
    return scoring.at_least(relational.score_caps(spark, d), "medium")


def nearest_config(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.expr("concat('a', p_partkey % 5, '/b', p_partkey % 7, '/c', p_partkey, '.ts')").alias("path"))
    f = table(spark, d, "nation").select(F.expr("concat(case n_nationkey % 3 when 0 then '' when 1 then concat('a', n_nationkey % 5, '/') else concat('a', n_nationkey % 5, '/b', n_nationkey % 7, '/') end, 'tsconfig.json')").alias("file")).distinct()
    return joins.nearest_ancestor(p, f, "path", "tsconfig.json")


def tree_entries(spark: SparkSession, d: str) -> DataFrame:
    return tree.entries(_paths(spark, d).select("path"))


def overlaid_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a third of the texts replaced; test files and hashes are told, declarations and packages left out."""
    f = _paths(spark, d).join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text")), "p_partkey")
    f = f.where(text.safe_path(F.col("path"))).select("path", "text")
    o = f.where(F.length("text") % 3 == 0).select("path", F.concat(F.lit("// "), "text").alias("text"))
    return files.source_files(files.overlaid(f, o)).select("path", "text", "sha256", "is_test")


def readable_files(spark: SparkSession, d: str) -> DataFrame:
    return files.allowed(_paths(spark, d).select("path"))


def blob_choice(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("repository"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("path"))
    return code_search.blobs(li)


def search_jobs(spark: SparkSession, d: str) -> DataFrame:
    return code_search.jobs(table(spark, d, "nation"), "n_name")


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.to_json_rows(table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("n_regionkey")))


def guarded_outputs(spark: SparkSession, d: str) -> DataFrame:
    return sinks.guarded(table(spark, d, "supplier").select(F.concat(F.lit("out/"), "s_name").alias("path")), table(spark, d, "supplier").select(F.concat(F.lit("src/"), "s_name").alias("path")))


def direct_callers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    e = key_edges(spark, d)
    return filters.neighbours(e, n, "incoming").withColumn("direction", F.lit("incoming")).unionByName(filters.neighbours(e, n).withColumn("direction", F.lit("outgoing")))


def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Requests by simple or qualified name, some within a file: found, ambiguous or not found."""
    s = table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("qualified_name"), F.col("p_type").alias("file_path"))
    r = table(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("request"), F.expr("case p_partkey % 4 when 0 then p_name when 1 then concat_ws('.', p_brand, p_name, p_partkey) when 2 then concat(p_name, '?') else p_name end").alias("name"), F.expr("if(p_partkey % 4 = 3, p_type, null)").alias("file"))
    return filters.symbol_lookup(r, s).select("request", "status", "id", "n")


def selected_edges(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id")).unionByName(table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id")))
    return filters.between(key_edges(spark, d), ids).select("from_id", "to_id")


def declaration_scope(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr("concat(element_at(array('src/', 'node_modules/x/', 'node_modules/typescript/lib/lib.'), cast(p_partkey % 3 + 1 as int)), p_partkey, '.d.ts')")
    c = lambda *a: filters.declared_here(F.col("path"), *a)
    return table(spark, d, "part").select("p_partkey", p.alias("path")).select("p_partkey", c().alias("plain"), c(False, False).alias("own"), c(True, True).alias("every"))


def schema_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("file_path"))
    return filters.schema_candidates(t, "RING").select("p_partkey")


def call_site_alignment(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_extendedprice")
    c = li.groupBy("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind")).agg(F.min("l_partkey").alias("p")).select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "kind").alias("candidate"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start"), "kind")
    s = li.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("site"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start"), F.col("l_linestatus").alias("site_kind"))
    return filters.aligned_sites(c, s, spark.createDataFrame([("A", "F"), ("R", "F"), ("N", "O")], "kind string, site_kind string"))


def snippet_imports(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("snippet"))
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("snippet"), F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol"))
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol"), F.concat(F.lit("import "), F.col("l_suppkey").cast("string")).alias("statement")).distinct()
    return filters.imports_of(s, r, i).select("snippet", F.array_join("statements", ";").alias("statements"))


def logical_declarations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.expr("if(p_size % 2 = 0, 'function', 'class')").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("start"))
    return filters.logical_declarations(p).select("id", "target", "overload")


def file_sets(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of two overlapping sets of files."""
    p = table(spark, d, "part").select(F.col("p_name").alias("path"), "p_type").distinct()
    a, b = p.where("p_type = 'ECONOMY'").select("path", F.lit("a").alias("origin")), p.where("p_type <> 'ECONOMY'").select("path", F.lit("b").alias("origin")).distinct()
    tag = lambda df, n: df.withColumn("what", F.lit(n))
    return tag(sets.united(a, b), "union").unionByName(tag(sets.shared(a, b), "both")).unionByName(tag(sets.omitted(b, a), "rest"))


def template_keys(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("A",), ("N",)], "l_returnflag string")
    return sets.covered_keys(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), t, "l_orderkey", "l_returnflag")


def numbered_results(spark: SparkSession, d: str) -> DataFrame:
    """Places of rows by the named orders of nodes, edges, detections, matches, chunks, hits and plans, within a key each."""
    own = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    li = table(spark, d, "lineitem").select(*own, "l_quantity")
    # dealt by key once; parts grow in number with the input, and a fixed number is not coalesced, so that a task's sorts stay small
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * li.rdd.getNumPartitions())
    li = li.repartition(n, "l_orderkey").groupBy(*own).agg(F.max("l_quantity").alias("q"))
    c, s = F.col, lambda x: F.col(x).cast("string")
    named = {
        "nodes": [s("l_partkey").alias("qualified_name"), s("l_suppkey").alias("file_path"), c("l_linenumber").alias("line"), s("l_partkey").alias("id")],
        "edges": [s("l_suppkey").alias("from_id"), s("l_partkey").alias("to_id"), s("l_linenumber").alias("relation")],
        "detections": [c("q").alias("score"), s("l_partkey").alias("pattern"), F.concat_ws("/", s("l_suppkey"), s("l_linenumber")).alias("file")],
        "matches": [s("l_partkey").alias("file"), c("l_linenumber").alias("start"), c("l_suppkey").alias("end")],
        "chunks": [c("q").alias("relevance"), F.concat_ws("/", s("l_partkey"), s("l_suppkey")).alias("file"), c("l_linenumber").alias("start_line")],
        "hits": [s("l_suppkey").alias("repository"), s("l_partkey").alias("path"), s("l_linenumber").alias("sha")],
        "plans": [c("q").alias("width"), s("l_partkey").alias("rule_id"), F.concat_ws("/", s("l_suppkey"), s("l_linenumber")).alias("candidate_id")],
    }
    before = li.columns
    for name, cols in named.items():  # sorted in place for one order after another
        before = [*before, name]
        li = ordered.numbered(li.select("*", *cols), ["l_orderkey"], ordered.named(name), name).select(*before)
    return li.unpivot(own, list(named), "order_name", "place")


def first_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The feature's own cap: the first 20 by file, place, code and message, and how many more there are."""
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("start"), F.col("value").alias("code"), F.col("props").alias("message"))
    rows, left = ordered.first_of(e, ordered.named("diagnostics"), 20)
    return rows.select("file", "start", F.lit(left).cast("long").alias("left_out"))


def edits_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Ranges grouped by file with their distinct kinds and number."""
    n = _nodes(spark, d)
    return n.groupBy("file").agg(F.count("*").alias("edits"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("end").alias("last"))


def schema_flatten(spark: SparkSession, d: str) -> DataFrame:
    t = F.format_string('{"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "description": "%s"}, "tags": {"type": "array", "items": {"type": "integer", "default": %d}}}}', F.col("n_name"), F.col("n_regionkey"))
    return specs.schema_rows(table(spark, d, "nation").select("n_nationkey", t.alias("t")), "n_nationkey", "t")


def evidence_points(spark: SparkSession, d: str) -> DataFrame:
    e = key_edges(spark, d).select(F.col("to_id").alias("start"), "relation")
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("start"))
    return scoring.evidence_points(e, n, 0.5, 5.0, "nearby").withColumn("points", F.col("points").cast("double"))


def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") * 100).alias("start"), (F.col("o_orderkey") * 100 + 30).alias("end"), F.col("o_orderkey").alias("rank"))
    return intervals.budgeted(o, ["o_custkey"], 100).select("o_custkey", "o_orderkey")


def deep_chain_order(spark: SparkSession, d: str) -> DataFrame:
    """Levels of chains of 70 parts, deeper than any fixed number of rounds that was once set."""
    p = table(spark, d, "part").where("p_partkey % 70 <> 0").select(F.col("p_partkey").cast("string").alias("from_id"), (F.col("p_partkey") - 1).cast("string").alias("to_id"))
    return graph.dependency_levels(p).select("id", F.col("level").cast("int"))


_f = [path_predicates, text_shapes, line_counts, stable_ids, retry_waits, containment_join, bijective_binding, preorder_numbers, type_context, forbidden_syntax, selected_detections, code_slice_roles, impact_truncated, confident_detections, nearest_config, tree_entries, overlaid_sources, readable_files, blob_choice, search_jobs, json_rows, guarded_outputs, direct_callers, symbol_lookup, selected_edges, declaration_scope, schema_candidates, call_site_alignment, snippet_imports, logical_declarations, file_sets, template_keys, numbered_results, first_diagnostics, edits_by_file, schema_flatten, evidence_points, byte_budget, deep_chain_order]
QUERIES = {f.__name__: f for f in _f}

_TICKS = "(p_name || repeat('`', CAST(p_partkey % 7 AS INTEGER)) || ' \"x\"')"
_FENCE = f"repeat('`', CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all({_TICKS}, '`+'), lambda x: length(x))), 0) + 1) AS INTEGER))"
_TITLE = "array_to_string(list_transform(string_split(lower(trim(regexp_replace(replace(p_name, ' ', '-_') || ' part', '[-_\\s]+', ' ', 'g'))), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_SAFE = r"NOT (path LIKE '/%' OR contains(path, '\') OR list_contains(string_split(path, '/'), '..'))"
_ORDER = {
    "nodes": "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_linenumber, CAST(l_partkey AS VARCHAR)",
    "edges": "CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)",
    "detections": "q DESC, CAST(l_partkey AS VARCHAR), l_suppkey || '/' || l_linenumber",
    "matches": "CAST(l_partkey AS VARCHAR), l_linenumber, l_suppkey",
    "chunks": "q DESC, l_partkey || '/' || l_suppkey, l_linenumber",
    "hits": "CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)",
    "plans": "q, CAST(l_partkey AS VARCHAR), l_suppkey || '/' || l_linenumber",
}

ORACLE_SQL = {
    "path_predicates": rf"""SELECT p_partkey, regexp_matches(path, '(^|/)(tests?|__tests__|specs?)/|\.(test|spec)\.[cm]?[jt]sx?$') AS is_test, regexp_matches(path, '\.d\.[cm]?ts$') AS is_declaration,
        regexp_matches(path, '\.[cm]?[jt]sx?$') AS is_source, {_SAFE} AS safe, contains(path, 'node_modules') OR contains(path, 'README') AS excluded, replace(path, '\', '/') AS posix,
        regexp_replace(path, '\.[^./]+$', '') AS stem, array_to_string(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/')), '|') AS folders
        FROM (SELECT p_partkey, {_SQL_PATH} AS path FROM part)""",
    "text_shapes": rf"""SELECT p_partkey, trim(regexp_replace(replace(lower('--' || p_name || ' & Co. ' || p_brand || '!'), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {_TITLE} AS title, {_FENCE} AS fence,
        '"' || replace({_TICKS}, '"', '\"') || '"' AS literal, '### ' || p_name || chr(10) || chr(10) || {_FENCE} || 'ts' || chr(10) || {_TICKS} || chr(10) || {_FENCE} || chr(10) AS chunk,
        p_brand || ':' || p_size || ':' || p_partkey || chr(9) || p_type || chr(9) || p_name || '\nx' AS line FROM part""",
    "line_counts": r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS BIGINT) END AS n_lines, sha256(text) AS sha256,
        length(regexp_replace(replace(text || chr(13) || chr(10) || chr(10), chr(13) || chr(10), chr(10)), '\n+$', '')) AS tidy_chars FROM documents""",
    "stable_ids": """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'external:' || l_returnflag ELSE 'f' || l_partkey || '.ts:' || l_linenumber || ':' || l_suppkey || ':' || l_returnflag END AS id,
        CASE WHEN l_partkey % 5 <> 0 THEN 'f' || l_partkey || '.ts' END AS file, CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber END AS line, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_suppkey AS INTEGER) END AS col, l_returnflag AS name FROM lineitem""",
    "retry_waits": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 120000.0 WHEN 1 THEN greatest(0.0, (epoch(o_orderdate) - 800000000.0) * 1000) WHEN 2 THEN 61000.0 END::DOUBLE AS wait_ms,
        least(30.0, pow(2.0, o_orderkey % 9))::DOUBLE AS backoff_s FROM orders""",
    "containment_join": "SELECT DISTINCT l_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'",
    "bijective_binding": """WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag AS a, l_linestatus AS b FROM lineitem),
        x AS (SELECT l_orderkey, max(n) AS n FROM (SELECT l_orderkey, a, count(*) AS n FROM d GROUP BY ALL) GROUP BY ALL), y AS (SELECT l_orderkey, max(n) AS n FROM (SELECT l_orderkey, b, count(*) AS n FROM d GROUP BY ALL) GROUP BY ALL)
        SELECT l_orderkey FROM x JOIN y USING (l_orderkey) WHERE x.n = 1 AND y.n = 1""",
    "preorder_numbers": f"""WITH {_NODES} SELECT file, start, "end", CAST(row_number() OVER (PARTITION BY file ORDER BY start, "end" DESC) AS INTEGER) AS node_id FROM n""",
    "type_context": f"""WITH {_NODES} SELECT * FROM n WHERE kind = 'A' AND EXISTS (SELECT 1 FROM n o WHERE o.kind = 'R' AND o.file = n.file AND o.start <= n.start AND n."end" <= o."end")""",
    "forbidden_syntax": f"""WITH {_NODES} SELECT * FROM n WHERE kind = 'N' AND NOT EXISTS (SELECT 1 FROM n o WHERE o.kind IN ('A', 'R') AND o.file = n.file AND n.start <= o.start AND o."end" <= n."end")""",
    "selected_detections": f"""WITH {_NODES} SELECT n.* FROM n JOIN orders ON o_orderkey = file WHERE start >= 20 AND "end" <= 20 + o_custkey % 60""",
    "code_slice_roles": f"""WITH {EDGES}, r AS (SELECT 'nation:3' AS id, 'target' AS role, 0 AS d UNION ALL SELECT to_id, 'type', 1 FROM edges WHERE from_id = 'nation:3'
        UNION ALL SELECT to_id, 'outgoing', 1 FROM edges WHERE from_id = 'nation:3' UNION ALL SELECT from_id, 'incoming', 1 FROM edges WHERE to_id = 'nation:3')
        SELECT id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, CAST(min(d) AS INTEGER) AS distance FROM r GROUP BY id""",
    "impact_truncated": f"""WITH {EDGES}, a AS (SELECT from_id AS id FROM edges WHERE to_id = 'nation:3'), b AS (SELECT DISTINCT from_id AS id FROM edges JOIN a ON to_id = a.id UNION SELECT id FROM a)
        SELECT CAST(cap AS BIGINT) AS cap, CAST(least(cap, (SELECT count(*) FROM b)) AS BIGINT) AS nodes, (SELECT count(*) FROM b) > cap AS truncated FROM (VALUES (5), (2147483646)) v(cap)""",
    "confident_detections": f"SELECT * FROM ({relational.ORACLE_SQL['score_caps']}) WHERE confidence IN ('medium', 'high')",
    "nearest_config": """WITH p AS (SELECT 'a' || p_partkey % 5 || '/b' || p_partkey % 7 || '/c' || p_partkey || '.ts' AS path, p_partkey AS k FROM part),
        f AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || n_nationkey % 5 || '/' ELSE 'a' || n_nationkey % 5 || '/b' || n_nationkey % 7 || '/' END AS folder FROM nation)
        SELECT path, max_by(folder, length(folder)) || 'tsconfig.json' AS found FROM p JOIN f ON starts_with(path, folder) GROUP BY path""",
    "tree_entries": f"""WITH p AS (SELECT {_SQL_PATH} AS path FROM part), s AS (SELECT path, string_split(path, '/') AS s FROM p)
        SELECT DISTINCT array_to_string(s[1:n], '/') AS path, true AS is_dir FROM (SELECT s, unnest(range(1, len(s))) AS n FROM s) UNION ALL SELECT path, false FROM p""",
    "overlaid_sources": rf"""WITH p AS (SELECT {_SQL_PATH} AS path, CASE WHEN length(p_name) % 3 = 0 THEN '// ' ELSE '' END || p_name AS text FROM part)
        SELECT path, text, sha256(text) AS sha256, regexp_matches(path, '(^|/)(tests?|__tests__|specs?)/|\.(test|spec)\.[cm]?[jt]sx?$') AS is_test FROM p
        WHERE {_SAFE} AND regexp_matches(path, '\.[cm]?[jt]sx?$') AND NOT contains(path, 'node_modules') AND NOT regexp_matches(path, '\.d\.[cm]?ts$')""",
    "readable_files": f"SELECT path FROM (SELECT {_SQL_PATH} AS path FROM part) WHERE NOT contains(path, 'node_modules/')",
    "blob_choice": """SELECT sha, repository, path FROM (SELECT sha256(CAST(l_partkey AS VARCHAR)) AS sha, 'r' || l_suppkey AS repository, 'p' || l_orderkey AS path FROM lineitem) QUALIFY row_number() OVER (PARTITION BY sha ORDER BY repository, path) = 1""",
    "search_jobs": "SELECT n_name AS package, extension FROM nation, (VALUES ('js'), ('jsx'), ('mjs'), ('cjs'), ('ts'), ('tsx'), ('mts'), ('cts')) v(extension)",
    "json_rows": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"' || CASE WHEN n_regionkey > 1 THEN ',"n_regionkey":' || n_regionkey ELSE '' END || '}' AS value FROM nation""",
    "guarded_outputs": "SELECT 'out/' || s_name AS path FROM supplier",
    "direct_callers": f"""WITH {EDGES} SELECT DISTINCT to_id AS id, from_id AS neighbour, 'incoming' AS direction FROM edges WHERE to_id LIKE 'nation:%' UNION ALL SELECT DISTINCT from_id, to_id, 'outgoing' FROM edges WHERE from_id LIKE 'nation:%'""",
    "symbol_lookup": """WITH s AS (SELECT 's' || p_partkey AS id, p_name AS name, p_brand || '.' || p_name || '.' || p_partkey AS qualified, p_type AS file_path FROM part),
        r AS (SELECT 'q' || p_partkey AS request, CASE p_partkey % 4 WHEN 1 THEN p_brand || '.' || p_name || '.' || p_partkey WHEN 2 THEN p_name || '?' ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 3 THEN p_type END AS file FROM part),
        k AS (SELECT name, file_path, count(*) AS n, min(id) AS id FROM s GROUP BY ALL), a AS (SELECT name, sum(n) AS n, min(id) AS id FROM k GROUP BY ALL),
        h AS (SELECT request, coalesce(q.id, CASE WHEN file IS NULL THEN a.id ELSE k.id END) AS id, CASE WHEN q.id IS NOT NULL THEN 1 WHEN file IS NULL THEN coalesce(a.n, 0) ELSE coalesce(k.n, 0) END AS n
          FROM r LEFT JOIN s q ON q.qualified = r.name LEFT JOIN a ON a.name = r.name LEFT JOIN k ON k.name = r.name AND k.file_path = r.file)
        SELECT request, CASE WHEN n = 0 THEN 'not-found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS id, CAST(n AS BIGINT) AS n FROM h""",
    "selected_edges": f"""WITH {EDGES}, i AS (SELECT 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 0)
        SELECT from_id, to_id FROM edges WHERE from_id IN (SELECT id FROM i) AND to_id IN (SELECT id FROM i)""",
    "declaration_scope": "SELECT p_partkey, p_partkey % 3 < 2 AS plain, p_partkey % 3 = 0 AS own, true AS every FROM part",
    "schema_candidates": "SELECT p_partkey FROM part WHERE contains(lower(p_name || chr(0) || p_type), 'ring')",
    "call_site_alignment": """WITH c AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS start, l_returnflag AS kind FROM lineitem),
        h AS (SELECT c.*, l_orderkey || '/' || l_partkey || '/' || l_suppkey AS site FROM c JOIN lineitem ON l_orderkey = file AND l_linenumber = start AND l_linestatus = CASE WHEN kind = 'N' THEN 'O' ELSE 'F' END),
        n AS (SELECT file, start, kind, count(*) AS n, min(site) AS site FROM h GROUP BY ALL)
        SELECT c.file || '/' || c.start || '/' || c.kind AS candidate, CASE WHEN n = 1 THEN site END AS site, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'several' ELSE 'none' END AS status FROM c LEFT JOIN n USING (file, start, kind)""",
    "snippet_imports": """SELECT o_orderkey AS snippet, string_agg(DISTINCT 'import ' || l_suppkey, ';' ORDER BY 'import ' || l_suppkey) AS statements FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1""",
    "logical_declarations": """WITH p AS (SELECT p_partkey AS id, p_brand AS file, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'class' END AS kind, p_name AS name, p_size AS start FROM part)
        SELECT id, CASE WHEN kind = 'class' THEN id ELSE first_value(id) OVER w END AS target, CASE WHEN kind = 'class' THEN 0 ELSE CAST(row_number() OVER w - 1 AS INTEGER) END AS overload FROM p WINDOW w AS (PARTITION BY file, kind, name ORDER BY start, id)""",
    "file_sets": """WITH a AS (SELECT DISTINCT p_name AS path FROM part WHERE p_type = 'ECONOMY'), b AS (SELECT DISTINCT p_name AS path FROM part WHERE p_type <> 'ECONOMY')
        SELECT path, CASE WHEN path IN (SELECT path FROM a) THEN 'a' ELSE 'b' END AS origin, 'union' AS what FROM (SELECT path FROM a UNION SELECT path FROM b)
        UNION ALL SELECT path, 'a', 'both' FROM a WHERE path IN (SELECT path FROM b) UNION ALL SELECT path, 'b', 'rest' FROM b WHERE path NOT IN (SELECT path FROM a)""",
    "template_keys": """WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem) SELECT l_orderkey, bool_and(f IN ('A', 'N')) AS same, 2 - count(*) FILTER (f IN ('A', 'N')) AS missing FROM d GROUP BY l_orderkey""",
    "numbered_results": "WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL) " + " UNION ALL ".join(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, '{n}' AS order_name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {o}) AS INTEGER) AS place FROM l" for n, o in _ORDER.items()),
    "first_diagnostics": """SELECT user_id AS file, event_id AS start, greatest(0, (SELECT count(*) FROM events WHERE event_type = 'error') - 20) AS left_out FROM events WHERE event_type = 'error' ORDER BY user_id, event_id, value, props LIMIT 20""",
    "edits_by_file": f"""WITH {_NODES} SELECT file, count(*) AS edits, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max("end") AS last FROM n GROUP BY file""",
    "schema_flatten": """SELECT n_nationkey, '$' AS path, 'object' AS type, true AS required, NULL::VARCHAR AS enum, NULL::VARCHAR AS "default", NULL::VARCHAR AS description FROM nation
        UNION ALL SELECT n_nationkey, '$.name', 'string', true, NULL, NULL, n_name FROM nation UNION ALL SELECT n_nationkey, '$.tags', 'array', false, NULL, NULL, NULL FROM nation
        UNION ALL SELECT n_nationkey, '$.tags[]', 'integer', false, NULL, CAST(n_regionkey AS VARCHAR), NULL FROM nation""",
    "evidence_points": f"""WITH {EDGES} SELECT to_id AS start, 'nearby' AS relation, count(*) AS items, least(5.0, count(*) * 0.5)::DOUBLE AS points FROM edges WHERE to_id IN (SELECT 'nation:' || n_nationkey FROM nation) GROUP BY to_id""",
    "byte_budget": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3",
    "deep_chain_order": """WITH e AS (SELECT p_partkey AS f FROM part WHERE p_partkey % 70 <> 0), n AS (SELECT f AS id FROM e UNION SELECT f - 1 FROM e) SELECT CAST(id AS VARCHAR) AS id, CAST(id % 70 AS INTEGER) AS level FROM n""",
}
