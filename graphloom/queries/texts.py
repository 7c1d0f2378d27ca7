"""Words, sections, budgets, JSON paths, markup, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.sets import packed
from graphloom.plans import retrieval, specs
from graphloom.query import jspath, lexer, markup, selector, xpath
from graphloom.session import table

TASK = "repair theEre enLement Invoice src1"


def lexical_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(T.terms(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("documents"))


def seed_scoring(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return retrieval.seed_scores(docs, TASK, F.col("source"), F.col("lang"), F.lit(""), F.col("text")).select("doc_id", "score")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.sum(T.line_count(F.col("text"))).alias("lines"))


def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents with every fifth line made a heading and every seventh a fence, so that both occur."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(i % 7 == 5, "```").when(i % 5 == 3, F.concat(F.lit("# "), l)).otherwise(l))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return retrieval.sections(docs).select("doc_id", F.col("section").cast("int"), F.col("start_line").cast("int"), F.col("end_line").cast("int"))


def pack_budget(spark: SparkSession, d: str) -> DataFrame:
    """The feature's own budget: 12,000 tokens for each language, short of what any document adds beyond it."""
    docs = table(spark, d, "documents").select("doc_id", "lang", T.token_estimate(F.col("text")).alias("tokens"))
    return packed(docs, ["lang"], ["doc_id"], "tokens", 12_000)


def jspath_filter(spark: SparkSession, d: str) -> DataFrame:
    return jspath.query(table(spark, d, "events"), "event_id", "props", ".k{. > 50}").select("event_id", "value")


def jspath_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "props")
    hits = jspath.query(e, "event_id", "props", ".k{. > 90}")
    return jspath.first_by(hits.join(e.drop("props"), "event_id"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])


def jspath_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Items of orders as nested JSON, looked into by a path with a predicate."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q")))).alias("items"))).alias("doc"))
    r = jspath.query(li, "l_orderkey", "doc", ".items{.q > 45 && .n <= 3}.q")
    return r.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("q"))


def jspath_error_tolerant(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("props"))
    return jspath.errors(e, "props").groupBy("event_type").agg(F.count("*").alias("errors"))


def flatten_json_paths(spark: SparkSession, d: str) -> DataFrame:
    f = specs.flattened(table(spark, d, "events").select("event_id", "props"), "event_id", "props")
    return f.groupBy("path", "type").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def deep_diff_flat(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    row = lambda bal: F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("at"), bal.alias("n")))
    before = c.select("c_custkey", row(F.col("c_nationkey")).alias("doc")).where("c_custkey % 11 <> 0")
    after = c.select("c_custkey", row(F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))).alias("doc")).where("c_custkey % 13 <> 0")
    x = specs.deep_diff(specs.flattened(before, "c_custkey", "doc"), specs.flattened(after, "c_custkey", "doc"), "c_custkey")
    return x.groupBy("path", "change").agg(F.count("*").alias("n"))


def redact_policy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    chat = table(spark, d, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    both = docs.unionByName(chat)
    return both.select("id", F.md5(specs.redact_mail(F.col("text"))).alias("redacted_md5"), F.regexp_count("text", F.lit(specs.MAIL)).cast("long").alias("n"))


#: The inline sources of a golden test, whose references are known by reading them.
SOURCES = [
    ("a.ts", "import fs from 'pkg';\nimport type { T } from \"pkg/types\";\n// import no from 'pkg/comment'\n"),
    ("b.ts", "import { type A, type B } from 'pkg/ab';\nimport q = require('pkg/eq');\nconst s = \"require('pkg/string')\";\n"),
    ("c.js", "const r = require('pkg/r');\nobj.require('pkg/member');\nrequire?.('pkg/optional');\nimport('pkg/dynamic');\nexport * from 'pkg/again';\n"),
    ("d.js", "const require = f;\nrequire('pkg/shadowed');\nimport 'pkgother';\nimport '@own/x/y';\n"),
    ("e.ts", "import { A, type B } from '@own/x';\n`text ${require('pkg/in-template')} import z from 'pkg/t'`;\n/import a from 'pkg'/.test(x);\n"),
]
_FOUND = [("a.ts", "pkg", "pkg", "import"), ("a.ts", "pkg", "pkg/types", "import-type"), ("b.ts", "pkg", "pkg/ab", "import-type"), ("b.ts", "pkg", "pkg/eq", "import-equals"), ("c.js", "pkg", "pkg/r", "require"), ("d.js", "@own/x", "@own/x/y", "import"), ("e.ts", "@own/x", "@own/x", "import"), ("e.ts", "pkg", "pkg/in-template", "require")]


def import_refs(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame(SOURCES, "path string, text string")
    return lexer.import_references(files, spark.createDataFrame([("pkg",), ("@own/x",)], "package string"))


def html_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = markup.html_nodes(table(spark, d, "pages"), "page_id", "html")
    return n.where("kind in ('a', 'h1', 'article', 'nav', 'title')").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


def selector_match(spark: SparkSession, d: str) -> DataFrame:
    n = markup.html_nodes(table(spark, d, "pages"), "page_id", "html")
    s = selector.select(n, "page_id", "nav > ul > li:has(a) a[href^='/']")
    return s.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct(F.element_at("attrs", "href")).alias("targets"))


def xpath_match(spark: SparkSession, d: str) -> DataFrame:
    """Nations as small trees; the shape of a region's node with any run of nations around one that is named."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = F.concat(F.lit('<node id="n'), F.col("n_nationkey").cast("string"), F.lit('" kind="Nation" start="1" end="2" value="'), F.col("n_name"), F.lit('"></node>'))
    x = n.groupBy("r_regionkey", "r_name").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("inner"))
    x = x.select("r_regionkey", F.concat(F.lit('<ast><node id="r'), F.col("r_regionkey").cast("string"), F.lit('" kind="Region" start="0" end="9" value="'), F.col("r_name"), F.lit('"><field name="nations" collection="true">'), F.col("inner"), F.lit("</field></node></ast>")).alias("xml"))
    t = xpath.Node("Region", None, {"nations": (True, [xpath.GAP, xpath.Node("Nation"), xpath.Node("Nation"), xpath.GAP])})
    return xpath.matches(x, "r_regionkey", "xml", t, exact=False).select("r_regionkey", "node", "matched")


def xpath_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    x = c.select("c_custkey", F.concat(F.lit('<ast><node id="'), F.col("c_custkey").cast("string"), F.lit('" kind="C"><field name="s" collection="false"><node id="s" kind="S" value="'), F.col("c_mktsegment"), F.lit('"></node></field></node></ast>')).alias("xml"))
    t = xpath.Node("C", None, {"s": (False, [xpath.Node("S", "BUILDING")])})
    return xpath.candidates(x, "c_custkey", "xml", xpath.expression(t)).select("c_custkey", "node")


_PATH = r"^[a-z]+://[^/?#]+([^?#]*)"


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", _PATH, 1).alias("path"))
    return p.where(T.matches_glob(F.col("path"), "/*/*.html", "/**/9*")).select("page_id", "path")


_f = [lexical_terms, seed_scoring, token_estimate, doc_sections, pack_budget, jspath_filter, jspath_first, jspath_arrays, jspath_error_tolerant, flatten_json_paths, deep_diff_flat, redact_policy, import_refs, html_nodes, selector_match, xpath_match, xpath_candidates, glob_filter]
QUERIES = {f.__name__: f for f in _f}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = lambda x: f"regexp_extract_all(lower(regexp_replace({x}, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_HAS = lambda list_, t: f"CASE WHEN len(list_filter({list_}, lambda x: x = '{t}' OR (length(x) >= 5 AND length('{t}') >= 5 AND x[1:5] = '{t[:5]}'))) > 0 THEN 1 ELSE 0 END"
_TERMS = retrieval.task_terms(TASK)

ORACLE_SQL = {
    "lexical_terms": f"""WITH t AS (SELECT unnest(list_distinct({_TOKENS("text")})) AS term FROM documents)
        SELECT term, count(*) AS documents FROM t WHERE length(term) > 1 AND term NOT IN ({_STOP}) GROUP BY term""",
    "seed_scoring": f"""WITH d AS (SELECT doc_id, {_TOKENS("source")} AS s, {_TOKENS("lang")} AS l, list_distinct({_TOKENS("text")}) AS b FROM documents)
        SELECT doc_id, CAST({" + ".join(f"20 * {_HAS('s', t)} + 8 * {_HAS('l', t)}" for t in _TERMS)} + least(10, {" + ".join(_HAS("b", t) for t in _TERMS)}) AS BIGINT) AS score FROM d""",
    "token_estimate": """SELECT source, CAST(sum(CAST(ceil(strlen(text) / 4) AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END) AS BIGINT) AS lines FROM documents GROUP BY source""",
    "doc_sections": r"""WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
        e AS (SELECT doc_id, i AS n, len(l) AS total, CASE WHEN i % 7 = 5 THEN '```' WHEN i % 5 = 3 THEN '# ' || l[i + 1] ELSE l[i + 1] END AS line FROM (SELECT *, unnest(range(len(l))) AS i FROM s)),
        f AS (SELECT *, (ltrim(line) LIKE '```%')::INT AS tick FROM e),
        g AS (SELECT *, sum(tick) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS inside FROM f),
        h AS (SELECT *, (tick = 0 AND NOT inside AND regexp_matches(line, '^#{1,6}\s+.+$'))::INT AS head FROM g),
        k AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
        SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(min(n) + 1 AS INTEGER) AS start_line, CAST(max(n) + 1 AS INTEGER) AS end_line FROM k GROUP BY doc_id, section HAVING bool_or(regexp_matches(line, '\S'))""",
    "pack_budget": """WITH RECURSIVE o AS (SELECT doc_id, lang, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
        r AS (SELECT doc_id, lang, tokens, n, tokens <= 12000 AS taken, 12000 - CASE WHEN tokens <= 12000 THEN tokens ELSE 0 END AS rest FROM o WHERE n = 1
          UNION ALL SELECT o.doc_id, o.lang, o.tokens, o.n, o.tokens <= r.rest, r.rest - CASE WHEN o.tokens <= r.rest THEN o.tokens ELSE 0 END FROM r JOIN o ON o.lang = r.lang AND o.n = r.n + 1)
        SELECT doc_id, lang, tokens FROM r WHERE taken""",
    "jspath_filter": "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50",
    "jspath_first": """SELECT user_id, event_id, value FROM (SELECT user_id, event_id, json_extract_string(props, '$.k') AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
        FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 90) WHERE n = 1""",
    "jspath_arrays": "SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE CAST(l_quantity AS INTEGER) > 45 AND l_linenumber <= 3 GROUP BY l_orderkey",
    "jspath_error_tolerant": """WITH e AS (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN props || '}' ELSE props END AS p FROM events)
        SELECT event_type, count(*) AS errors FROM e WHERE NOT json_valid(p) GROUP BY event_type""",
    "flatten_json_paths": "SELECT 'k' AS path, 'number' AS type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS values FROM events WHERE json_valid(props)",
    "deep_diff_flat": """WITH c AS (SELECT c_custkey AS k, c_custkey % 11 <> 0 AS b, c_custkey % 13 <> 0 AS a, c_custkey % 7 = 0 AS m FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 13 <> 0),
        p AS (SELECT *, unnest(['name', 'at.nation', 'at.segment', 'n']) AS path FROM c)
        SELECT path, CASE WHEN NOT b THEN 'added' WHEN NOT a THEN 'removed' WHEN path = 'n' AND m THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM p GROUP BY ALL""",
    "redact_policy": f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations)
        SELECT id, md5(regexp_replace(text, '{specs.MAIL}', '[redacted]', 'g')) AS redacted_md5, CAST(len(regexp_extract_all(text, '{specs.MAIL}')) AS BIGINT) AS n FROM t""",
    "import_refs": f"SELECT * FROM (VALUES {', '.join(map(str, _FOUND))}) v(path, package, specifier, kind)",
    "html_nodes": """WITH p AS (SELECT page_id, html, unnest(['a', 'h1', 'article', 'nav', 'title']) AS kind FROM pages)
        SELECT page_id, kind, CAST(len(regexp_extract_all(html, '<' || kind || '[ >]')) AS BIGINT) AS n FROM p WHERE n > 0""",
    "selector_match": r"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a href="(/[^"]*)"', 1) AS l FROM pages)
        SELECT page_id, CAST(len(l) AS BIGINT) AS links, CAST(len(list_distinct(l)) AS BIGINT) AS targets FROM n WHERE len(l) > 0""",
    "xpath_match": "SELECT n_regionkey AS r_regionkey, 'r' || n_regionkey AS node, TRUE AS matched FROM nation GROUP BY n_regionkey HAVING count(*) >= 2",
    "xpath_candidates": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS node FROM customer WHERE c_mktsegment = 'BUILDING'",
    "glob_filter": f"""WITH p AS (SELECT page_id, regexp_extract(url, '{_PATH}', 1) AS path FROM pages)
        SELECT page_id, path FROM p WHERE regexp_matches(path, '^/[^/]*/[^/]*\\.html$') OR regexp_matches(path, '^/(?:.*/)?9[^/]*$')""",
}
