"""Queries of the corpus operators over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, fingerprints, line_dedup, mixing, near_dup, packing, pii, quality, secret_scan, token_counts
from graphloom.llm.common import own_id, read


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_dup.groups(read(spark, sf_dir, "documents"), shingle=2, percent=80)
    own = lambda c: F.when(F.col(c) != near_dup.NO_ID, F.col(c))
    return g.select(own("id").alias("doc_id"), F.col("n").alias("n_shingles"), own("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_counts.section_tokens(read(spark, sf_dir, "documents"))
    return t.withColumn("doc_id", own_id(F.col("doc_id")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_dedup.dedup(docs.select("doc_id", "text"), counts=True)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    c = c.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    d = chat.read_back(chat.segments(c))
    return d.withColumn("conv_id", own_id(F.col("conv_id")))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(read(spark, sf_dir, "documents")).drop("gone")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op7_source_mix": op7_source_mix,
    "op8_personal_data": op8_personal_data,
    "op9_sequence_packing": op9_sequence_packing,
    "op10_quality_rules": op10_quality_rules,
    "pipeline": pipeline,
}

#: Turns with their escaped lengths, the marks of the template, and the order of roles as letters.
_CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, CAST(length(regexp_replace(replace(text, '\', '\\'), '<s>|\[ROLE\]|\[/ROLE\]|\[/TURN\]|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ANS\]|</s>', 'x\0', 'g')) AS BIGINT)
    + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 7 + length(role) + 9 + 7 END AS chars,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
    regexp_full_match(string_agg(letter, '' ORDER BY turn, role, text), 's?u(au)*a?') AS valid FROM e GROUP BY conv_id"""

#: Sets of two-word shingles, links by their intersections, reachability.
_NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
  n AS MATERIALIZED (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
  e AS MATERIALIZED (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id)
  SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n"""

#: Windows of two lines, the first place of each, and lines without those of later windows.
_LINES = r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, k, ls[k] || chr(10) || ls[k + 1] AS b FROM (SELECT doc_id, ls, unnest(range(1, len(ls))) AS k FROM l)),
  f AS (SELECT b, doc_id AS d, k AS first FROM w QUALIFY row_number() OVER (PARTITION BY b ORDER BY doc_id, k) = 1),
  g AS (SELECT DISTINCT doc_id, unnest([k, k + 1]) AS i FROM w JOIN f USING (b) WHERE doc_id <> d OR k >= first + 2),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
  t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
  SELECT documents.doc_id, CASE WHEN n.n IS NULL THEN text ELSE coalesce(t.t, '') END AS text, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op1_near_dup": _NEAR, "op3_line_dedup": _LINES, "op4_chat_format": _CHAT}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
