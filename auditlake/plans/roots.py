"""Queries over roots, settings and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import bodies as D
from auditlake.operators import reports as R
from auditlake.operators import roots as O
from auditlake.registry import query
from auditlake.session import shared_folder
from auditlake.sources.derived import code_files, findings, read, with_sql

PLACES = """listing AS (SELECT lower(n_name) AS entry FROM nation UNION SELECT lower(r_name) || '/' || lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0),
stale AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/home/u' || c_custkey || '/' || lower(r_name) || '/' || lower(n_name) WHEN 1 THEN '/srv/' || lower(n_name) || '/' ELSE '/gone/x' END AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {PLACES} SELECT c_custkey, (SELECT arg_max(entry, length(entry)) FROM listing WHERE ends_with(rtrim(path, '/'), '/' || entry)) AS entry FROM stale")
def j15_stale_roots(spark: SparkSession, d: str) -> DataFrame:
    """The longest suffix of a moved tree's path that still exists."""
    places = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    long = F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"))
    listing = places.select(F.lower("n_name").alias("entry")).union(places.filter("n_nationkey % 2 = 0").select(long))
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("/home/u"), k.cast("string"), F.lit("/"), long)).when(k % 3 == 1, F.concat(F.lit("/srv/"), F.lower("n_name"), F.lit("/"))).otherwise("/gone/x")
    stale = read(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", raw.alias("path"))
    return O.relocated(stale, listing, "c_custkey")


@query("SELECT page_id, CASE WHEN url = 'https://' || host THEN '.' WHEN starts_with(url, 'https://' || host || '/') THEN substr(url, length(host) + 10) ELSE url END AS root FROM (SELECT page_id, url, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages)")
def x35_stored_root(spark: SparkSession, d: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return read(spark, d, "pages").select("page_id", O.stored_root(F.col("url"), F.concat(F.lit("https://"), host)).alias("root"))


@query("SELECT doc_id, least(greatest(coalesce(try_cast(CASE WHEN regexp_full_match(w, '[+-]?[0-9]{1,18}') THEN w END AS BIGINT), 7), 2), 120) AS whole, least(greatest(coalesce(try_cast(CASE WHEN regexp_full_match(w, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN w END AS DOUBLE), 0.5), 0.05), 240.0) AS part FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN CAST(n_chars AS VARCHAR) || '.25' WHEN 2 THEN lang ELSE '-' || n_chars END AS w FROM documents)")
def x37_settings(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as settings give them: whole, broken, none, negative."""
    k, n = F.col("doc_id"), F.col("n_chars").cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), n)).when(k % 4 == 1, F.concat(n, F.lit(".25"))).when(k % 4 == 2, F.col("lang")).otherwise(F.concat(F.lit("-"), n))
    return read(spark, d, "documents").select("doc_id", O.int_setting(raw, 7, 2, 120).alias("whole"), O.float_setting(raw, 0.5, 0.05, 240.0).alias("part"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS BIGINT) * 1000000000 WHEN 1 THEN CAST(p_size AS BIGINT) * 1000000 + 500000 END AS parameters FROM part")
def x38_parameter_count(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("model-"), n, F.lit("B-chat"))).when(k % 3 == 1, F.concat(F.lit("tiny:"), n, F.lit(".5m"))).otherwise("plain")
    return read(spark, d, "part").select("p_partkey", O.parameter_count(name).cast("long").alias("parameters"))


@query(with_sql("code_files", "SELECT file_id, md5(content) AS digest FROM code_files WHERE file_id % 3 <> 1"))
def s10_saved_index(spark: SparkSession, d: str) -> DataFrame:
    """An index saved, loaded and cut down to two of its three suffixes."""
    suffix = F.element_at(F.array(F.lit("py"), F.lit("php"), F.lit("go")), (F.col("file_id") % 3 + 1).cast("int"))
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    O.save_index(code_files(spark, d).select("file_id", F.md5("content").alias("digest"), suffix.alias("suffix")), path)
    return O.load_index(spark, path, ["file_id", "digest"], ["py", "go"])


SINKS = """WITH n AS (SELECT report_id, severity, CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Low' THEN 'note' ELSE 'warning' END AS level, count(*) AS n FROM findings GROUP BY 1, 2, 3)
SELECT 'md' AS format, report_id, '| ' || severity || ' | ' || n || ' |' AS line FROM n
UNION ALL SELECT 'html', report_id, '<tr><td>' || severity || '</td><td>' || n || '</td></tr>' FROM n
UNION ALL SELECT 'json', report_id, '{"severity":"' || severity || '","n":' || n || '}' FROM n
UNION ALL SELECT 'sarif', report_id, '{"ruleId":"' || severity || '","level":"' || level || '","message":{"text":"' || n || '"}}' FROM n"""


@query(with_sql("findings", SINKS))
def s20_report_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON, SARIF, Markdown and HTML files, and read back."""
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    rows = findings(spark, d)
    O.write_reports(O.rendered_reports(rows.select("report_id", "severity", R.level(F.col("severity")).alias("level"))), path)
    return O.read_reports(spark, path)


def _body_sql(fmt: str, kinds: dict[str, list[str]]) -> str:
    """Lines of one format: of each node its texts, by path in the tree."""
    parts = [f"SELECT report_id, file_ord, step, ch, {k} AS kd, rank, severity, title, ln, coalesce(last, false) AS last, {i} AS k, {text} AS line FROM node WHERE kind = '{name}'" for k, (name, texts) in enumerate(kinds.items()) for i, text in enumerate(texts)]
    return f"SELECT '{fmt}' AS format, report_id, row_number() OVER (PARTITION BY report_id ORDER BY file_ord, step, ch, kd, rank, severity, title, ln, last, k) AS line_no, line FROM (" + " UNION ALL ".join(parts) + ")"


def _html(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


SCORE = "(floor(score * 1000) / 1000)"
BODIES = {
    "md": {"report": ["'# Report ' || report_id", "''", "'| Severity | Findings |'", "'| --- | --- |'"], "severity": ["'| ' || severity || ' | ' || n || ' |'"], "end_summary": ["''"], "file": [f"'## ' || path || ' (' || {SCORE} || ')'", "''"],
           "chunk": ["'### Chunk ' || ch"], "finding": ["'- **[' || severity || ']** ' || title || ' (line ' || ln || ')'"], "end_file": ["''"], "end_report": ["'_' || n || ' findings_'"]},
    "html": {"report": ["'<h1>Report ' || report_id || '</h1>'", "'<table>'"], "severity": ["'<tr><td>' || severity || '</td><td>' || n || '</td></tr>'"], "end_summary": ["'</table>'"], "file": [f"'<section><h2>' || {_html('path')} || ' (' || {SCORE} || ')</h2>'", "'<ul>'"],
             "chunk": ["'<li class=\"chunk\">Chunk ' || ch || '</li>'"], "finding": [f"'<li><b>' || severity || '</b> ' || {_html('title')} || ' (line ' || ln || ')</li>'"], "end_file": ["'</ul></section>'"], "end_report": ["'<p>' || n || ' findings</p>'"]},
    "json": {"report": ["'{\"report\":' || report_id || ',\"summary\":{'"], "severity": ["'\"' || severity || '\":' || n || CASE WHEN last THEN '' ELSE ',' END"], "end_summary": ["'},\"files\":['"], "file": ["'{\"path\":' || to_json(path) || ',\"score\":' || (floor(score * 1000) / 1000) || ',\"findings\":['"],
             "finding": ["'{\"chunk\":' || ch || ',\"severity\":\"' || severity || '\",\"title\":' || to_json(title) || ',\"line\":' || ln || '}' || CASE WHEN last THEN '' ELSE ',' END"], "end_file": ["']}' || CASE WHEN last THEN '' ELSE ',' END"], "end_report": ["'],\"total\":' || n || '}'"]},
    "sarif": {"report": ["'{\"version\":\"2.1.0\",\"runs\":[{\"tool\":{\"driver\":{\"name\":\"auditlake\"}},\"properties\":{\"report\":' || report_id || '},\"results\":['"],
              "finding": ["'{\"ruleId\":\"' || severity || '\",\"level\":\"' || CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Low' THEN 'note' ELSE 'warning' END || '\",\"message\":{\"text\":' || to_json(title) || '},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":' || to_json(path) || '},\"region\":{\"startLine\":' || ln || '}}}]}' || CASE WHEN last AND last_file THEN '' ELSE ',' END"],
              "end_report": ["']}]}'"]},
}


@query(with_sql("findings", """WITH f AS (SELECT report_id, file_path AS path, chunk, severity, title, line, CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 WHEN 'Info' THEN 4 ELSE 5 END AS rank, score FROM findings),
fo AS (SELECT report_id, path, max(score) AS score, row_number() OVER (PARTITION BY report_id ORDER BY max(score) DESC, path) AS file_ord, count(*) OVER (PARTITION BY report_id) AS n_files FROM f GROUP BY 1, 2),
g AS (SELECT f.report_id, f.path, f.chunk, f.severity, f.title, f.line, f.rank, fo.file_ord, fo.file_ord = n_files AS last_file, row_number() OVER (PARTITION BY f.report_id, file_ord ORDER BY f.chunk DESC, f.rank DESC, f.title DESC, f.line DESC) = 1 AS last FROM f JOIN fo USING (report_id, path)),
node AS (SELECT 'finding' AS kind, report_id, file_ord, 1 AS step, chunk AS ch, rank, severity, title, line AS ln, NULL AS n, path, NULL AS score, last, last_file FROM g
  UNION ALL SELECT 'chunk', report_id, file_ord, 1, chunk, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT report_id, file_ord, chunk FROM g)
  UNION ALL SELECT k, report_id, file_ord, s, NULL, NULL, NULL, NULL, NULL, NULL, path, score, file_ord = n_files, NULL FROM fo, (VALUES ('file', 0), ('end_file', 2)) v(k, s)
  UNION ALL SELECT 'severity', report_id, -1, 0, NULL, rank, severity, NULL, NULL, count(*), NULL, NULL, rank = max(rank) OVER (PARTITION BY report_id), NULL FROM f GROUP BY report_id, rank, severity
  UNION ALL SELECT k, report_id, o, s, NULL, NULL, NULL, NULL, NULL, n, NULL, NULL, NULL, NULL FROM (SELECT report_id, count(*) AS n FROM f GROUP BY 1), (VALUES ('report', -1, 0), ('end_summary', -1, 0), ('end_report', 1099511627776, 2)) v(k, o, s))
""" + " UNION ALL ".join(_body_sql(fmt, kinds) for fmt, kinds in BODIES.items())))
def s20_report_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Whole reports in four formats, written as files and read back line by line."""
    path = f"{shared_folder(spark)}/bodies-{uuid.uuid4().hex}"
    D.write_reports(findings(spark, d), path)
    return D.read_bodies(spark, path)
