"""Queries over report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import reports as R
from auditlake.operators.vectors import top_per_group
from auditlake.registry import query
from auditlake.sources.derived import findings, report_files, with_sql

BY_SEVERITY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in ("Critical", "High", "Medium", "Low"))


@query(with_sql("findings", f"SELECT report_id, count(DISTINCT CASE WHEN error IS NULL THEN file_path END) AS n_files, count(DISTINCT file_path || ':' || chunk) AS n_chunks, count(*) AS n_findings, {BY_SEVERITY} FROM findings GROUP BY report_id"))
def a7_report_statistics(spark: SparkSession, d: str) -> DataFrame:
    return R.report_statistics(report_files(spark, d))


@query(with_sql("findings", "SELECT report_id, file_path, count(DISTINCT chunk) FILTER (severity IN ('Critical', 'High')) AS n_chunks, count(*) FILTER (severity IN ('Critical', 'High')) AS n_findings, max(error) AS error FROM findings GROUP BY report_id, file_path HAVING count(*) FILTER (severity IN ('Critical', 'High')) > 0 OR max(error) IS NOT NULL"))
def f6_severity_pruning(spark: SparkSession, d: str) -> DataFrame:
    p = R.pruned(report_files(spark, d), ["critical", "high"])
    return p.select("report_id", "file_path", F.size("chunk_analyses").cast("long").alias("n_chunks"), F.size(R.all_findings(F.col("chunk_analyses"))).cast("long").alias("n_findings"), "error")


RANK_SQL = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 WHEN 'Info' THEN 0 ELSE -1 END"


@query(with_sql("findings", f"SELECT report_id, file_path, max_by(severity, {RANK_SQL}) AS max_severity, max({RANK_SQL}) AS severity_rank, count(*) AS n_findings FROM findings GROUP BY report_id, file_path"))
def a12_max_severity(spark: SparkSession, d: str) -> DataFrame:
    return R.worst(report_files(spark, d))


@query(with_sql("findings", f"WITH w AS (SELECT report_id, file_path, max({RANK_SQL}) AS severity_rank, count(*) AS n_findings FROM findings GROUP BY report_id, file_path), k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY severity_rank DESC, n_findings DESC, file_path) AS rank, count(*) OVER (PARTITION BY report_id) AS n FROM w) SELECT report_id, file_path, severity_rank, n_findings, CAST(rank AS INT) AS rank, greatest(n - 25, 0) AS omitted FROM k WHERE rank <= 25"))
def l4_worst_files(spark: SparkSession, d: str) -> DataFrame:
    w = R.worst(report_files(spark, d))
    n = w.groupBy("report_id").agg(F.greatest(F.count("*") - 25, F.lit(0)).alias("omitted"))
    top = top_per_group(w, ["report_id"], [F.desc("severity_rank"), F.desc("n_findings"), F.asc("file_path")], 25)
    return top.join(n, "report_id").select("report_id", "file_path", "severity_rank", "n_findings", "rank", "omitted")


@query(with_sql("findings", "SELECT severity, CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Low' THEN 'note' ELSE 'warning' END AS level, count(*) AS n FROM findings GROUP BY 1, 2"))
def f12_sarif_level(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("severity", R.level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


@query(with_sql("findings", "SELECT report_id, file_path, CAST(to_json(list({'ruleId': 'report-' || report_id, 'level': CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Low' THEN 'note' ELSE 'warning' END, 'message': {'text': title}, 'location': {'uri': file_path, 'startLine': line}} ORDER BY severity, title, line)) AS VARCHAR) AS results FROM findings GROUP BY report_id, file_path"))
def x11_sarif_document(spark: SparkSession, d: str) -> DataFrame:
    return R.sarif(report_files(spark, d), F.concat(F.lit("report-"), F.col("report_id").cast("string")))


@query(with_sql("findings", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY report_id, file_path, chunk ORDER BY severity, title, line) AS rf, dense_rank() OVER (PARTITION BY report_id, file_path ORDER BY chunk) AS rc FROM findings) SELECT report_id, file_path, string_agg(substr(title, 1, 12), '|' ORDER BY rc, rf) AS digest FROM r WHERE rf <= 2 AND rc <= 2 GROUP BY report_id, file_path"))
def a18_findings_digest(spark: SparkSession, d: str) -> DataFrame:
    return R.digest(report_files(spark, d), 2, 2, 12)


@query(with_sql("findings", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY report_id, file_path, chunk ORDER BY severity, title, line) AS rf, dense_rank() OVER (PARTITION BY report_id, file_path ORDER BY chunk) AS rc FROM findings) SELECT report_id, file_path, max(title) FILTER (rc = 2 AND rf = 1) AS title, max(severity) FILTER (rc = 2 AND rf = 1) AS severity FROM r GROUP BY report_id, file_path"))
def f14_index_slice(spark: SparkSession, d: str) -> DataFrame:
    """The first finding of each file's second chunk; null out of range."""
    one = F.get(F.get(F.col("chunk_analyses"), F.lit(1)).getField("findings"), F.lit(0))
    return report_files(spark, d).select("report_id", "file_path", one.title.alias("title"), one.severity.alias("severity"))


@query(with_sql("findings", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY report_id, file_path, chunk ORDER BY severity, title, line) AS rf FROM findings) SELECT report_id, file_path, chunk, CASE WHEN line % 5 = 0 THEN chunk + 1 ELSE line END AS sink_line FROM r WHERE rf = 1"))
def f15_sink_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A finding's own line if it is positive, else its chunk's start; lines divisible by 5 stand for missing ones."""
    c = report_files(spark, d).select("report_id", "file_path", F.explode("chunk_analyses").alias("c"))
    own = F.get(F.col("c.findings"), F.lit(0)).getField("line")
    return c.select("report_id", "file_path", "c.chunk", F.coalesce(F.when((own > 0) & (own % 5 != 0), own), F.col("c.chunk") + 1).alias("sink_line"))


@query(with_sql("findings", "SELECT report_id, file_path, title, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), CASE WHEN severity <> 'Info' THEN severity END, error) AS message FROM findings"))
def x10_finding_message(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.select("report_id", "file_path", "title", F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.when(F.col("severity") != "Info", F.col("severity")), "error").alias("message"))


@query(with_sql("findings", "SELECT report_id % 5 AS model_dir, count(DISTINCT report_id) AS n_reports, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, bool_or(report_id = 0) AS has_executive FROM findings GROUP BY 1"))
def a10_severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = R.report_statistics(report_files(spark, d))
    return s.groupBy((F.col("report_id") % 5).alias("model_dir")).agg(F.count("*").alias("n_reports"), F.sum("critical").alias("critical"), F.sum("high").alias("high"), F.bool_or(F.col("report_id") == 0).alias("has_executive"))


@query(with_sql("findings", "SELECT file_path, min(report_id) AS first_report FROM findings GROUP BY file_path"))
def o2_union_of_paths(spark: SparkSession, d: str) -> DataFrame:
    return report_files(spark, d).groupBy("file_path").agg(F.min("report_id").alias("first_report"))


@query(with_sql("findings", "SELECT report_id, count(*) FILTER (error IS NOT NULL) AS n_flagged, count(*) FILTER (error IS NOT NULL) > 0 AS retry FROM (SELECT DISTINCT report_id, file_path, chunk, error FROM findings) GROUP BY report_id"))
def a13_validation_errors(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum(F.when(F.col("error").isNotNull(), F.size("chunk_analyses")).otherwise(0)).cast("long")
    return report_files(spark, d).groupBy("report_id").agg(n.alias("n_flagged"), (n > 0).alias("retry"))
