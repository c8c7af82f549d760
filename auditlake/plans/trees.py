"""Queries over written report trees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.registry import query
from auditlake.session import shared_folder
from auditlake.sources import trees as T
from auditlake.sources.derived import artifacts, with_sql

INDEXED = """kept AS (SELECT * FROM artifacts WHERE NOT sidecar),
told AS (SELECT *, CASE WHEN json_valid(content) THEN content END AS doc FROM kept WHERE format = 'json'),
shown AS (SELECT stem, string_agg(format, ',' ORDER BY format) AS alternatives FROM kept GROUP BY stem),
indexed AS (
  SELECT k.path, k.folder, k.run_key, strftime(strptime(k.stamp, '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS date, k.model, k.format, k.stem,
         CASE k.g % 5 WHEN 0 THEN 'Sql Injection' WHEN 1 THEN 'Path Traversal' WHEN 2 THEN 'Weak Hashing' WHEN 3 THEN 'Executive Summary' ELSE 'Audit Report' END AS vulnerability_type,
         coalesce(json_extract_string(t.doc, '$.project'), k.folder) AS project, nullif(json_extract_string(t.doc, '$.language'), '') AS language,
         CASE WHEN k.format = 'json' AND t.doc IS NOT NULL THEN CAST(json_extract_string(t.doc, '$.stats.critical') AS BIGINT) END AS critical, CASE WHEN k.format = 'json' AND t.doc IS NOT NULL THEN CAST(json_extract_string(t.doc, '$.stats.high') AS BIGINT) END AS high,
         CASE WHEN k.format = 'json' AND t.doc IS NOT NULL THEN CAST(0 AS BIGINT) END AS medium, CASE WHEN k.format = 'json' AND t.doc IS NOT NULL THEN CAST(json_extract_string(t.doc, '$.stats.low') AS BIGINT) END AS low,
         CASE WHEN k.format = 'json' AND k.g % 5 = 3 THEN CAST(json_extract_string(t.doc, '$.progress.completed') AS BIGINT) END AS completed, CASE WHEN k.format = 'json' AND k.g % 5 = 3 THEN CAST(json_extract_string(t.doc, '$.progress.total') AS BIGINT) END AS total,
         s.alternatives, CAST(octet_length(encode(k.content)) AS BIGINT) AS size
  FROM kept k LEFT JOIN told t USING (stem) JOIN shown s USING (stem))"""


def _tree(spark: SparkSession, d: str) -> str:
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    T.write_tree(artifacts(spark, d), root)
    return root


@query(with_sql("artifacts", f"WITH {INDEXED} SELECT * FROM indexed"))
def s17_report_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """The index of a written tree: one row an artifact, with stats, progress, language, project and other formats."""
    return T.report_artifacts(spark, _tree(spark, d))


@query(with_sql("artifacts", f"WITH {INDEXED} SELECT * FROM indexed WHERE folder IN ('team1', 'shop3') AND model = 'model-2' AND format IN ('json', 'md')"))
def s16_pruned_tree(spark: SparkSession, d: str) -> DataFrame:
    """Only the run directories of two folders are read, and in them one model and two formats."""
    return T.report_artifacts(spark, _tree(spark, d), folder=["team1", "shop3"], model=["model-2"], format=["json", "md"])


@query(with_sql("artifacts", "SELECT run_key, model, path, row_number() OVER (PARTITION BY run_key, model ORDER BY path) AS position FROM artifacts WHERE format = 'json' AND NOT sidecar"))
def s19_json_reports(spark: SparkSession, d: str) -> DataFrame:
    return T.json_reports(T.report_artifacts(spark, _tree(spark, d)))


@query(with_sql("artifacts", "SELECT path FROM artifacts WHERE folder IS NULL UNION ALL SELECT path FROM artifacts WHERE g % 7 = 0 AND format = 'md'"))
def s1_input_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The files behind a list of paths: run directories, single files, blank lines and paths that do not exist."""
    root = _tree(spark, d)
    path = F.concat(F.lit(f"{root}/"), "path")
    rows = artifacts(spark, d)
    runs = rows.select(F.concat(F.lit(f"  {root}/"), F.regexp_extract("path", rf"^({T.STAMP})/", 1)).alias("value")).filter(~F.endswith("value", F.lit("/"))).distinct()
    stem = F.regexp_extract("path", r"_(\d+)\.md$", 1)
    single = rows.filter(stem != "").filter(stem.cast("long") % 7 == 0).select(path.alias("value"))
    absent = single.select(F.concat("value", F.lit(".gone"))).union(single.select(F.lit("")))
    listed = f"{root}-list.txt"
    runs.union(single).union(absent).write.text(listed)
    return T.input_files(spark, listed).select(F.substring_index("path", f"{root.rpartition('/')[2]}/", -1).alias("path"))
