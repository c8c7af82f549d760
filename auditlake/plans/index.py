"""Queries over the report index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import index as I
from auditlake.registry import query
from auditlake.sources.derived import code_files, read, report_index, with_sql

EXEC = "vulnerability_type = 'Executive Summary'"


@query(with_sql("report_index", f"SELECT report_key, model, vulnerability_type, project FROM report_index WHERE (contains(lower(model), 'build') OR contains(lower(model), 'auto')) AND ({EXEC} OR contains(lower(vulnerability_type), 'urgent') OR contains(lower(vulnerability_type), 'high')) AND format IN ('json', 'md') AND coalesce(language, 'en') IN ('en', 'eu', 'as') AND ({EXEC} OR (format = 'json' AND (critical > 0 OR high > 0))) AND date >= TIMESTAMP '1994-01-01' AND date <= TIMESTAMP '1997-12-31'"))
def f3_dashboard_filter(spark: SparkSession, d: str) -> DataFrame:
    out = I.filtered(report_index(spark, d), models=["Build", "AUTO"], types=["urgent", "high"], formats=["json", "md"], languages=["en", "eu", "as"], severities=["critical", "high"], start="1994-01-01", end="1997-12-31")
    return out.select("report_key", "model", "vulnerability_type", "project")


@query(with_sql("report_index", "SELECT report_key, date FROM report_index WHERE date >= TIMESTAMP '1995-06-01' AND date <= TIMESTAMP '1995-09-30'"))
def f4_date_range(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(report_index(spark, d), start="1995-06-01", end="1995-09-30").select("report_key", "date")


@query(with_sql("report_index", f"SELECT report_key, medium FROM report_index WHERE {EXEC} OR (format = 'json' AND medium > 0)"))
def f5_severity_filter(spark: SparkSession, d: str) -> DataFrame:
    return I.filtered(report_index(spark, d), severities=["medium"]).select("report_key", "medium")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'critical,low' WHEN 1 THEN 'high' ELSE '' END AS tokens FROM documents")
def f5_severity_tokens(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, " Critical, nonsense,low,critical").when(F.col("doc_id") % 3 == 1, "HIGH").otherwise(",none")
    return read(spark, d, "documents").select("doc_id", F.array_join(I.severity_tokens(raw), ",").alias("tokens"))


@query(with_sql("report_index", f"SELECT r.report_key FROM report_index r WHERE EXISTS (SELECT 1 FROM report_index f WHERE f.stem = r.stem AND f.format = 'json' AND f.critical > 1)"))
def f7_scope_guard(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of reports that the filter lets pass, alternatives included."""
    index = report_index(spark, d)
    allowed = index.filter("format = 'json' AND critical > 1").select("stem")
    return index.join(allowed, "stem", "left_semi").select("report_key")


@query(with_sql("report_index", "SELECT report_key, format = 'json' OR (format = 'md' AND NOT EXISTS (SELECT 1 FROM report_index s WHERE s.stem = r.stem AND s.format = 'json')) AS visible FROM report_index r"))
def f10_date_visible(spark: SparkSession, d: str) -> DataFrame:
    a = I.alternatives(report_index(spark, d), ["stem"])
    return a.select("report_key", ((F.col("format") == "json") | ((F.col("format") == "md") & ~F.col("has_json"))).alias("visible"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'BRASS' WHEN contains(lower(p_type), 'steel') THEN 'STEEL' WHEN contains(lower(p_type), 'copper') THEN 'COPPER' ELSE lower(p_type) END AS kind FROM part")
def f11_type_inference(spark: SparkSession, d: str) -> DataFrame:
    """The first catalog name that the stem holds, else the stem."""
    stem = F.lower("p_type")
    kind = F.coalesce(*(F.when(F.contains(stem, F.lit(k.lower())), F.lit(k)) for k in ("BRASS", "STEEL", "COPPER")), stem)
    return read(spark, d, "part").select("p_partkey", kind.alias("kind"))


SUMS = "CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low"
STATS_SQL = " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {value} AS value, count(*) AS n, {SUMS} FROM {{src}} {'' if dim == 'format' else chr(10) + 'WHERE format = ' + chr(39) + 'json' + chr(39)} GROUP BY 2"
    for dim, value in (("model", "model"), ("type", "vulnerability_type"), ("date", "strftime(date, '%Y-%m-%d')"), ("format", "format"), ("all", "'all'"))
)


@query(with_sql("report_index", STATS_SQL.format(src="report_index")))
def a8_global_statistics(spark: SparkSession, d: str) -> DataFrame:
    return I.statistics(report_index(spark, d))


@query(with_sql("report_index", f"WITH f AS (SELECT * FROM report_index WHERE contains(lower(model), 'house') AND lower(trim(project)) = 'france') {STATS_SQL.format(src='f')}"))
def a9_filtered_statistics(spark: SparkSession, d: str) -> DataFrame:
    return I.statistics(I.filtered(report_index(spark, d), models=["house"], project=" FRANCE "))


@query(with_sql("report_index", "SELECT coalesce(language, 'en') AS language, lower(trim(project)) AS project, grouping(coalesce(language, 'en')) AS g, count(*) AS n FROM report_index GROUP BY GROUPING SETS ((coalesce(language, 'en')), (lower(trim(project))))"))
def a9_language_project_counts(spark: SparkSession, d: str) -> DataFrame:
    i = report_index(spark, d).select(F.coalesce("language", F.lit("en")).alias("language"), I.project_key(F.col("project")).alias("project"))
    return i.groupingSets([["language"], ["project"]], "language", "project").agg(F.grouping("language").cast("long").alias("g"), F.count("*").alias("n")).select("language", "project", "g", "n")


@query(with_sql("report_index", "SELECT r.report_key, s.formats FROM report_index r JOIN (SELECT stem, string_agg(DISTINCT format, ',' ORDER BY format) AS formats FROM report_index GROUP BY stem) s USING (stem)"))
def j10_sibling_formats(spark: SparkSession, d: str) -> DataFrame:
    return I.alternatives(report_index(spark, d), ["stem"]).select("report_key", F.array_join("formats", ",").alias("formats"))


@query(with_sql("report_index", "SELECT stem, min_by(format, CASE format WHEN 'json' THEN 1 WHEN 'html' THEN 2 WHEN 'md' THEN 3 WHEN 'pdf' THEN 4 ELSE 5 END) AS format FROM report_index GROUP BY stem"))
def j14_preferred_artifact(spark: SparkSession, d: str) -> DataFrame:
    a = I.alternatives(report_index(spark, d), ["stem"])
    return a.filter("report_key = preferred_key").select("stem", "format")


@query(with_sql("report_index", "SELECT report_key, date, format FROM report_index ORDER BY date DESC, CASE format WHEN 'json' THEN 1 WHEN 'html' THEN 2 WHEN 'md' THEN 3 WHEN 'pdf' THEN 4 ELSE 5 END, report_key"))
def l5_whole_report_order(spark: SparkSession, d: str) -> DataFrame:
    """All reports."""
    place = F.array_position(F.array(*(F.lit(f) for f in I.PREFERENCE)), F.col("format"))
    priority = F.when(place == 0, F.lit(len(I.PREFERENCE))).otherwise(place)
    return report_index(spark, d).orderBy(F.desc_nulls_last("date"), priority, "report_key").select("report_key", "date", "format")


@query(with_sql("report_index", "SELECT model, max(date) AS date, max_by(report_key, (date, report_key)) AS report_key FROM report_index WHERE vulnerability_type = 'Executive Summary' GROUP BY model"))
def w2_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    i = report_index(spark, d).filter(F.col("vulnerability_type") == I.EXECUTIVE)
    return i.groupBy("model").agg(F.max("date").alias("date"), F.max_by("report_key", F.struct("date", "report_key")).alias("report_key"))


@query(with_sql("report_index", "SELECT report_key, CASE WHEN report_key % 4 = 0 THEN project WHEN report_key % 4 = 1 THEN NULL ELSE model END AS picked FROM report_index"))
def l7_sorted_map(spark: SparkSession, d: str) -> DataFrame:
    """The last entry of a map by its key, regardless of case."""
    pairs = F.when(F.col("report_key") % 4 == 1, F.array().cast("array<struct<k:string,v:string>>")).otherwise(F.array(F.struct(F.when(F.col("report_key") % 4 == 0, F.lit("Zeta")).otherwise(F.lit("alpha")).alias("k"), F.col("project").alias("v")), F.struct(F.lit("Mid").alias("k"), F.col("model").alias("v"))))
    ordered = F.array_sort(pairs, lambda a, b: F.when(F.lower(a.k) < F.lower(b.k), -1).when(F.lower(a.k) > F.lower(b.k), 1).otherwise(0))
    return report_index(spark, d).select("report_key", F.get(ordered, F.size(ordered) - 1).getField("v").alias("picked"))


@query(with_sql("code_files", "SELECT file_id AS id, path AS key, CAST(file_id % 3 AS INT) AS rank FROM code_files"))
def j4_path_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    """Paths as they are, below another root, and in another folder."""
    files = code_files(spark, d)
    k = F.col("file_id")
    path = F.when(k % 3 == 0, F.col("path")).when(k % 3 == 1, F.concat(F.lit("/root/"), "path")).otherwise(F.concat(F.lit("other/"), F.element_at(F.split("path", "/"), -1)))
    return I.suffix_match(files.select(k.alias("id"), path.alias("path")), files.select(F.col("path").alias("key")))
