"""Queries of the pattern scans over generated programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import patterns as P
from auditlake.operators import text as T
from auditlake.registry import query
from auditlake.sources.derived import code_lines, read, with_sql

ALL = {k: p for group in P.CATALOG.values() for k, p in group.items()}


def hits(spark: SparkSession, d: str, *groups: str) -> DataFrame:
    return P.scan_repeated(code_lines(spark, d), {k: p for g in groups for k, p in P.CATALOG[g].items()})


def hits_sql(group: str) -> str:
    return f"hits AS ({P.scan_sql(P.CATALOG[group])})"


SEVERITY_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in P.SEVERITY.items()) + " ELSE 'high' END"


def catalog_rows() -> list[tuple[str, str, int, str]]:
    return [(g, k, i, x) for g, kinds in P.CATALOG.items() for k, p in kinds.items() for i, x in enumerate(p)]


def each_pattern_sql() -> str:
    """Lines that each single pattern of the catalog matches."""
    return " UNION ALL ".join("SELECT '{}' AS group_name, '{}' AS kind, {} AS ord, '{}' AS pattern, count(*) FILTER (regexp_matches(rtrim(line), '{}')) AS n_lines FROM code_lines".format(g, k, i, *[x.replace("'", "''")] * 2) for g, k, i, x in catalog_rows())


@query(with_sql("code_lines", each_pattern_sql()))
def p1_pattern_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog, a row a pattern, with the lines of the corpus that it matches; those that match none stay."""
    catalog = spark.createDataFrame(catalog_rows(), "group_name string, kind string, ord int, pattern string")
    texts = code_lines(spark, d).groupBy("line").agg(F.count("*").alias("times"))
    found = P.scan(texts, {f"{k}#{i}": [x] for _, k, i, x in catalog_rows()}).groupBy("kind").agg(F.sum("times").alias("n"))
    found = found.select(F.col("kind").alias("_id"), "n")
    own = F.concat_ws("#", "kind", F.col("ord").cast("string"))
    return F.broadcast(catalog).join(found, own == F.col("_id"), "left").select("group_name", "kind", "ord", "pattern", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(with_sql("code_lines", f"WITH hits AS ({P.scan_sql(ALL)}) SELECT kind, count(*) AS n FROM hits GROUP BY kind"))
def p3_regex_scan(spark: SparkSession, d: str) -> DataFrame:
    """Equal lines are counted first, so each text meets the catalog once, and in as many tasks as a shuffle has."""
    texts = code_lines(spark, d).groupBy("line").agg(F.count("*").alias("times"))
    return P.scan(texts, ALL).groupBy("kind").agg(F.sum("times").alias("n"))


@query(with_sql("code_lines", f"WITH {hits_sql('sink')} SELECT DISTINCT file_id, line_no, kind FROM hits"))
def p5_hit_dedup(spark: SparkSession, d: str) -> DataFrame:
    twice = hits(spark, d, "sink").union(hits(spark, d, "sink").filter("line_no > 1"))
    return twice.dropDuplicates(["kind", "file_id", "line_no"]).select("file_id", "line_no", "kind")


@query(with_sql("code_lines", f"WITH {hits_sql('sink')} SELECT file_id, line_no, kind, greatest(1, line_no - 2) AS start_line, line_no + 2 AS end_line FROM hits"))
def p6_citations(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d, "sink").withColumn("c", P.citation(2)).select("file_id", "line_no", "kind", "c.start_line", "c.end_line")


@query(with_sql("code_lines", f"WITH {hits_sql('entry')} SELECT h.file_id, h.line_no, h.kind, nullif(regexp_extract(l.line, '[''\"]([^''\"]*)[''\"]', 1), '') AS route FROM hits h JOIN code_lines l USING (file_id, line_no)"))
def p7_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d, "entry").select("file_id", "line_no", "kind", P.route(F.col("line")).alias("route"))


@query(with_sql("code_lines", f"WITH {hits_sql('entry')} SELECT file_id, string_agg(kind || ':' || line_no, ',' ORDER BY line_no, kind) AS entry_points FROM hits GROUP BY file_id"))
def p8_entry_points_by_file(spark: SparkSession, d: str) -> DataFrame:
    """The entry points of every file."""
    found = F.array_sort(F.collect_list(F.struct("line_no", "kind")))
    points = F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["line_no"].cast("string"))), ",")
    return hits(spark, d, "entry").groupBy("file_id").agg(points.alias("entry_points"))


def _severity_query(group: str) -> str:
    return with_sql("code_lines", f"WITH {hits_sql(group)} SELECT file_id, line_no, kind, {SEVERITY_SQL} AS severity FROM hits")


def _severities(spark: SparkSession, d: str, group: str) -> DataFrame:
    return hits(spark, d, group).select("file_id", "line_no", "kind", P.severity(F.col("kind")).alias("severity"))


@query(_severity_query("config"))
def p9_config_audit(spark: SparkSession, d: str) -> DataFrame:
    return _severities(spark, d, "config")


@query(_severity_query("crypto"))
def p10_crypto_scan(spark: SparkSession, d: str) -> DataFrame:
    return _severities(spark, d, "crypto")


@query(_severity_query("logging"))
def p11_sensitive_logging(spark: SparkSession, d: str) -> DataFrame:
    return _severities(spark, d, "logging")


@query(_severity_query("secret"))
def p12_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return _severities(spark, d, "secret")


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), hits AS ({P.scan_sql(P.CATALOG['secret'], 'l', 'doc_id')}) SELECT doc_id, kind, count(*) AS n FROM hits GROUP BY doc_id, kind")
def p12_secret_scan_documents(spark: SparkSession, d: str) -> DataFrame:
    lines = T.exploded(read(spark, d, "documents").select("doc_id", "text"), "text")
    return P.scan(lines, P.CATALOG["secret"]).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


NULLIFY_SQL = "kind IN (" + ", ".join(f"'{k}'" for k in P.NULLIFYING) + ")"


@query(with_sql("code_lines", f"WITH {hits_sql('mitigation')} SELECT file_id, count(*) AS n, bool_or({NULLIFY_SQL}) AS nullified FROM hits GROUP BY file_id"))
def p13_mitigations(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d, "mitigation")
    return h.groupBy("file_id").agg(F.count("*").alias("n"), F.bool_or(F.col("kind").isin(*P.NULLIFYING)).alias("nullified"))


@query(with_sql("code_lines", f"WITH {hits_sql('control')} SELECT file_id, line_no, kind FROM hits"))
def p14_authz_scan(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d, "control").select("file_id", "line_no", "kind")


#: Bundles of controls and the kinds that belong to each. Fixed values.
BUNDLES = [("csrf", "csrf_protection"), ("session", "login_required"), ("session", "session_config"), ("jwt", "jwt_verify"), ("cors", "cors_policy"), ("auth", "login_required"), ("auth", "permission_check")]


@query(with_sql("code_lines", f"WITH {hits_sql('control')}, b(bundle, kind) AS (VALUES {', '.join(str(x) for x in BUNDLES)}), f AS (SELECT DISTINCT file_id FROM hits) SELECT f.file_id, b.bundle, count(h.kind) AS n_hits, bool_or(h.kind IS NOT NULL) AS present FROM f CROSS JOIN b LEFT JOIN hits h ON h.file_id = f.file_id AND h.kind = b.kind GROUP BY 1, 2"))
def p15_composite_controls(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame(BUNDLES, "bundle string, kind string")
    h = hits(spark, d, "control")
    found = h.join(F.broadcast(b), "kind").groupBy("file_id", "bundle").agg(F.count("*").alias("n"))
    asked = h.select("file_id").distinct().select("file_id", F.explode(F.array(*(F.lit(x) for x in sorted({n for n, _ in BUNDLES})))).alias("bundle"))
    return asked.join(found, ["file_id", "bundle"], "left").select("file_id", "bundle", F.coalesce("n", F.lit(0)).alias("n_hits"), F.col("n").isNotNull().alias("present"))
