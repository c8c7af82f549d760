"""Queries of evidence joins and verdicts over generated programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import evidence as E
from auditlake.operators import fitting as X
from auditlake.operators import patterns as P
from auditlake.operators import routing as G
from auditlake.plans.patterns import NULLIFY_SQL, SEVERITY_SQL, hits, hits_sql
from auditlake.registry import query
from auditlake.session import cut_lineage
from auditlake.sources.derived import code_lines, read, with_sql

DEF_SQL = "nullif(regexp_extract(line, '^\\s*(?:def|function|func|fn|sub)\\s+([A-Za-z0-9_]+)\\s*\\(', 1), '')"
PLACED = f"""defs AS (SELECT *, {DEF_SQL} AS d FROM code_lines),
placed AS (SELECT file_id, line_no, line, last_value(d IGNORE NULLS) OVER w AS symbol, last_value(CASE WHEN d IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS symbol_line FROM defs WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


@query(with_sql("code_lines", f"WITH {PLACED} SELECT file_id, line_no, symbol, symbol_line FROM placed"))
def j5_enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    return E.enclosing(code_lines(spark, d)).select("file_id", "line_no", "symbol", "symbol_line")


@query(with_sql("code_lines", f"WITH {PLACED} SELECT symbol, count(*) AS n FROM placed WHERE symbol IS NOT NULL GROUP BY symbol"))
def w6_last_definition(spark: SparkSession, d: str) -> DataFrame:
    return E.enclosing(code_lines(spark, d)).filter("symbol is not null").groupBy("symbol").agg(F.count("*").alias("n"))


@query(with_sql("code_lines", f"WITH {hits_sql('sink')}, entries AS ({P.scan_sql(P.CATALOG['entry'])}) SELECT h.file_id, h.line_no, h.kind, min(e.line_no) AS entry_line, min_by(e.kind, (e.line_no, e.kind)) AS entry_kind FROM hits h JOIN entries e ON e.file_id = h.file_id AND h.line_no BETWEEN e.line_no - 3 AND e.line_no + 5 GROUP BY 1, 2, 3"))
def j6_entry_band(spark: SparkSession, d: str) -> DataFrame:
    return E.near_entry(hits(spark, d, "sink", "entry"), list(P.CATALOG["entry"]))


BFS = "".join(
    f""", f{k} AS (SELECT e.caller AS symbol, {k} AS depth, min(e.caller || '>' || f.chain) AS chain FROM f{k - 1} f JOIN edges e ON e.callee = f.symbol WHERE e.caller NOT IN (SELECT symbol FROM s{k - 1}) GROUP BY 1),
s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k})"""
    for k in range(1, 6)
)


@query(with_sql("code_lines", f"WITH {PLACED}, calls AS (SELECT DISTINCT file_id, line_no, symbol AS caller, callee FROM (SELECT file_id, line_no, symbol, unnest(regexp_extract_all(line, '([A-Za-z0-9_]+)\\(', 1)) AS callee FROM placed WHERE {DEF_SQL} IS NULL)), first AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY file_id, line_no) AS n FROM calls), edges AS (SELECT DISTINCT callee, caller FROM first WHERE n <= 20 AND caller IS NOT NULL AND caller <> callee), f0 AS (SELECT 'execute' AS symbol, 0 AS depth, 'execute' AS chain), s0 AS (SELECT * FROM f0){BFS} SELECT symbol, depth, chain FROM s5"))
def j7_recursive_callers(spark: SparkSession, d: str) -> DataFrame:
    edges = E.call_edges(code_lines(spark, d))
    return E.callers(edges, spark.createDataFrame([("execute",)], "symbol string"))


TRACE_LEVELS = "".join(
    f""", h{k} AS (SELECT f.root, c.file_id, c.line_no, c.entry_line, c.entry_kind, c.caller, c.callee, c.file_id || ':' || c.line_no || '>' || f.hops AS hops FROM g{k - 1} f JOIN calls c ON c.callee = f.symbol),
g{k} AS (SELECT root, caller AS symbol, min_by(hops, (file_id, line_no, callee, hops)) AS hops FROM h{k} WHERE entry_line IS NULL AND (root, caller) NOT IN (SELECT (root, symbol) FROM t{k - 1}) GROUP BY 1, 2),
t{k} AS (SELECT root, symbol FROM t{k - 1} UNION ALL SELECT root, symbol FROM g{k})"""
    for k in range(1, 6)
)
TRACE_SQL = f"""WITH {PLACED}, {hits_sql('sink')}, entries AS ({P.scan_sql(P.CATALOG['entry'])}),
near AS (SELECT p.file_id, p.line_no, min(e.line_no) AS entry_line, min_by(e.kind, (e.line_no, e.kind)) AS entry_kind FROM placed p JOIN entries e ON e.file_id = p.file_id AND p.line_no BETWEEN e.line_no - 3 AND e.line_no + 5 GROUP BY 1, 2),
own AS (SELECT p.file_id, p.line_no, min(e.line_no) AS entry_line, min_by(e.kind, (e.line_no, e.kind)) AS entry_kind FROM placed p JOIN entries e ON e.file_id = p.file_id AND p.symbol_line - e.line_no BETWEEN 0 AND 4 GROUP BY 1, 2),
every AS (SELECT DISTINCT file_id, line_no, symbol AS caller, callee FROM (SELECT file_id, line_no, symbol, unnest(regexp_extract_all(line, '([A-Za-z0-9_]+)\\(', 1)) AS callee FROM placed WHERE symbol IS NOT NULL AND {DEF_SQL} IS NULL)),
calls AS (SELECT n.*, near.entry_line, near.entry_kind FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY file_id, line_no) AS n FROM every) n LEFT JOIN near USING (file_id, line_no) WHERE n <= 20),
asked AS (SELECT DISTINCT h.file_id, h.line_no, p.symbol FROM hits h JOIN placed p USING (file_id, line_no) WHERE p.symbol IS NOT NULL),
g0 AS (SELECT DISTINCT symbol AS root, symbol, '' AS hops FROM asked), t0 AS (SELECT root, symbol FROM g0){TRACE_LEVELS},
up AS ({' UNION ALL '.join(f'SELECT root, {k} AS depth, file_id, line_no, callee, entry_line, entry_kind, hops FROM h{k} WHERE entry_line IS NOT NULL' for k in range(1, 6))}),
six AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, file_id, line_no, callee) AS n FROM up) WHERE n <= 6),
paths AS (
  SELECT a.file_id, a.line_no, a.symbol, 0 AS depth, a.file_id AS f, a.line_no AS l, '' AS callee, o.entry_line, o.entry_kind, '' AS hops FROM asked a JOIN own o USING (file_id, line_no)
  UNION ALL SELECT a.file_id, a.line_no, a.symbol, depth, s.file_id, s.line_no, callee, entry_line, entry_kind, hops FROM asked a JOIN six s ON s.root = a.symbol),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line_no ORDER BY depth, f, l, callee) AS rank FROM paths) WHERE rank <= 6)
SELECT a.file_id, a.line_no, a.symbol, coalesce(r.rank, 1) AS rank, coalesce(r.depth, 0) AS depth, r.f AS entry_file, r.entry_line, r.entry_kind, coalesce(r.hops, '') || a.file_id || ':' || a.line_no AS hops FROM asked a LEFT JOIN ranked r USING (file_id, line_no)"""


@query(with_sql("code_lines", TRACE_SQL))
def j7_traces_to_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """From every sink up its callers to entry points; partial paths where none is reached."""
    found = hits(spark, d, "sink", "entry")
    entry = F.col("kind").isin(list(P.CATALOG["entry"]))
    return E.traces(code_lines(spark, d), found.filter(entry), found.filter(~entry))


#: What TRACE_SQL starts from, with all call places.
WHOLE_CALLS = f"""{PLACED}, {hits_sql('sink')}, entries AS ({P.scan_sql(P.CATALOG['entry'])}),
near AS (SELECT p.file_id, p.line_no, min(e.line_no) AS entry_line, min_by(e.kind, (e.line_no, e.kind)) AS entry_kind FROM placed p JOIN entries e ON e.file_id = p.file_id AND p.line_no BETWEEN e.line_no - 3 AND e.line_no + 5 GROUP BY 1, 2),
own AS (SELECT p.file_id, p.line_no, min(e.line_no) AS entry_line, min_by(e.kind, (e.line_no, e.kind)) AS entry_kind FROM placed p JOIN entries e ON e.file_id = p.file_id AND p.symbol_line - e.line_no BETWEEN 0 AND 4 GROUP BY 1, 2),
every AS (SELECT DISTINCT file_id, line_no, symbol AS caller, callee FROM (SELECT file_id, line_no, symbol, unnest(regexp_extract_all(line, '([A-Za-z0-9_]+)\\(', 1)) AS callee FROM placed WHERE symbol IS NOT NULL AND {DEF_SQL} IS NULL)),
calls AS (SELECT every.*, near.entry_line, near.entry_kind FROM every LEFT JOIN near USING (file_id, line_no)),
asked AS (SELECT DISTINCT h.file_id, h.line_no, p.symbol FROM hits h JOIN placed p USING (file_id, line_no) WHERE p.symbol IS NOT NULL)"""
#: A row for each root and level: the newest symbols with their ways down, and all symbols so far.
WHOLE_WALK = """walk AS (
  SELECT DISTINCT symbol AS root, 0 AS depth, [{'s': symbol, 'h': ''}] AS front, [symbol] AS seen FROM asked
  UNION ALL
  SELECT root, depth + 1, list({'s': caller, 'h': h}), list_concat(any_value(seen), list(caller)) FROM (
    SELECT w.root, w.depth, w.seen, c.caller, min_by(c.file_id || ':' || c.line_no || CASE w.f.h WHEN '' THEN '' ELSE '>' || w.f.h END, (c.file_id, c.line_no, c.callee)) AS h
    FROM (SELECT root, depth, seen, unnest(front) AS f FROM walk) w JOIN calls c ON c.callee = w.f.s WHERE c.entry_line IS NULL AND NOT list_contains(w.seen, c.caller) GROUP BY 1, 2, 3, 4)
  GROUP BY root, depth)"""


def _traced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = hits(spark, d, "sink", "entry")
    entry = F.col("kind").isin(list(P.CATALOG["entry"]))
    return code_lines(spark, d), found.filter(entry), found.filter(~entry)


@query(with_sql("code_lines", f"WITH {WHOLE_CALLS}, {WHOLE_WALK} SELECT w.root AS symbol, w.depth + 1 AS depth, c.file_id AS entry_file, c.line_no, c.callee, c.entry_line, c.entry_kind, c.file_id || ':' || c.line_no || CASE w.f.h WHEN '' THEN '' ELSE '>' || w.f.h END AS hops FROM (SELECT root, depth, unnest(front) AS f FROM walk) w JOIN calls c ON c.callee = w.f.s WHERE c.entry_line IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1))
def j7_whole_paths(spark: SparkSession, d: str) -> DataFrame:
    """All paths from entry points down to every symbol that holds sinks: every call place, whatever the depth."""
    return E.whole_paths(*_traced(spark, d))


@query(with_sql("code_lines", f"WITH {WHOLE_CALLS} SELECT a.file_id, a.line_no, a.symbol, o.entry_line, o.entry_kind FROM asked a LEFT JOIN own o USING (file_id, line_no)"))
def j7_whole_sinks(spark: SparkSession, d: str) -> DataFrame:
    """The sinks with their symbols, whose paths `j7_whole_paths` has, and with the entry point of their own definition."""
    return E.traced_sinks(*_traced(spark, d))


SOURCE_ORDER = list(P.CATALOG["source"])
FIRST_SOURCE = "list_position([" + ", ".join(f"'{k}'" for k in SOURCE_ORDER) + "], kind)"
USED = "list_contains(regexp_extract_all(k.line, '([$@]?[A-Za-z_][A-Za-z0-9_]*)', 1), v.variable)"


@query(with_sql("code_lines", f"""WITH {hits_sql('sink')}, src AS ({P.scan_sql(P.CATALOG['source'])}),
one AS (SELECT file_id, line_no, min_by(kind, {FIRST_SOURCE}) AS kind FROM src GROUP BY 1, 2),
v0 AS (SELECT o.file_id, o.line_no AS source_line, o.kind AS source_kind, nullif(regexp_extract(l.line, '^\\s*(?:let |var |const |final )?([$@]?[A-Za-z_][A-Za-z0-9_]*)\\s*:?=\\s*([^=].*)$', 1), '') AS variable FROM one o JOIN code_lines l USING (file_id, line_no)),
k AS (SELECT h.*, l.line FROM hits h JOIN code_lines l USING (file_id, line_no)),
v AS (SELECT k.file_id, k.line_no, k.kind, k.line, coalesce(variable, '#' || source_line) AS own, max_by(source_kind, source_line) AS source_kind, max(variable) AS variable FROM k JOIN v0 ON v0.file_id = k.file_id AND source_line BETWEEN k.line_no - 60 AND k.line_no + 60 GROUP BY 1, 2, 3, 4, 5)
SELECT DISTINCT file_id, line_no, kind AS sink_kind, source_kind FROM v WHERE variable IS NULL OR list_contains(regexp_extract_all(line, '([$@]?[A-Za-z_][A-Za-z0-9_]*)', 1), variable)"""))
def j8_taint_flows(spark: SparkSession, d: str) -> DataFrame:
    return E.taint_flows(hits(spark, d, "sink", "source"), SOURCE_ORDER)


REQUIRED = ["login_required", "permission_check", "csrf_protection"]
ASKED = "asked AS (SELECT file_id, line_no, unnest(['login_required', 'permission_check', 'csrf_protection']) AS kind FROM code_lines WHERE line_no = 1)"


@query(with_sql("code_lines", f"WITH {hits_sql('control')}, {ASKED}, c AS (SELECT file_id, kind, count(*) AS n, min(line_no) AS first_line FROM hits GROUP BY 1, 2) SELECT a.file_id AS finding_id, a.kind, c.n IS NOT NULL AS present, coalesce(c.n, 0) AS n_places, c.first_line FROM asked a LEFT JOIN c ON c.file_id = a.file_id AND c.kind = a.kind"))
def j9_required_controls(spark: SparkSession, d: str) -> DataFrame:
    asked = code_lines(spark, d).filter("line_no = 1").select(F.col("file_id").alias("finding_id"), "file_id", F.explode(F.array(*(F.lit(k) for k in REQUIRED))).alias("kind"))
    return E.required_controls(asked, hits(spark, d, "control"))


@query(with_sql("code_lines", f"WITH {hits_sql('control')}, {ASKED} SELECT a.file_id, a.kind FROM asked a WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.file_id = a.file_id AND h.kind = a.kind)"))
def o5_missing_controls(spark: SparkSession, d: str) -> DataFrame:
    asked = code_lines(spark, d).filter("line_no = 1").select("file_id", F.explode(F.array(*(F.lit(k) for k in REQUIRED))).alias("kind"))
    return asked.join(hits(spark, d, "control"), ["file_id", "kind"], "left_anti").select("file_id", "kind")


#: Type, family, CWE and sink kinds. Fixed values.
DESCRIPTORS = [
    ("SQL Injection", "flow", "CWE-89", "sql_execute"), ("Command Injection", "flow", "CWE-78", "os_exec"), ("Code Injection", "flow", "CWE-94", "eval_exec"),
    ("Path Traversal", "flow", "CWE-22", "file_open"), ("Cross-Site Scripting", "flow", "CWE-79", "innerHTML_write"), ("Insecure Deserialization", "flow", "CWE-502", "deserialize_call"),
    ("Server-Side Request Forgery", "flow", "CWE-918", "url_fetch"), ("Open Redirect", "flow", "CWE-601", "redirect_call"), ("XML External Entity", "flow", "CWE-611", "xml_parse"),
]
DESCRIPTOR_SQL = "d(name, family, cwe, kind) AS (VALUES " + ", ".join(str(x) for x in DESCRIPTORS) + ")"


@query(with_sql("code_lines", f"WITH {hits_sql('sink')}, {DESCRIPTOR_SQL} SELECT d.name, d.family, d.cwe, count(*) AS n FROM hits JOIN d USING (kind) GROUP BY 1, 2, 3"))
def j12_descriptor_lookup(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(DESCRIPTORS, "name string, family string, cwe string, kind string")
    return hits(spark, d, "sink").join(F.broadcast(table), "kind").groupBy("name", "family", "cwe").agg(F.count("*").alias("n"))


@query(with_sql("code_lines", f"WITH {hits_sql('sink')}, {DESCRIPTOR_SQL} SELECT d.kind FROM d WHERE kind IN (SELECT kind FROM hits)"))
def o6_kinds_in_use(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(DESCRIPTORS, "name string, family string, cwe string, kind string").select("kind")
    return table.intersect(hits(spark, d, "sink").select("kind"))


STREAMS = ["entry", "sink", "mitigation", "control", "config"]


@query(with_sql("code_lines", "WITH " + ", ".join(f"h{i} AS ({P.scan_sql(P.CATALOG[g])})" for i, g in enumerate(STREAMS)) + ", u AS (" + " UNION ALL ".join(f"SELECT file_id, line_no, {i} AS source FROM h{i}" for i in range(len(STREAMS))) + ") SELECT file_id, line_no AS start_line, line_no AS end_line, min(source) AS source FROM u GROUP BY file_id, line_no"))
def o3_distinct_citations(spark: SparkSession, d: str) -> DataFrame:
    """The citations of all evidence streams, each place once, by the first stream that has it."""
    parts = [hits(spark, d, g).select("file_id", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.lit(i).alias("source")) for i, g in enumerate(STREAMS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("file_id", "start_line", "end_line").agg(F.min("source").alias("source"))


@query(with_sql("code_lines", f"WITH {hits_sql('entry')}, p AS (SELECT file_id, min(line_no) AS entry_line FROM hits WHERE file_id % 2 = 0 GROUP BY 1), x AS (SELECT file_id, count(*) FILTER (line_no IN (SELECT entry_line FROM p WHERE p.file_id = hits.file_id)) AS n FROM hits GROUP BY 1) SELECT h.file_id, h.line_no, h.kind FROM hits h WHERE h.line_no = (SELECT entry_line FROM p WHERE p.file_id = h.file_id) OR NOT EXISTS (SELECT 1 FROM p WHERE p.file_id = h.file_id)"))
def j13_presented_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry points that a path names; all of a file where no path names any. Paths start at the first entry
    of the files of even number."""
    e = hits(spark, d, "entry").select("file_id", "line_no", "kind")
    paths = e.filter("file_id % 2 = 0").groupBy("file_id").agg(F.min("line_no").alias("line_no"))
    named = e.join(paths, ["file_id", "line_no"], "left_semi")
    return named.union(e.join(paths.select("file_id"), "file_id", "left_anti").select("file_id", "line_no", "kind"))


#: Evidence of each order, from its lines.
EVIDENCE_SQL = """ev AS (SELECT l_orderkey AS finding_id, CASE l_orderkey % 3 WHEN 0 THEN 'flow' WHEN 1 THEN 'access' ELSE 'config' END AS family,
  bool_or(l_partkey % 19 = 0) AS nullified, bool_or(l_partkey % 5 = 0) AS soft, bool_or(l_suppkey % 4 = 0) AS reaches, bool_or(l_suppkey % 6 = 1) AS taint, bool_or(l_linenumber > 2) AS entries,
  count(*) FILTER (l_linenumber < 4) AS checks, count(*) FILTER (l_linenumber < 4 AND l_discount > 0.03) AS missing, bool_or(l_tax > 0.05) AS authz,
  count(*) FILTER (l_quantity > 25) AS found, CAST(max(l_linenumber % 5) AS INT) AS top_rank, bool_and(l_quantity < 5) AS only_errors, bool_or(l_partkey % 17 = 0) AS exhausted FROM lineitem GROUP BY 1)"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    f = F.expr
    return li.groupBy(F.col("l_orderkey").alias("finding_id")).agg(
        f("CASE min(l_orderkey) % 3 WHEN 0 THEN 'flow' WHEN 1 THEN 'access' ELSE 'config' END AS family"), f("bool_or(l_partkey % 19 = 0) AS nullified"), f("bool_or(l_partkey % 5 = 0) AS soft"),
        f("bool_or(l_suppkey % 4 = 0) AS reaches"), f("bool_or(l_suppkey % 6 = 1) AS taint"), f("bool_or(l_linenumber > 2) AS entries"), f("count_if(l_linenumber < 4) AS checks"),
        f("count_if(l_linenumber < 4 AND l_discount > 0.03) AS missing"), f("bool_or(l_tax > 0.05) AS authz"), f("count_if(l_quantity > 25) AS found"), f("max(l_linenumber % 5) AS top_rank"),
        f("bool_and(l_quantity < 5) AS only_errors"), f("bool_or(l_partkey % 17 = 0) AS exhausted"),
    )


FLOW_SQL = "CASE WHEN nullified THEN {'s': 'fully_mitigated', 'c': 0.85} WHEN reaches AND taint AND NOT soft THEN {'s': 'confirmed_exploitable', 'c': 0.90} WHEN (reaches OR taint) AND soft THEN {'s': 'partial_mitigation', 'c': 0.60} WHEN reaches OR taint THEN {'s': 'likely_exploitable', 'c': 0.65} WHEN NOT entries THEN {'s': 'unreachable', 'c': 0.55} ELSE {'s': 'insufficient_signal', 'c': 0.30} END"
ACCESS_SQL = "CASE WHEN checks > 0 AND missing = 0 THEN {'s': 'fully_mitigated', 'c': 0.85} WHEN missing > 0 AND missing = checks THEN {'s': 'confirmed_exploitable', 'c': 0.85} WHEN missing > 0 THEN {'s': 'partial_mitigation', 'c': 0.60} WHEN authz THEN {'s': 'likely_exploitable', 'c': 0.55} ELSE {'s': 'insufficient_signal', 'c': 0.30} END"
CONFIG_SQL = "CASE WHEN found = 0 THEN {'s': 'fully_mitigated', 'c': 0.70} WHEN top_rank >= 3 THEN {'s': 'confirmed_exploitable', 'c': 0.80} ELSE {'s': 'partial_mitigation', 'c': 0.55} END"


def _one(sql: str) -> str:
    return f"WITH {EVIDENCE_SQL}, v AS (SELECT finding_id, {sql} AS v FROM ev) SELECT finding_id, v.s AS status, CAST(v.c AS DOUBLE) AS confidence FROM v"



def _flow() -> F.Column:
    return E.flow_verdict(F.col("nullified"), F.col("soft"), F.col("reaches"), F.col("taint"), F.col("entries"))


def _access() -> F.Column:
    return E.access_verdict(F.col("checks"), F.col("missing"), F.col("authz"))


def _config() -> F.Column:
    return E.config_verdict(F.col("found"), F.col("top_rank"))


@query(_one(FLOW_SQL))
def v1_flow_verdict(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).withColumn("v", _flow()).select("finding_id", "v.status", "v.confidence")


@query(_one(ACCESS_SQL))
def v2_access_verdict(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).withColumn("v", _access()).select("finding_id", "v.status", "v.confidence")


@query(_one(CONFIG_SQL))
def v3_config_verdict(spark: SparkSession, d: str) -> DataFrame:
    return evidence(spark, d).withColumn("v", _config()).select("finding_id", "v.status", "v.confidence")


@query(f"WITH {EVIDENCE_SQL}, v AS (SELECT *, CASE WHEN only_errors THEN {{'s': 'error', 'c': 0.0}} WHEN family = 'flow' THEN {FLOW_SQL} WHEN family = 'access' THEN {ACCESS_SQL} ELSE {CONFIG_SQL} END AS v FROM ev) SELECT finding_id, v.s AS status, CAST(round(CASE WHEN exhausted AND NOT only_errors THEN greatest(0.1, v.c - 0.15) ELSE v.c END, 2) AS DOUBLE) AS confidence FROM v")
def v4_combined_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = E.combined_verdict(F.col("family"), _flow(), _access(), _config(), F.col("only_errors"), F.col("exhausted"))
    return evidence(spark, d).withColumn("v", v).select("finding_id", "v.status", "v.confidence")


RANK_SQL = f"CASE {SEVERITY_SQL} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
VERDICT_SQL = f"CASE family WHEN 'flow' THEN {FLOW_SQL} WHEN 'access' THEN {ACCESS_SQL} ELSE {CONFIG_SQL} END"


JOINED_EV = f"""WITH {hits_sql('sink')}, src AS ({P.scan_sql(P.CATALOG['source'])}), en AS ({P.scan_sql(P.CATALOG['entry'])}), mi AS ({P.scan_sql(P.CATALOG['mitigation'])}), co AS ({P.scan_sql(P.CATALOG['control'])}), cf AS ({P.scan_sql(P.CATALOG['config'])}),
var AS (SELECT s.file_id, s.line_no AS src_line, nullif(regexp_extract(l.line, '^\\s*(?:let |var |const |final )?([$@]?[A-Za-z_][A-Za-z0-9_]*)\\s*:?=\\s*([^=].*)$', 1), '') AS variable FROM src s JOIN code_lines l USING (file_id, line_no)),
k AS (SELECT h.*, l.line FROM hits h JOIN code_lines l USING (file_id, line_no)),
reach AS (SELECT DISTINCT k.file_id, k.kind FROM k JOIN en ON en.file_id = k.file_id AND k.line_no BETWEEN en.line_no - 3 AND en.line_no + 5),
taint AS (SELECT DISTINCT k.file_id, k.kind FROM k JOIN var ON var.file_id = k.file_id AND src_line BETWEEN k.line_no - 60 AND k.line_no + 60 WHERE variable IS NULL OR list_contains(regexp_extract_all(k.line, '([$@]?[A-Za-z_][A-Za-z0-9_]*)', 1), variable)),
ev AS (SELECT f.file_id, f.kind, 'flow' AS family, f.file_id IN (SELECT file_id FROM mi WHERE {NULLIFY_SQL}) AS nullified, f.file_id IN (SELECT file_id FROM mi WHERE NOT ({NULLIFY_SQL})) AS soft, r.kind IS NOT NULL AS reaches, t.kind IS NOT NULL AS taint, f.file_id IN (SELECT file_id FROM en) AS entries, NULL AS checks, NULL AS missing, NULL AS authz, NULL AS found, NULL AS top_rank
  FROM (SELECT DISTINCT file_id, kind FROM hits) f LEFT JOIN reach r ON r.file_id = f.file_id AND r.kind = f.kind LEFT JOIN taint t ON t.file_id = f.file_id AND t.kind = f.kind
  UNION ALL SELECT a.file_id, family, family, NULL, NULL, NULL, NULL, NULL, 3, 3 - coalesce(c.present, 0), c.file_id IS NOT NULL, coalesce(g.found, 0), coalesce(g.top_rank, 0)
  FROM (SELECT DISTINCT file_id, unnest(['access', 'config']) AS family FROM code_lines) a
  LEFT JOIN (SELECT file_id, count(DISTINCT kind) FILTER (kind IN ('login_required', 'permission_check', 'csrf_protection')) AS present FROM co GROUP BY 1) c ON c.file_id = a.file_id
  LEFT JOIN (SELECT file_id, count(*) AS found, max({RANK_SQL}) AS top_rank FROM cf GROUP BY 1) g ON g.file_id = a.file_id)"""
EVIDENCE_ONLY_SQL = f"{JOINED_EV} SELECT * FROM ev"
JOINED_SQL = f"""{JOINED_EV}
SELECT file_id, family, kind, v.s AS status, CAST(v.c AS DOUBLE) AS confidence FROM (SELECT *, {VERDICT_SQL} AS v FROM ev)"""


GROUPS = {g: list(P.CATALOG[g]) for g in ("sink", "source", "entry", "mitigation", "control", "config")}


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """The lines with their kinds of all groups; those without one stay."""
    return P.scan_repeated(code_lines(spark, d), {k: p for g in GROUPS for k, p in P.CATALOG[g].items()}, keep=True)


def _evidence(found: DataFrame) -> DataFrame:
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in (("critical", 4), ("high", 3), ("medium", 2), ("low", 1)) for x in pair)), P.severity(F.col("kind")))
    return E.joined_evidence(found, GROUPS, list(P.NULLIFYING), REQUIRED, rank)


def _verdicts(found: DataFrame) -> DataFrame:
    v = E.combined_verdict(F.col("family"), _flow(), _access(), _config(), F.lit(False), F.lit(False))
    return _evidence(found).withColumn("v", v).select("file_id", "family", "kind", "v.status", "v.confidence")


@query(with_sql("code_lines", JOINED_SQL))
def v4_joined_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts over the evidence that the scans of the files themselves give, in one scan of all kinds."""
    return _verdicts(_scanned(spark, d))


#: Lists of a finding's document, in order, with the group of hits that each holds; `notes` are the file's other sinks.
LISTS = [("entry_points", "entry"), ("sources", "source"), ("mitigations", "mitigation"), ("control_checks", "control"), ("config_findings", "config"), ("citations", "sink"), ("notes", "sink")]


@query(with_sql("code_lines", f"""WITH joined AS ({JOINED_SQL}),
hit AS ({" UNION ALL ".join(f"SELECT file_id, line_no, kind, '{g}' AS grp FROM ({P.scan_sql(P.CATALOG[g])})" for g in ("entry", "source", "mitigation", "control", "config", "sink"))}),
f AS (SELECT file_id, family, kind, (file_id * 37) % 560 AS budget, '{{"status":"' || status || '","confidence":' || CAST(round(confidence * 100) AS INT) || ',"family":"' || family || '","kind":"' || kind || '"}}' AS core FROM joined),
l0 AS (SELECT f.file_id, f.family, f.kind, n.idx, n.name, list('{{"line":' || hit.line_no || ',"kind":"' || hit.kind || '"}}' ORDER BY hit.line_no, hit.kind) AS it
  FROM f JOIN hit USING (file_id) JOIN (VALUES {", ".join(f"({i}, '{n}', '{g}')" for i, (n, g) in enumerate(LISTS))}) n(idx, name, grp) ON n.grp = hit.grp
  WHERE CASE n.name WHEN 'citations' THEN hit.kind = f.kind WHEN 'notes' THEN hit.kind <> f.kind ELSE true END GROUP BY ALL),
l1 AS (SELECT f.*, l0.* EXCLUDE (file_id, family, kind), len(it) AS n, l0.name IN ('citations', 'notes') AS ev, list_append(it[1 : len(it) // 2], '{{"_truncated":true,"_omitted_count":' || (len(it) - len(it) // 2) || '}}') AS hi FROM f LEFT JOIN l0 USING (file_id, family, kind)),
l2 AS (SELECT *, CASE WHEN ev AND len(hi) <= 3 THEN hi WHEN ev THEN list_append(hi[1:3], '{{"_truncated":true,"_omitted_count":' || (len(hi) - 3) || '}}') ELSE ['{{"_truncated":true,"_omitted_count":' || len(hi) || '}}'] END AS ci FROM l1),
l3 AS (SELECT *, array_to_string(it, ',') AS t0, array_to_string(hi, ',') AS t1, array_to_string(ci, ',') AS t2, count(*) FILTER (n > 1) OVER (PARTITION BY file_id, family, kind) AS n_long,
  CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY file_id, family, kind, n > 1 ORDER BY -n, idx) END AS hr, CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY file_id, family, kind, n > 1 ORDER BY ev, n // 2, name) END AS cr FROM l2),
base AS (SELECT file_id, family, kind, any_value(budget) AS budget, any_value(core) AS core, any_value(n_long) AS n_long, length(any_value(core)) + coalesce(sum(length(name) + 6 + length(t0)), 0) AS size FROM l3 GROUP BY 1, 2, 3),
st AS (SELECT file_id, family, kind, hr AS ord, length(t1) - length(t0) AS delta FROM l3 WHERE n > 1 UNION ALL SELECT file_id, family, kind, n_long + cr, length(t2) - length(t1) FROM l3 WHERE n > 1),
run AS (SELECT file_id, family, kind, ord, sum(delta) OVER (PARTITION BY file_id, family, kind ORDER BY ord) AS less FROM st),
pick AS (SELECT b.file_id, b.family, b.kind, CASE WHEN any_value(b.size) <= any_value(b.budget) THEN 0 ELSE min(ord) FILTER (b.size + less <= b.budget) END AS k FROM base b LEFT JOIN run r ON r.file_id = b.file_id AND r.family = b.family AND r.kind = b.kind GROUP BY 1, 2, 3),
body AS (SELECT l3.file_id, l3.family, l3.kind, coalesce(string_agg(',"' || name || '":[' || CASE WHEN n > 1 AND n_long + cr <= k THEN t2 WHEN n > 1 AND hr <= k THEN t1 ELSE t0 END || ']', '' ORDER BY idx), '') AS rest FROM l3 JOIN pick p ON p.file_id = l3.file_id AND p.family = l3.family AND p.kind = l3.kind GROUP BY 1, 2, 3)
SELECT b.file_id, b.family, b.kind, b.budget, CASE WHEN k IS NOT NULL THEN left(core, length(core) - 1) || rest || '}}' WHEN length(core) <= b.budget THEN core WHEN b.budget <= {len(X.SUFFIX)} THEN left(core, b.budget) ELSE left(core, b.budget - {len(X.SUFFIX)}) || '{X.SUFFIX}' END AS text,
  CASE WHEN k = 0 THEN 'fits_initial' WHEN k <= n_long THEN 'halved_lists' WHEN k IS NOT NULL THEN 'dropped_lists' WHEN length(core) <= b.budget THEN 'core_only' ELSE 'hard_cap' END AS stage, CASE WHEN k IS NULL THEN n_long ELSE greatest(0, k - n_long) END AS n_cut
FROM base b JOIN pick p ON p.file_id = b.file_id AND p.family = b.family AND p.kind = b.kind JOIN body y ON y.file_id = b.file_id AND y.family = b.family AND y.kind = b.kind"""))
def x28_fitted_validation(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the joined verdicts with their evidence, each fitted into a budget of its own. A file's lists are as
    long as its hits."""
    found = _scanned(spark, d)
    item = F.struct("line_no", "kind", F.concat(F.lit('{"line":'), F.col("line_no").cast("string"), F.lit(',"kind":"'), "kind", F.lit('"}')).alias("json"))
    per_file = found.filter("kind is not null").groupBy("file_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind").isin(kinds), item))).alias(f"_{g}") for g, kinds in GROUPS.items()))
    rows = _verdicts(found).join(per_file, "file_id", "left")
    own = {"citations": lambda x: x.kind == F.col("kind"), "notes": lambda x: x.kind != F.col("kind")}
    items = lambda name, g: F.transform(F.filter(f"_{g}", own.get(name, lambda x: F.lit(True))), lambda x: x.json)
    lists = F.array(*(F.struct(F.lit(name).alias("name"), items(name, g).alias("items")) for name, g in LISTS))
    core = F.concat(F.lit('{"status":"'), "status", F.lit('","confidence":'), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit(',"family":"'), "family", F.lit('","kind":"'), "kind", F.lit('"}'))
    budget = (F.col("file_id") * 37) % 560
    return rows.withColumn("budget", budget).withColumn("x", X.fitted(core, lists, F.col("budget"))).select("file_id", "family", "kind", "budget", "x.text", "x.stage", "x.n_cut")


#: Stages of each family, in order. Fixed values.
ROUTES = {"flow": ["entry_points", "trace", "taint", "mitigations", "verdict"], "access": ["entry_points", "authz", "verdict"], "config": ["config_audit", "verdict"]}


@query(f"WITH {EVIDENCE_SQL} SELECT finding_id, CASE family " + " ".join(f"WHEN '{k}' THEN '{'>'.join(v)}'" for k, v in ROUTES.items()) + " END AS route FROM ev")
def v5_graph_routing(spark: SparkSession, d: str) -> DataFrame:
    route = F.lit(None).cast("string")
    for family, stages in ROUTES.items():
        route = F.when(F.col("family") == family, F.lit(">".join(stages))).otherwise(route)
    return evidence(spark, d).select("finding_id", route.alias("route"))


#: Groups of hits that a stage works through.
WORK = {"entry_points": "entry", "trace": "sink", "taint": "source", "mitigations": "mitigation", "authz": "control", "config_audit": "config"}
ROUTED_SQL = f"""WITH joined_ev AS ({EVIDENCE_ONLY_SQL}), tr AS ({TRACE_SQL}),
hit AS ({" UNION ALL ".join(f"SELECT file_id, line_no, kind, '{stage}' AS stage FROM ({P.scan_sql(P.CATALOG[g])})" for stage, g in WORK.items())}),
led AS (SELECT DISTINCT h.file_id, h.kind FROM hit h JOIN tr ON tr.file_id = h.file_id AND tr.line_no = h.line_no AND tr.entry_line IS NOT NULL WHERE h.stage = 'trace'),
ev AS (SELECT e.* EXCLUDE (reaches), CASE WHEN family = 'flow' THEN l.kind IS NOT NULL END AS reaches, CAST(2 + (e.file_id * 7) % 13 AS DOUBLE) AS budget FROM joined_ev e LEFT JOIN led l ON l.file_id = e.file_id AND l.kind = e.kind),
items AS (SELECT file_id, stage, count(*) AS n FROM hit GROUP BY 1, 2),
moves(fam, src, dst) AS (VALUES {", ".join(map(str, G.TRANSITIONS))}),
walk AS (
  SELECT file_id, family, kind, budget, 'classify' AS node, 0.0::DOUBLE AS spent, 'classify' AS route, []::VARCHAR[] AS ran, 0 AS step FROM ev
  UNION ALL
  SELECT w.file_id, w.family, w.kind, w.budget, m.dst, CASE WHEN m.dst <> 'verdict' AND w.spent < w.budget THEN w.spent + 1.0 + coalesce(i.n, 0) ELSE w.spent END,
         w.route || '>' || m.dst || CASE WHEN m.dst <> 'verdict' AND w.spent >= w.budget THEN '!' ELSE '' END, CASE WHEN m.dst <> 'verdict' AND w.spent < w.budget THEN list_append(w.ran, m.dst) ELSE w.ran END, step + 1
  FROM walk w JOIN moves m ON m.fam = w.family AND m.src = w.node LEFT JOIN items i ON i.file_id = w.file_id AND i.stage = m.dst),
ended AS (SELECT * FROM walk WHERE node = 'verdict'),
told AS (SELECT e.file_id, e.family, e.kind, w.route, w.spent, contains(w.route, '!') AS exhausted, {", ".join((f"list_contains(w.ran, '{stage}') AND coalesce({c}, false) AS {c}" if c in ("entries", "reaches", "taint", "nullified", "soft", "authz") else f"CASE WHEN list_contains(w.ran, '{stage}') THEN {c} ELSE 0 END AS {c}") for stage, columns in G.GIVES.items() for c in columns)}
  FROM ev e JOIN ended w ON w.file_id = e.file_id AND w.family = e.family AND w.kind = e.kind)
SELECT file_id, family, kind, route, spent, exhausted, v.s AS status, CAST(round(CASE WHEN exhausted THEN greatest(0.1, v.c - 0.15) ELSE v.c END, 2) AS DOUBLE) AS confidence FROM (SELECT *, {VERDICT_SQL} AS v FROM told)"""


@query(with_sql("code_lines", ROUTED_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def v5_routed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the scans, with call paths to entry points, walked through the stages of their family under budgets of 2 to 14
    seconds; a verdict reads what the stages that ran have given."""
    found = cut_lineage(_scanned(spark, d))
    return _routed(found, E.traced_evidence(_evidence(found), _of(found, "sink"), E.traces(code_lines(spark, d), _of(found, "entry"), _of(found, "sink"))))


def _of(found: DataFrame, group: str) -> DataFrame:
    return found.filter(F.col("kind").isin(GROUPS[group])).select("file_id", "line_no", "kind")


def _routed(found: DataFrame, ev: DataFrame) -> DataFrame:
    items = found.groupBy("file_id").agg(F.create_map(*(x for stage, g in WORK.items() for x in (F.lit(stage), F.count_if(F.col("kind").isin(GROUPS[g]))))).alias("work"))
    asked = ev.join(items, "file_id").withColumn("budget", (2 + (F.col("file_id") * 7) % 13).cast("double"))
    v = E.combined_verdict(F.col("family"), _flow(), _access(), _config(), F.lit(False), F.col("exhausted"))
    return G.seen_evidence(G.walked(asked)).withColumn("v", v).select("file_id", "family", "kind", "route", "spent", "exhausted", "v.status", "v.confidence")


#: The traces that ROUTED_SQL reads, without limits: the sinks with their symbols, and what leads to them.
WHOLE_LED = f"""WITH {WHOLE_CALLS}, reached AS (SELECT DISTINCT callee AS symbol FROM calls WHERE entry_line IS NOT NULL UNION SELECT c.callee FROM reached r JOIN (SELECT DISTINCT callee, caller FROM calls) c ON c.caller = r.symbol)
SELECT a.file_id, a.line_no, coalesce(o.entry_line, CASE WHEN r.symbol IS NOT NULL THEN 0 END) AS entry_line FROM asked a LEFT JOIN own o USING (file_id, line_no) LEFT JOIN reached r ON r.symbol = a.symbol"""


@query(with_sql("code_lines", ROUTED_SQL.replace(f"tr AS ({TRACE_SQL})", f"tr AS ({WHOLE_LED.replace('WITH ', 'WITH RECURSIVE ', 1)})")).replace("WITH ", "WITH RECURSIVE ", 1))
def v5_whole_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """`v5_routed_verdicts` with call paths through every caller, whatever the depth."""
    found = cut_lineage(_scanned(spark, d))
    return _routed(found, E.led_evidence(_evidence(found), _of(found, "sink"), E.led_sinks(code_lines(spark, d), _of(found, "entry"), _of(found, "sink"))))


@query("SELECT o_orderkey, CAST(least(120, greatest(2, CASE o_orderkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 0.1 WHEN 2 THEN 500 ELSE 45.5 END)) AS DOUBLE) AS budget FROM orders")
def v6_time_budget(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 4 == 0, "not a number").when(F.col("o_orderkey") % 4 == 1, "0.1").when(F.col("o_orderkey") % 4 == 2, "500").otherwise("45.5")
    budget = F.least(F.lit(120.0), F.greatest(F.lit(2.0), F.coalesce(raw.try_cast("double"), F.lit(20.0))))
    return read(spark, d, "orders").select("o_orderkey", budget.alias("budget"))


@query(with_sql("code_lines", f"WITH {hits_sql('config')}, c AS ({P.scan_sql(P.CATALOG['crypto'])}) SELECT file_id, line_no, kind, 'general' AS part FROM hits UNION ALL SELECT file_id, line_no, kind, 'own' FROM c"))
def v7_config_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The scan of a type's own kinds, and always the general audit."""
    general = hits(spark, d, "config").select("file_id", "line_no", "kind", F.lit("general").alias("part"))
    return general.union(hits(spark, d, "crypto").select("file_id", "line_no", "kind", F.lit("own").alias("part")))
