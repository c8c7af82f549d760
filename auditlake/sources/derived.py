"""Inputs derived from the driver's tables, each as a DataFrame and as the same DuckDB query.

`*_SQL` constants are common table expressions for the twins; `with_sql` joins those that a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literals(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- code files: documents as source files -------------------------------------------------------


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.col("text").alias("content"))


CODE_FILES = "code_files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS path, text AS content FROM documents)"

# --- code lines: orders as files, line items as their lines --------------------------------------

#: Lines of a generated program; {s} is a small number, {n} the number of a function.
TEMPLATES = [
    "def fn{n}(request):",
    '@app.route("/item/{s}")',
    "    name{s} = request.args.get('q{s}')",
    '    cursor.execute("SELECT * FROM t WHERE id = " + name{s})',
    "    return fn{n}(name{s})",
    "    os.system(cmd{s})",
    "DEBUG = True",
    "    value{s} = hashlib.md5(data{s}).hexdigest()",
    '    logger.info("password is %s", password)',
    '    api_key = "abcdef0123456789{s}{s}"',
    "    safe{s} = html.escape(name{s})",
    "@login_required",
    "    if not check_permission(user): abort(403)",
    "    cipher = DES.new(key{s})",
    "    total{s} = total{s} + {s}",
    "",
    "    with open(path{s}) as handle:",
    "    stmt = db.prepare(query{s})",
    "    validate_csrf(token)",
    "    cmd{s} = input()",
    "function fn{n}(req, res) {",
    "    fn{n}(value{s});",
    '    logging.debug("card number: %s", card)',
    "    verify = False",
    "    jwt.decode(token, key)",
    "    x{s} = y{s} ? 1 : 0",
]


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, line_no, line"""
    li = read(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    line = F.element_at(literals(TEMPLATES), (F.col("l_partkey") % len(TEMPLATES) + 1).cast("int"))
    line = F.replace(F.replace(line, F.lit("{s}"), (F.col("l_suppkey") % 3).cast("string")), F.lit("{n}"), (F.col("l_suppkey") % 37).cast("string"))
    return li.select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("src/m"), F.col("l_orderkey") % 10, F.lit("/f"), "l_orderkey", F.lit(".py")).alias("path"), F.row_number().over(order).cast("long").alias("line_no"), line.alias("line"))


CODE_LINES = f"""code_lines AS (
  SELECT l_orderkey AS file_id, 'src/m' || (l_orderkey % 10) || '/f' || l_orderkey || '.py' AS path,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS line_no,
         replace(replace(list_extract({sql_list(TEMPLATES)}, CAST(l_partkey % {len(TEMPLATES)} + 1 AS INT)), '{{s}}', CAST(l_suppkey % 3 AS VARCHAR)), '{{n}}', CAST(l_suppkey % 37 AS VARCHAR)) AS line
  FROM lineitem)"""

# --- programs: suppliers as files of many lines, in every language of the boundary table ---------

#: Lines with blocks, strings and comments that hold braces, and starts of functions; {s} is a small number.
PROGRAM = [
    "function f{s}(a) {",
    "def g{s}(x):",
    "public static int h{s}(int a) {",
    "    return a + {s};",
    "}",
    "  }",
    "func k{s}(a int) {",
    '  text = "{ not a block }";',
    "  // } a comment {",
    "  # } another {",
    "/* a block { comment",
    "   goes on } here */ x = 1;",
    "  if (x) { y = {s}; } else {",
    "int m{s}(char *p) { return 0; }",
    "    def inner{s}(self):",
    "        pass",
    "",
    "  fun p{s}(x: Int) = x",
    "f{s}() {",
    "end",
    "x{s} = 'it\\'s { quoted'",
    "sub q{s} {",
    "} else {",
    "let r{s} = 1",
]


def program_lines(spark: SparkSession, sf_dir: str, languages: list[str]) -> DataFrame:
    """file_id, lang, line_no, line"""
    li = read(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    line = F.replace(F.element_at(literals(PROGRAM), ((F.col("l_partkey") + F.col("l_orderkey")) % len(PROGRAM) + 1).cast("int")), F.lit("{s}"), (F.col("l_partkey") % 5).cast("string"))
    return li.select(F.col("l_suppkey").alias("file_id"), F.element_at(literals(languages), (F.col("l_suppkey") % len(languages) + 1).cast("int")).alias("lang"), F.row_number().over(order).cast("long").alias("line_no"), line.alias("line"))


def program_lines_sql(languages: list[str]) -> str:
    return f"""program_lines AS (
  SELECT l_suppkey AS file_id, list_extract({sql_list(languages)}, CAST(l_suppkey % {len(languages)} + 1 AS INT)) AS lang,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS line_no,
         replace(list_extract({sql_list(PROGRAM)}, CAST((l_partkey + l_orderkey) % {len(PROGRAM)} + 1 AS INT)), '{{s}}', CAST(l_partkey % 5 AS VARCHAR)) AS line
  FROM lineitem)"""


# --- vectors ------------------------------------------------------------------------------------

N_TYPES = 8


def file_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def type_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_vectors(spark, sf_dir).filter(F.col("file_id") < N_TYPES).select(F.col("file_id").alias("type_id"), "v")


FILE_VECTORS = "file_vectors AS (SELECT vec_id AS file_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"
TYPE_VECTORS = f"type_vectors AS (SELECT file_id AS type_id, v FROM file_vectors WHERE file_id < {N_TYPES})"
SCORES = """scores AS (
  SELECT type_id, file_id, label, list_sum(list_transform(list_zip(t.v, f.v), lambda p: p[1] * p[2]))
         / (sqrt(list_sum(list_transform(t.v, lambda p: p * p))) * sqrt(list_sum(list_transform(f.v, lambda p: p * p)))) AS score
  FROM type_vectors t, file_vectors f)"""

# --- report documents ---------------------------------------------------------------------------

SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]


def severity(quantity: str) -> Column:
    q = F.col(quantity)
    return F.when(q > 45, "Critical").when(q > 35, "High").when(q > 20, "Medium").when(q > 5, "Low").otherwise("Info")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a finding: report_id, file_path, score, error, chunk, severity, title."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        (F.col("o_custkey") % 50).alias("report_id"),
        F.concat(F.lit("src/f"), "o_orderkey", F.lit(".py")).alias("file_path"),
        # Rounded as the twin rounds, in doubles: F.round to six places goes by the decimal text, and halves differ.
        (F.round(F.col("o_totalprice") / 600000 * 1000000) / 1000000).alias("score"),
        F.when(F.col("o_orderstatus") == "P", F.lit("unreadable")).alias("error"),
        (F.col("l_linenumber") % 3).cast("long").alias("chunk"),
        severity("l_quantity").alias("severity"),
        F.concat(F.lit("finding "), F.col("l_partkey").cast("string")).alias("title"),
        F.col("l_suppkey").alias("line"),
    )


FINDINGS = """findings AS (
  SELECT o_custkey % 50 AS report_id, 'src/f' || o_orderkey || '.py' AS file_path, round(o_totalprice / 600000, 6) AS score,
         CASE WHEN o_orderstatus = 'P' THEN 'unreadable' END AS error, CAST(l_linenumber % 3 AS BIGINT) AS chunk,
         CASE WHEN l_quantity > 45 THEN 'Critical' WHEN l_quantity > 35 THEN 'High' WHEN l_quantity > 20 THEN 'Medium' WHEN l_quantity > 5 THEN 'Low' ELSE 'Info' END AS severity,
         'finding ' || l_partkey AS title, l_suppkey AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested: report_id, file_path, similarity_score, error, chunk_analyses of findings."""
    f = findings(spark, sf_dir)
    chunks = f.groupBy("report_id", "file_path", "score", "error", "chunk").agg(F.sort_array(F.collect_list(F.struct("severity", "title", "line"))).alias("findings"))
    return chunks.groupBy("report_id", "file_path", F.col("score").alias("similarity_score"), "error").agg(F.sort_array(F.collect_list(F.struct("chunk", "findings"))).alias("chunk_analyses"))


# --- report index -------------------------------------------------------------------------------

FORMATS = ["json", "html", "md", "pdf", "sarif"]


def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    kind = F.when(F.col("o_orderkey") % 11 == 0, "Executive Summary").otherwise(F.col("o_orderpriority"))
    fmt = F.element_at(literals(FORMATS), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return j.select(
        F.col("o_orderkey").alias("report_key"),
        F.floor(F.col("o_orderkey") / 5).cast("long").alias("stem"),
        F.col("c_mktsegment").alias("model"),
        fmt.alias("format"),
        kind.alias("vulnerability_type"),
        F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.lower(F.substring("r_name", 1, 2))).alias("language"),
        F.col("n_name").alias("project"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
        (F.col("o_orderkey") % 3).cast("long").alias("critical"),
        (F.col("o_custkey") % 4).cast("long").alias("high"),
        (F.col("o_orderkey") % 7).cast("long").alias("medium"),
        (F.col("o_custkey") % 2).cast("long").alias("low"),
    )


REPORT_INDEX = f"""report_index AS (
  SELECT o_orderkey AS report_key, CAST(floor(o_orderkey / 5) AS BIGINT) AS stem, c_mktsegment AS model,
         list_extract({sql_list(FORMATS)}, CAST(o_orderkey % 5 + 1 AS INT)) AS format,
         CASE WHEN o_orderkey % 11 = 0 THEN 'Executive Summary' ELSE o_orderpriority END AS vulnerability_type,
         CASE WHEN o_orderkey % 13 <> 0 THEN lower(substr(r_name, 1, 2)) END AS language, n_name AS project, CAST(o_orderdate AS TIMESTAMP) AS date,
         CAST(o_orderkey % 3 AS BIGINT) AS critical, CAST(o_custkey % 4 AS BIGINT) AS high, CAST(o_orderkey % 7 AS BIGINT) AS medium, CAST(o_custkey % 2 AS BIGINT) AS low
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

# --- report artifacts: documents as files of a report tree -----------------------------------------

STEMS = ["sql_injection", "path_traversal", "weak_hashing", "executive_summary", "audit_report"]
TREE_FORMATS = ["json", "md", "html", "sarif"]


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: four documents a stem, one a format; some JSON is cut, some are progress sidecars. Runs are in three layouts."""
    n = F.col("g")
    at = lambda xs, i: F.element_at(literals(xs), (i % len(xs) + 1).cast("int"))
    stamp = F.expr("date_format(timestampadd(SECOND, (g div 256) % 3000 * 86400 + (g div 768000) % 86400, TIMESTAMP_NTZ'2020-01-01 00:00:00'), 'yyyyMMdd_HHmmss')")
    team = (n % 5).cast("string")
    run = F.when(n % 3 == 0, F.concat(F.lit("shop"), team, F.lit("_"), stamp)).when(n % 3 == 1, stamp).otherwise(F.concat(F.lit("team"), team, F.lit("/"), stamp))
    sidecar = F.when((n % 9 == 0) & (F.col("format") == "json"), ".progress").otherwise("")
    path = F.concat(run, F.lit("/model-"), (n % 4).cast("string"), F.lit("/"), "format", F.lit("/"), at(STEMS, n), F.lit("_"), n.cast("string"), sidecar, F.lit("."), "format")
    project = F.when(n % 7 != 0, F.concat(F.lit(',"project":"app'), (n % 11).cast("string"), F.lit('"'))).otherwise("")
    body = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in ('{"stats":{"critical":', n % 3, ',"high":"', n % 4, '","low":', n % 10, '},"language":"', F.coalesce("lang", F.lit("")), '"', project, ',"progress":{"completed":', n % 6, ',"total":6}')))
    content = F.when(F.col("format") != "json", F.coalesce("text", F.lit(""))).otherwise(F.concat(body, F.when(n % 13 != 0, "}").otherwise("")))
    d = read(spark, sf_dir, "documents").withColumns({"g": F.expr("doc_id div 4"), "format": at(TREE_FORMATS, F.col("doc_id"))})
    return d.select(path.alias("path"), content.alias("content"))


ARTIFACTS = f"""artifact_rows AS (
  SELECT doc_id // 4 AS g, text, lang, list_extract({sql_list(TREE_FORMATS)}, CAST(doc_id % 4 + 1 AS INT)) AS format,
         strftime(TIMESTAMP '2020-01-01' + to_seconds((doc_id // 4 // 256) % 3000 * 86400 + (doc_id // 4 // 768000) % 86400), '%Y%m%d_%H%M%S') AS stamp FROM documents),
artifacts AS (
  SELECT *, run_key || '/' || model || '/' || format || '/' || stem || CASE WHEN sidecar THEN '.progress.' ELSE '.' END || format AS path FROM (
    SELECT g, format, stamp, 'model-' || (g % 4) AS model, list_extract({sql_list(STEMS)}, CAST(g % 5 + 1 AS INT)) || '_' || g AS stem, format = 'json' AND g % 9 = 0 AS sidecar,
           CASE g % 3 WHEN 0 THEN 'shop' || (g % 5) WHEN 2 THEN 'team' || (g % 5) END AS folder,
           CASE g % 3 WHEN 0 THEN 'shop' || (g % 5) || '_' || stamp WHEN 1 THEN stamp ELSE 'team' || (g % 5) || '/' || stamp END AS run_key,
           CASE WHEN format <> 'json' THEN coalesce(text, '') ELSE '{{"stats":{{"critical":' || (g % 3) || ',"high":"' || (g % 4) || '","low":' || (g % 10) || '}},"language":"' || coalesce(lang, '') || '"'
             || CASE WHEN g % 7 <> 0 THEN ',"project":"app' || (g % 11) || '"' ELSE '' END || ',"progress":{{"completed":' || (g % 6) || ',"total":6}}' || CASE WHEN g % 13 <> 0 THEN '}}' ELSE '' END END AS content
    FROM artifact_rows))"""

# --- progress -----------------------------------------------------------------------------------


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("completed"), "value")


PROGRESS = "progress AS (SELECT event_id, user_id AS run_id, ts AS updated_at, event_type AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS completed, value FROM events)"

CTES = {"code_files": CODE_FILES, "code_lines": CODE_LINES, "file_vectors": FILE_VECTORS, "type_vectors": TYPE_VECTORS, "scores": SCORES, "findings": FINDINGS, "report_index": REPORT_INDEX, "progress": PROGRESS, "artifacts": ARTIFACTS}
_NEEDS = {"scores": ("file_vectors", "type_vectors"), "type_vectors": ("file_vectors",)}


def with_sql(names: str, body: str) -> str:
    """A DuckDB query over derived inputs; `body` may start with more common table expressions."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in (*_NEEDS.get(name, ()), name) if x not in wanted]
    body = body.strip()
    more = body[4:].strip() if body.upper().startswith("WITH ") else None
    head = "WITH " + ",\n".join(CTES[x] for x in wanted)
    return f"{head},\n{more}" if more else f"{head}\n{body}"
