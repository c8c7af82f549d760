"""Queries of sources, caches, sessions and model stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.names import cache_key, extension
from auditlake.operators import boundaries as B
from auditlake.operators import models as M
from auditlake.registry import query
from auditlake.sources import stores as S
from auditlake.sources.derived import code_files, code_lines, program_lines, program_lines_sql, read, with_sql


@query(with_sql("code_files", "SELECT file_id, path FROM code_files WHERE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('en', 'fr')"))
def s4_extension_filter(spark: SparkSession, d: str) -> DataFrame:
    return code_files(spark, d).filter(extension(F.col("path")).isin("en", "fr")).select("file_id", "path")


@query(with_sql("code_files", "SELECT count(*) AS n, count(*) FILTER (path LIKE '%.de') AS valid, count(*) FILTER (path NOT LIKE '%.de') AS unsupported FROM code_files"))
def s5_valid_split(spark: SparkSession, d: str) -> DataFrame:
    ok = extension(F.col("path")) == "de"
    return code_files(spark, d).agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("unsupported"))


@query(with_sql("code_files", "SELECT path FROM code_files WHERE octet_length(encode(content)) <= 1048576 AND regexp_extract(path, '[^.]*$') IN (SELECT lang FROM documents) AND NOT list_has_any(string_split(lower(regexp_extract(path, '^(.*)/', 1)), '/'), " + str(list(S.IGNORED)) + ") ORDER BY path LIMIT 5000"))
def s6_whole_walk(spark: SparkSession, d: str) -> DataFrame:
    """With the survey's bounds; the tables' languages stand for the extensions."""
    files = code_files(spark, d)
    allowed = read(spark, d, "documents").select(F.lower("lang").alias("suffix")).distinct()
    return S.guarded_walk(files, allowed).select("path")


@query("SELECT doc_id, text = text AS same FROM documents")
def s3_s7_tolerant_read(spark: SparkSession, d: str) -> DataFrame:
    """Texts survive both readers."""
    raw = F.col("text").cast("binary")
    return read(spark, d, "documents").select("doc_id", ((S.decoded(raw) == F.col("text")) & (S.with_replacement(raw) == F.col("text"))).alias("same"))


@query("SELECT l.l_orderkey AS tag, l.n FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l WHERE l.l_orderkey IN (1, 2, 3, 7)")
def s9_type_selection(spark: SparkSession, d: str) -> DataFrame:
    tags = spark.createDataFrame([(x,) for x in (1, 2, 3, 7)], "tag long")
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("tag")).agg(F.count("*").alias("n")).join(F.broadcast(tags), "tag", "left_semi")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def s11_index_validity(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    newest = e.agg(F.max("ts").alias("m"))
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("m") - F.expr("INTERVAL 7 DAY")).select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s12_incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """Only documents that are not in the index yet."""
    return S.misses(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


KEY_SQL = "'v5_' || md5(text) || '_' || md5('scan ' || lang) || '_' || regexp_replace(source, '[^a-zA-Z0-9]', '_', 'g')"


@query(f"SELECT doc_id, {KEY_SQL} AS cache_key FROM documents")
def s14_cache_key(spark: SparkSession, d: str) -> DataFrame:
    key = cache_key(F.col("text"), F.concat(F.lit("scan "), "lang"), F.col("source"))
    return read(spark, d, "documents").select("doc_id", key.alias("cache_key"))


@query("SELECT d.doc_id, l.quality IS NOT NULL AS hit, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j3_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = S.looked_up(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return out.select("doc_id", F.col("quality").isNotNull().alias("hit"), "quality")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY AND starts_with(event_type, 'p')")
def s15_cache_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the current version that are not too old."""
    e = read(spark, d, "events")
    newest = e.agg(F.max("ts").alias("m"))
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("m") - F.expr("INTERVAL 3 DAY")).filter(F.startswith("event_type", F.lit("p"))).select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'shop' END AS project, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run, 'm1' AS model, 'json' AS format, 'f' || o_orderkey AS stem FROM orders")
def s16_report_tree(spark: SparkSession, d: str) -> DataFrame:
    project = F.when(F.col("o_orderkey") % 2 == 0, "reports/shop/").otherwise("/")
    path = F.concat(project, F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("/m1/json/f"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return read(spark, d, "orders").withColumn("r", S.run_of(path)).select("o_orderkey", "r.project", "r.run", "r.model", "r.format", "r.stem")


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS critical, 0::BIGINT AS high FROM events")
def s18_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a JSON document; absent ones are 0."""
    stats = F.from_json("props", "k long, high long")
    return read(spark, d, "events").select("event_id", F.coalesce(stats.k, F.lit(0)).alias("critical"), F.coalesce(stats.high, F.lit(0)).alias("high"))


@query("SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS role, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 100")
def l6_s21_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions, newest first, a hundred at most."""
    c = read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("role"), F.count("*").alias("n")).orderBy(F.desc("conv_id")).limit(100)


@query("SELECT conv_id, count(*) <= 6 AND bool_and(role IN ('user', 'assistant')) AND bool_and(length(text) <= 2000) AS valid FROM conversations GROUP BY conv_id")
def f17_request_validation(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(((F.count("*") <= 6) & F.bool_and(F.col("role").isin("user", "assistant")) & F.bool_and(F.length("text") <= 2000)).alias("valid"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'SUSPICIOUS' WHEN toxic = 1 THEN 'CLEAN' ELSE 'ERROR' END AS verdict FROM labels WHERE quality = 1")
def f2_verdict_filter(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("quality") == 1, " suspicious.").when(F.col("toxic") == 1, "whatever").otherwise("")
    return read(spark, d, "labels").select("doc_id", M.verdict(raw).alias("verdict")).filter("verdict = 'SUSPICIOUS'")


@query(with_sql("code_files", "SELECT file_id, CAST(16 AS BIGINT) AS dims, CAST(1 AS DOUBLE) AS norm FROM code_files"))
def u1_embedding_stage(spark: SparkSession, d: str) -> DataFrame:
    v = M.embed(code_files(spark, d).select("file_id", "content"), M.HashEmbedder(16))
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("file_id", F.size("embedding").cast("long").alias("dims"), F.round(n, 6).alias("norm"))


SINK = "(?:\\.execute(many)?\\()|(?:\\.raw\\()|(?:mysqli_query\\()"


@query(with_sql("code_lines", f"SELECT file_id, CASE WHEN bool_or(regexp_matches(rtrim(line), '{SINK}')) THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM code_lines GROUP BY file_id"))
def u2_triage_stage(spark: SparkSession, d: str) -> DataFrame:
    files = code_lines(spark, d).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("content"))
    return M.triage(files, M.PatternTriage(["sql_execute"])).select("file_id", "verdict")


@query()
def u3_deep_stage(spark: SparkSession, d: str) -> DataFrame:
    """Deep analysis with retries and repair; the stub writes a fenced, cut JSON for every third file."""
    files = code_files(spark, d).select("file_id", "content")
    return M.deep(files, M.StubDeep()).select("file_id", "attempts", "status", F.length("payload").alias("n_chars"))


LANGUAGES = [*B.STARTS, "txt"]


@query(f"WITH {program_lines_sql(LANGUAGES)}, {B.bounds_sql('program_lines')}")
def x30_function_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Functions of programs in all languages of the table and one that it has not."""
    return B.function_bounds(program_lines(spark, d, LANGUAGES))
