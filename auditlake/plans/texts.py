"""Queries over texts: lines, chunks, windows, spans, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.operators import text as T
from auditlake.registry import query
from auditlake.sources.derived import code_files, read, with_sql


@query(with_sql("code_files", "SELECT file_id, count(*) AS n_lines, sum(length(line)) AS n_chars FROM (SELECT file_id, unnest(string_split(CASE WHEN ends_with(content, chr(10)) THEN content[:-2] ELSE content END, chr(10))) AS line FROM code_files) GROUP BY file_id"))
def p2_line_explode(spark: SparkSession, d: str) -> DataFrame:
    return T.exploded(code_files(spark, d)).groupBy("file_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


PACK_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text <> ''
), n AS (SELECT doc_id, i, length(line) + 1 AS cost FROM l),
f AS (
  SELECT doc_id, i, cost, 1 AS chunk, CASE WHEN cost > 2048 THEN 0 ELSE cost END AS size, cost > 2048 AS long FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, n.cost,
         f.chunk + CASE WHEN n.cost > 2048 OR f.long OR f.size + n.cost > 2048 THEN 1 ELSE 0 END,
         CASE WHEN n.cost > 2048 THEN 0 WHEN f.long OR f.size + n.cost > 2048 THEN n.cost ELSE f.size + n.cost END, n.cost > 2048
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1
), c AS (SELECT doc_id, chunk, min(i) AS a, max(i) AS b, bool_or(long) AS long, sum(cost) - 1 AS chars FROM f GROUP BY doc_id, chunk),
p AS (SELECT doc_id, a, b, least(2048, chars - 2048 * k) AS chars FROM (SELECT *, unnest(range(0, CAST(CASE WHEN long THEN ceil(chars / 2048.0) ELSE 1 END AS BIGINT))) AS k FROM c))
SELECT doc_id, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, CAST(chars AS INT) AS n_chars FROM p
"""


@query(PACK_SQL)
def w3_line_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return T.chunks(docs, "doc_id", "text").select("doc_id", "start_line", "end_line", F.length("text").alias("n_chars"))


GROWN_SQL = """
WITH l AS (SELECT file_id, CASE WHEN content = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(CASE WHEN ends_with(content, chr(10)) THEN content[:-2] ELSE content END, chr(10)) END AS lines FROM code_files WHERE content IS NOT NULL),
n AS (SELECT *, least(3, len(lines)) AS mid, greatest(1, least(3, len(lines)) - 40) AS lo, least(len(lines), least(3, len(lines)) + 40) AS hi FROM l),
k AS (SELECT *, unnest(range(0, greatest(mid - lo, hi - mid, 0) + 1)) AS k FROM n),
g AS (SELECT file_id, max(k) AS best FROM k WHERE length(array_to_string(list_slice(lines, greatest(lo, mid - k), least(hi, mid + k)), chr(10))) <= 600 GROUP BY file_id),
w AS (SELECT n.*, CASE WHEN best IS NULL THEN mid ELSE greatest(lo, mid - best) END AS a, CASE WHEN best IS NULL THEN mid ELSE least(hi, mid + best) END AS b FROM n LEFT JOIN g USING (file_id))
SELECT file_id, CAST(CASE WHEN len(lines) = 0 THEN 0 ELSE a END AS INT) AS start_line, CAST(CASE WHEN len(lines) = 0 THEN 0 ELSE b END AS INT) AS end_line, CASE WHEN len(lines) = 0 THEN 0 ELSE least(600, length(array_to_string(list_slice(lines, a, b), chr(10)))) END AS n_chars FROM w
"""


@query(with_sql("code_files", GROWN_SQL))
def w4_window_growth_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The same window for every file: about its last line where it has fewer than three, empty where it has none."""
    files = code_files(spark, d).filter("content is not null").select("file_id", T.lines_of(F.col("content")).alias("lines"))
    at = F.least(F.lit(3), F.size("lines"))
    return files.select("file_id", T.expanded(F.col("lines"), at, at, 40, 40, 600).alias("w")).select("file_id", "w.start_line", "w.end_line", F.length("w.text").alias("n_chars"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS slice FROM documents")
def f16_line_slice(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n").alias("slice"))


SPAN_SQL = """
WITH n AS (SELECT doc_id, text, trim(substr(text, greatest(1, CAST(length(text) // 2 AS BIGINT)), 30)) AS c FROM documents),
s AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 1 THEN c || chr(10) || '~changed' ELSE c END AS s FROM n),
f AS (SELECT *, trim(string_split(trim(s), chr(10))[1]) AS first FROM s),
p AS (SELECT *, CASE WHEN length(trim(s)) = 0 THEN NULL WHEN contains(text, s) THEN s WHEN length(first) >= 8 AND contains(text, first) THEN first END AS piece FROM f),
b AS (SELECT *, left(text, instr(text, piece) - 1) AS before FROM p)
SELECT doc_id, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) AS start_line, CAST(length(before) - length(replace(before, chr(10), '')) + 1 + length(piece) - length(replace(piece, chr(10), '')) AS INT) AS end_line FROM b
"""


@query(SPAN_SQL)
def x12_line_span_of_all(spark: SparkSession, d: str) -> DataFrame:
    """A snippet of every text; every second one has a line that the text lacks, so its first line is looked for."""
    piece = F.trim(F.substr("text", F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int")), F.lit(30)))
    needle = F.when(F.col("doc_id") % 2 == 1, F.concat(piece, F.lit("\n~changed"))).otherwise(piece)
    return read(spark, d, "documents").select("doc_id", T.line_span(F.col("text"), needle).alias("s")).select("doc_id", "s.start_line", "s.end_line")


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 299) || '…' END AS short FROM documents")
def x23_truncation(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 300).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN contains(left(text, 400), chr(10) || chr(10)) THEN left(text, 400 - instr(reverse(left(text, 400)), chr(10) || chr(10)) - 1) WHEN contains(left(text, 400), chr(10)) THEN left(text, 400 - instr(reverse(left(text, 400)), chr(10))) ELSE left(text, 400) END AS head FROM documents")
def x24_safe_cut_of_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.safe_cut(F.col("text"), 400).alias("head"))


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), lower(b.text)))")
def p16_uncovered_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases that no text holds. The phrases, a small catalog of checked size, meet every text once."""
    phrases = read(spark, d, "benchmark").select("item_id", F.lower("text").alias("phrase"))
    small = phrases.limit(10_001).count() <= 10_000
    docs = read(spark, d, "documents").select(F.lower("text").alias("text"))
    found = docs.join(F.broadcast(phrases) if small else phrases, F.contains("text", F.col("phrase"))).select("item_id").distinct()
    return phrases.join(found, "item_id", "left_anti").select("item_id")


@query("WITH f AS (SELECT doc_id, source, length(text) AS n FROM documents) SELECT source, CAST(sum(n) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_files FROM f GROUP BY source")
def s13_index_info(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("n_files"))


#: Characters that one source's files share.
BUDGET = 200_000

SHARED_SQL = f"""
WITH RECURSIVE f AS (SELECT source, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id, coalesce(length(text), 0)) AS i, count(*) OVER (PARTITION BY source) AS files FROM documents),
r AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS i, files, CAST({BUDGET} AS BIGINT) AS left_over FROM f
  UNION ALL
  SELECT r.source, f.i, r.files, r.left_over - least(f.n, r.left_over // (r.files - r.i)) FROM r JOIN f ON f.source IS NOT DISTINCT FROM r.source AND f.i = r.i + 1
)
SELECT source, CAST({BUDGET} - left_over AS BIGINT) AS n_given FROM r WHERE i = files
"""


@query(SHARED_SQL)
def w5_running_budget(spark: SparkSession, d: str) -> DataFrame:
    """A budget of characters, split evenly over the files not yet served, in order; what a file leaves goes on.
    Shares never shrink, and as long as more files than characters are left a share is none: so only the last
    BUDGET files of a source can be given any, and the fold reads those and no more, however many there are."""
    files = read(spark, d, "documents").select("source", "doc_id", F.shiftright("doc_id", 16).alias("bin"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    after = F.sum("files").over(W.partitionBy("source").orderBy(F.desc("bin"))) - F.col("files")
    bins = files.groupBy("source", "bin").agg(F.count("*").alias("files")).withColumn("after", after).filter(F.col("after") < BUDGET)
    start = bins.groupBy(F.col("source").alias("s")).agg(F.min("bin").alias("from_bin"))
    served = files.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") >= F.col("from_bin")))
    sizes = served.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n"))).alias("f"))
    zero = F.struct(F.lit(BUDGET).alias("left"), F.size("f").alias("files"), F.lit(0).alias("given"))
    step = lambda s, x: F.struct((s.left - F.least(x.n, F.floor(s.left / s.files).cast("int"))).alias("left"), (s.files - 1).alias("files"), (s.given + F.least(x.n, F.floor(s.left / s.files).cast("int"))).alias("given"))
    return sizes.select("source", F.aggregate("f", zero, step, lambda s: s.given).cast("long").alias("n_given"))
