"""Queries: similarity, pooling, histograms, audits, tiers, top lists, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import vectors as V
from auditlake.registry import query
from auditlake.sources.derived import file_vectors, type_vectors, with_sql


def scores(spark: SparkSession, d: str) -> DataFrame:
    return V.similarity_join(file_vectors(spark, d), type_vectors(spark, d))


@query(with_sql("scores", "SELECT type_id, file_id, round(score, 6) AS score FROM scores WHERE score >= 0.123456"))
def j1_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    return V.similarity_join(file_vectors(spark, d), type_vectors(spark, d), 0.123456).select("type_id", "file_id", F.round("score", 6).alias("score"))


@query(with_sql("scores", "SELECT type_id, count(*) AS n FROM scores WHERE score >= 0.5000001 GROUP BY type_id"))
def f1_similarity_threshold(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).filter(F.col("score") >= 0.5000001).groupBy("type_id").agg(F.count("*").alias("n"))


CUTS = "(VALUES (-0.2), (-0.1), (0.0), (0.1), (0.2), (0.3), (0.4)) c(cut_off)"


@query(with_sql("scores", f"SELECT type_id, CAST(cut_off AS DOUBLE) AS cut_off, count(*) FILTER (score >= cut_off) AS n_at_least, round(count(*) FILTER (score >= cut_off) * 100.0 / count(*), 4) AS percent FROM scores, {CUTS} GROUP BY type_id, cut_off"))
def a3_threshold_histogram(spark: SparkSession, d: str) -> DataFrame:
    return V.threshold_histogram(scores(spark, d), ["type_id"])


@query(with_sql("scores", "SELECT type_id, count(*) AS n, round(avg(score), 6) AS avg_score, round(list_sort(list(score))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS median_upper, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score FROM scores GROUP BY type_id"))
def a4_score_statistics(spark: SparkSession, d: str) -> DataFrame:
    return V.score_statistics(scores(spark, d), ["type_id"])


BANDED = "count(*) AS n, count(*) FILTER (score >= 0.25) AS high, count(*) FILTER (score >= 0.15 AND score < 0.25) AS medium, count(*) FILTER (score >= 0.05 AND score < 0.15) AS low"


@query(with_sql("scores", f"SELECT CAST(type_id AS VARCHAR) AS name, {BANDED}, FALSE AS is_total FROM scores GROUP BY type_id UNION ALL SELECT 'TOTAL', {BANDED}, TRUE FROM scores"))
def a5_banded_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.banded_counts(scores(spark, d), "type_id")


@query(with_sql("scores", "SELECT count(*) AS n, round(avg(score), 6) AS avg_score, round(median(score), 6) AS median, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM scores"))
def a6_audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    return V.audit_metrics(scores(spark, d))


@query(with_sql("file_vectors", "WITH e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM file_vectors), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i) SELECT label, CAST(i AS INT) AS dim, round(x, 6) AS mean FROM m"))
def a1_vector_pooling(spark: SparkSession, d: str) -> DataFrame:
    p = V.pooled(file_vectors(spark, d), "label")
    return p.select("label", F.posexplode("v").alias("i", "x")).select("label", (F.col("i") + 1).alias("dim"), F.round("x", 6).alias("mean"))


@query(with_sql("scores", "SELECT type_id, label, round(max(score), 6) AS score FROM scores GROUP BY type_id, label"))
def a2_max_over_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of a label are the chunks of one file."""
    return scores(spark, d).groupBy("type_id", "label").agg(F.round(F.max("score"), 6).alias("score"))


TIER_SQL = "CASE WHEN greatest(0, least(1, score * 2)) >= 0.8 THEN 'strong' WHEN greatest(0, least(1, score * 2)) >= 0.6 THEN 'moderate' ELSE 'weak' END"


@query(with_sql("scores", f"SELECT {TIER_SQL} AS tier, count(*) AS n FROM scores GROUP BY 1"))
def f13_tier_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Scores are doubled, so that all tiers have rows."""
    return scores(spark, d).withColumn("tier", V.tier(F.col("score") * 2)).groupBy("tier").agg(F.count("*").alias("n"))


@query(with_sql("scores", f"WITH r AS (SELECT *, {TIER_SQL} AS tier, round(score, 4) AS s4 FROM scores), k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY s4 DESC, type_id, file_id) AS rank FROM r) SELECT tier, type_id, file_id, s4 AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 25"))
def w1_top_per_tier(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).withColumn("tier", V.tier(F.col("score") * 2)).withColumn("score", F.round("score", 4))
    return V.top_per_group(s, ["tier"], [F.desc("score"), F.asc("type_id"), F.asc("file_id")], 25).select("tier", "type_id", "file_id", "score", "rank")


@query(with_sql("scores", "SELECT type_id, file_id, round(score, 6) AS score FROM scores ORDER BY round(score, 6) DESC, type_id, file_id"))
def l1_whole_score_order(spark: SparkSession, d: str) -> DataFrame:
    """All scores of all types."""
    return scores(spark, d).select("type_id", "file_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "type_id", "file_id")


@query(with_sql("scores", "SELECT file_id, round(max(score), 6) AS score FROM scores GROUP BY file_id ORDER BY 2 DESC, 1 LIMIT 5"))
def l2_top_five(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("file_id").agg(F.round(F.max("score"), 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(5)


@query(with_sql("scores", "WITH k AS (SELECT file_id, round(score, 6) AS score FROM scores WHERE type_id = 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT k.file_id, k.score, substr(text, 1, 200) AS snippet FROM k JOIN documents ON doc_id = k.file_id"))
def l3_retrieval_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest files and the start of each, at most 200 characters a file."""
    k = scores(spark, d).filter("type_id = 1").select("file_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(5)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return F.broadcast(k).join(docs, F.col("doc_id") == F.col("file_id")).select("file_id", "score", F.substring("text", 1, 200).alias("snippet"))


@query(with_sql("scores", f"SELECT (SELECT count(DISTINCT type_id) FROM scores WHERE score > 0.2) AS n_types, count(*) AS n_rows, count(DISTINCT file_id) AS n_files, count(*) FILTER ({TIER_SQL} = 'strong') AS strong, count(*) FILTER ({TIER_SQL} = 'moderate') AS moderate, count(*) FILTER ({TIER_SQL} = 'weak') AS weak FROM scores WHERE score > 0.2"))
def a11_executive_overview(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).filter("score > 0.2").withColumn("tier", V.tier(F.col("score") * 2))
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in ("strong", "moderate", "weak")]
    return s.agg(F.countDistinct("type_id").alias("n_types"), F.count("*").alias("n_rows"), F.countDistinct("file_id").alias("n_files"), *tiers)


@query(with_sql("scores", "SELECT type_id, count(*) AS n_files, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id) AS files FROM scores WHERE score > 0.3 GROUP BY type_id"))
def a14_files_by_type(spark: SparkSession, d: str) -> DataFrame:
    found = scores(spark, d).filter("score > 0.3").groupBy("type_id").agg(F.array_sort(F.collect_list("file_id")).alias("f"))
    return found.select("type_id", F.size("f").cast("long").alias("n_files"), F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("files"))


@query(with_sql("scores", "SELECT type_id, CAST(file_id // 1000 AS BIGINT) AS part, count(*) AS n_files, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id) AS files FROM scores WHERE score > 0.3 GROUP BY 1, 2"))
def a14_files_by_type_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same lists in parts of a thousand ids, so that no type has to fit one row or one task."""
    found = scores(spark, d).filter("score > 0.3").groupBy("type_id", F.floor(F.col("file_id") / 1000).alias("part")).agg(F.array_sort(F.collect_list("file_id")).alias("f"))
    return found.select("type_id", "part", F.size("f").cast("long").alias("n_files"), F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("files"))


@query(with_sql("scores", "SELECT greatest(count(DISTINCT type_id), 1) AS n_types FROM scores WHERE score > 0.99"))
def a15_type_total(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).filter("score > 0.99").agg(F.greatest(F.countDistinct("type_id"), F.lit(1)).alias("n_types"))


SPOILED_SQL = "CASE WHEN file_id % 10 = 1 THEN list_transform(v, lambda x: x * 0) WHEN file_id % 10 = 2 THEN v[1:8] WHEN file_id % 10 = 3 THEN NULL ELSE v END"


@query(with_sql("file_vectors", f"WITH s AS (SELECT file_id, {SPOILED_SQL} AS v FROM file_vectors) SELECT count(*) AS candidates, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v IS NOT NULL AND list_sum(list_transform(v, lambda x: x * x)) = 0) AS unusable, count(*) FILTER (len(v) <> 64 AND list_sum(list_transform(v, lambda x: x * x)) > 0) AS other_size, count(*) FILTER (len(v) = 64 AND list_sum(list_transform(v, lambda x: x * x)) > 0) AS scored FROM s"))
def a16_retrieval_counters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    spoiled = F.when(F.col("file_id") % 10 == 1, F.transform(v, lambda x: x * 0)).when(F.col("file_id") % 10 == 2, F.slice(v, 1, 8)).when(F.col("file_id") % 10 == 3, None).otherwise(v)
    s = file_vectors(spark, d).select("file_id", spoiled.alias("v"))
    good = V.usable(v)
    return s.agg(F.count("*").alias("candidates"), F.count_if(v.isNull()).alias("missing"), F.count_if(v.isNotNull() & ~good).alias("unusable"), F.count_if(good & (F.size(v) != 64)).alias("other_size"), F.count_if(good & (F.size(v) == 64)).alias("scored"))


@query(with_sql("file_vectors", "SELECT a.file_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda p: p * p))) * sqrt(list_sum(list_transform(b.v, lambda p: p * p)))), 6) AS score FROM file_vectors a JOIN file_vectors b ON b.file_id = a.file_id + 1"))
def x1_cosine(spark: SparkSession, d: str) -> DataFrame:
    a, b = file_vectors(spark, d), file_vectors(spark, d).select((F.col("file_id") - 1).alias("file_id"), F.col("v").alias("w"))
    return a.join(b, "file_id").select("file_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("score"))


@query(with_sql("file_vectors", f"WITH s AS (SELECT file_id, {SPOILED_SQL} AS v FROM file_vectors) SELECT file_id, v IS NOT NULL AND list_sum(list_transform(v, lambda x: x * x)) > 0 AS usable FROM s"))
def x2_guarded_vector(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    spoiled = F.when(F.col("file_id") % 10 == 1, F.transform(v, lambda x: x * 0)).when(F.col("file_id") % 10 == 2, F.slice(v, 1, 8)).when(F.col("file_id") % 10 == 3, None).otherwise(v)
    return file_vectors(spark, d).select("file_id", V.usable(spoiled).alias("usable"))


@query(with_sql("scores", "SELECT s.type_id, s.file_id FROM scores s WHERE s.score > 0.2 AND EXISTS (SELECT 1 FROM documents WHERE doc_id = s.file_id AND lang = 'en')"))
def j2_semi_join_index(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").select(F.col("doc_id").alias("file_id"))
    return scores(spark, d).filter("score > 0.2").join(docs, "file_id", "left_semi").select("type_id", "file_id")
