"""Queries of progress tracking, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import progress as G
from auditlake.registry import query
from auditlake.sources.derived import progress_events, with_sql
from auditlake.streaming import monitor as M

LATEST = "SELECT run_id, max_by(event_id, (updated_at, event_id)) AS event_id, max_by(status, (updated_at, event_id)) AS status, max_by(completed, (updated_at, event_id)) AS completed FROM {src} GROUP BY run_id"


@query(with_sql("progress", f"WITH a AS ({LATEST.format(src='(SELECT * FROM progress WHERE event_id % 2 = 0)')}), b AS ({LATEST.format(src='(SELECT * FROM progress WHERE event_id % 2 = 1)')}), s AS (SELECT a.*, p.updated_at FROM a JOIN progress p USING (event_id)), e AS (SELECT b.*, p.updated_at FROM b JOIN progress p USING (event_id)) SELECT run_id, CASE WHEN s.run_id IS NULL OR e.updated_at > s.updated_at THEN e.status ELSE s.status END AS status, CASE WHEN s.run_id IS NULL OR e.updated_at > s.updated_at THEN e.completed ELSE s.completed END AS completed, s.run_id IS NULL OR coalesce(e.updated_at > s.updated_at, FALSE) AS from_embedded FROM s FULL JOIN e USING (run_id)"))
def j11_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    p = progress_events(spark, d)
    m = G.newest_wins(G.latest(p.filter("event_id % 2 = 0")), G.latest(p.filter("event_id % 2 = 1")))
    return m.select("run_id", "status", "completed", "from_embedded")


@query(with_sql("progress", LATEST.format(src="progress")))
def t3_latest_progress(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(progress_events(spark, d)).select("run_id", "event_id", "status", "completed")


@query(with_sql("progress", "SELECT run_id, event_id, status FROM (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY updated_at, event_id) AS p FROM progress) WHERE status IS DISTINCT FROM p"))
def w7_change_only(spark: SparkSession, d: str) -> DataFrame:
    return G.changes(progress_events(spark, d), "run_id", ["status"]).select("run_id", "event_id", "status")


@query(with_sql("progress", "SELECT run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, slot ORDER BY updated_at, event_id) = 1 AS first FROM (SELECT *, floor((epoch_us(updated_at) - min(epoch_us(updated_at)) OVER (PARTITION BY run_id)) / 86400000000.0) AS slot, lead(event_id) OVER (PARTITION BY run_id ORDER BY updated_at, event_id) IS NULL AS last FROM progress)) WHERE first OR last"))
def w8_throttled(spark: SparkSession, d: str) -> DataFrame:
    return G.throttled(progress_events(spark, d), "run_id", 86_400).select("run_id", "event_id")


@query(with_sql("progress", "SELECT event_id, CASE WHEN status = 'error' THEN 'running' ELSE status END AS status, greatest(coalesce(completed, 0), 0) AS completed, greatest(50, coalesce(completed, 0)) AS total, greatest(coalesce(completed, 0), 0) < greatest(50, coalesce(completed, 0)) AS is_partial FROM progress"))
def t4_progress_contract(spark: SparkSession, d: str) -> DataFrame:
    p = progress_events(spark, d)
    return p.withColumn("c", G.contract(F.col("status"), F.col("completed"), F.lit(50).cast("long"))).select("event_id", "c.status", "c.completed", "c.total", "c.is_partial")


#: Stages of the pipeline. Fixed values.
PHASES = ["discover", "scan", "expand", "deep", "verify", "report"]


@query(with_sql("progress", "WITH l AS (" + LATEST.format(src="progress") + "), p AS (SELECT *, unnest(range(6)) AS i FROM l) SELECT run_id, ['discover', 'scan', 'expand', 'deep', 'verify', 'report'][i + 1] AS phase, CASE WHEN i < coalesce(completed, 0) % 6 THEN 'done' WHEN i = coalesce(completed, 0) % 6 THEN 'running' ELSE 'pending' END AS status FROM p"))
def t5_phase_rows(spark: SparkSession, d: str) -> DataFrame:
    at = F.coalesce("completed", F.lit(0)) % len(PHASES)
    rows = [F.struct(F.lit(p).alias("phase"), F.when(F.lit(i) < at, "done").when(F.lit(i) == at, "running").otherwise("pending").alias("status")) for i, p in enumerate(PHASES)]
    return G.latest(progress_events(spark, d)).select("run_id", F.explode(F.array(*rows)).alias("p")).select("run_id", "p.phase", "p.status")


@query(with_sql("progress", "WITH l AS (" + LATEST.format(src="progress") + ") SELECT run_id, CASE WHEN status = 'purchase' THEN status ELSE 'aborted' END AS status FROM l"))
def t6_aborted_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(progress_events(spark, d)).select("run_id", F.when(F.col("status") == "purchase", F.col("status")).otherwise("aborted").alias("status"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return M.progress_stream(M.poll(spark, d, "events*.parquet"))


@query(with_sql("progress", LATEST.format(src="progress")))
def t1_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    return M.run_to_end(spark, M.latest_progress(_stream(spark, d)), "complete").select("run_id", "event_id", "status", "completed")


@query(with_sql("progress", "SELECT run_id, event_id, status FROM (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY updated_at, event_id) AS p FROM progress) WHERE status IS DISTINCT FROM p"))
def t2_stream_changes(spark: SparkSession, d: str) -> DataFrame:
    return M.run_to_end(spark, M.changed_status(_stream(spark, d)), "append").select("run_id", "event_id", "status")


@query(with_sql("progress", "SELECT time_bucket(INTERVAL '1 hour', updated_at) AS start, status, count(*) AS n FROM progress GROUP BY 1, 2"))
def ext_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = M.run_to_end(spark, M.windowed_counts(_stream(spark, d)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "status", "n")
