"""Structured Streaming forms of progress tracking. A run reads what is there and ends (availableNow), or
polls at an interval when one is given."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import importable, shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def poll(spark: SparkSession, folder: str, names: str = "*", schema: str = EVENTS, files_a_batch: int = 100) -> DataFrame:
    """The files of a folder whose names match as a stream; new ones are taken up as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", names).parquet(folder)


def progress_stream(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("completed"))


def latest_progress(events: DataFrame) -> DataFrame:
    """Streaming aggregate: the newest event of each run, updated as events come."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("event_id", "updated_at", "status", "completed"), F.struct("updated_at", "event_id")).alias("e")).select("run_id", "e.*")


def changed_status(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Custom state: the last status of each run; an event is passed on when it differs. Events of a batch are
    put in order first. With `ttl_ms`, state that is not touched for so long goes; such a stream polls on
    and doesn't end by itself."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["updated_at", "event_id"])
        before = rows["status"].shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        out = rows[rows["status"].ne(before) | before.isna()]
        state.update((rows["status"].iloc[-1],))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield out[["run_id", "event_id", "status"]]

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id long, event_id long, status string", "status string", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events by time window and status; later ones than the watermark are left out."""
    timed = events.withColumn("at", F.col("updated_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it has written, as files of the shared folder: in
    complete mode the last batch, else all. A batch that is run again writes over its own files."""
    importable(spark)
    where = f"{shared_folder(spark)}/progress_{uuid.uuid4().hex}"
    done: list[str] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/rows/{batch}")
        done.append(f"{where}/rows/{batch}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    folders = done[-1:] if mode == "complete" else done
    return spark.read.schema(stream.schema).parquet(*folders) if folders else spark.createDataFrame([], stream.schema)
