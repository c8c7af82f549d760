"""Progress tracking in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("view", "click", "signup", "purchase")


def latest(events: DataFrame, key: str = "run_id") -> DataFrame:
    """The newest event of each run; of equal times the greatest id."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_id", "updated_at", "status", "completed"), F.struct("updated_at", "event_id")).alias("e")).select(key, "e.*")


def newest_wins(sidecar: DataFrame, embedded: DataFrame, key: str = "run_id") -> DataFrame:
    """Full outer merge by time; the sidecar wins ties and where neither has a time."""
    s, e = (x.select(key, F.struct("updated_at", "status", "completed").alias(n)) for x, n in ((sidecar, "s"), (embedded, "e")))
    j = s.join(e, key, "full_outer")
    take_e = F.col("s").isNull() | (F.col("e").isNotNull() & F.coalesce(F.col("e.updated_at") > F.col("s.updated_at"), F.col("s.updated_at").isNull() & F.col("e.updated_at").isNotNull()))
    return j.withColumn("p", F.when(take_e, F.col("e")).otherwise(F.col("s"))).select(key, "p.*", take_e.alias("from_embedded"))


def changes(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Events whose columns differ from those of the one before."""
    w = W.partitionBy(key).orderBy("updated_at", "event_id")
    now = F.struct(*columns)
    return events.withColumn("_p", F.lag(now).over(w)).filter(~F.col("_p").eqNullSafe(now)).drop("_p")


def contract(status: Column, completed: Column, total: Column) -> Column:
    """Known status (else `running`), totals not below what is completed, neither below 0, and whether the
    run is partial."""
    done = F.greatest(F.coalesce(completed, F.lit(0)), F.lit(0))
    whole = F.greatest(F.coalesce(total, F.lit(0)), done)
    known = F.when(status.isin(*STATUSES), status).otherwise("running")
    return F.struct(known.alias("status"), done.alias("completed"), whole.alias("total"), (done < whole).alias("is_partial"))


def throttled(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """The first and the last event of each run, and in between at most one an interval: the first event of
    every interval counted from the run's start."""
    w = W.partitionBy(key).orderBy("updated_at", "event_id")
    start = F.min("updated_at").over(W.partitionBy(key))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    slot = F.floor((micros(F.col("updated_at")) - micros(start)) / (seconds * 1_000_000))
    out = events.withColumn("_slot", slot)
    first = F.row_number().over(W.partitionBy(key, "_slot").orderBy("updated_at", "event_id")) == 1
    last = F.lead("event_id").over(w).isNull()
    return out.withColumn("_keep", first | last).filter("_keep").drop("_keep", "_slot")
