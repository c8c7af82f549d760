"""Operators over the report index: filters, statistics, preferred artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXECUTIVE = "Executive Summary"
DEFAULT_LANGUAGE = "en"
TIERS = ("critical", "high", "medium", "low")
#: Formats, most preferred first.
PREFERENCE = ("json", "html", "md", "pdf", "sarif")


def severity_tokens(csv: Column) -> Column:
    """Known tokens of a list, in order, each once."""
    parts = F.transform(F.split(csv, ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x.isin(*TIERS)))


def any_substring(column: Column, wanted: list[str]) -> Column:
    out = F.lit(False)
    for w in wanted:
        out = out | F.contains(F.lower(column), F.lit(w.lower()))
    return out


def project_key(column: Column) -> Column:
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def filtered(index: DataFrame, *, models: list[str] | None = None, types: list[str] | None = None, formats: list[str] | None = None, languages: list[str] | None = None, project: str | None = None, severities: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A conjunction of the filters given; executive rows pass those of type and severity."""
    executive = F.col("vulnerability_type") == EXECUTIVE
    out = index
    if models:
        out = out.filter(any_substring(F.col("model"), models))
    if types:
        out = out.filter(executive | any_substring(F.col("vulnerability_type"), types))
    if formats:
        out = out.filter(F.col("format").isin(*formats))
    if languages:
        out = out.filter(F.coalesce("language", F.lit(DEFAULT_LANGUAGE)).isin(*languages))
    if project:
        out = out.filter(project_key(F.col("project")) == project.strip().lower())
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.filter(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
    if severities:
        any_of = F.lit(False)
        for s in severities:
            any_of = any_of | (F.col(s) > 0)
        out = out.filter(executive | ((F.col("format") == "json") & any_of))
    return out


def statistics(index: DataFrame) -> DataFrame:
    """Counts by model, type and day of JSON reports, and by format of all, in one pass: dimension, value, n
    and the severity sums."""
    json = F.when(F.col("format") == "json", 1)
    day = F.date_format("date", "yyyy-MM-dd")
    rows = index.select(
        F.explode(
            F.array(
                F.struct(F.lit("model").alias("dimension"), F.col("model").alias("value"), json.isNotNull().alias("counts")),
                F.struct(F.lit("type").alias("dimension"), F.col("vulnerability_type").alias("value"), json.isNotNull().alias("counts")),
                F.struct(F.lit("date").alias("dimension"), day.alias("value"), json.isNotNull().alias("counts")),
                F.struct(F.lit("format").alias("dimension"), F.col("format").alias("value"), F.lit(True).alias("counts")),
                F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"), json.isNotNull().alias("counts")),
            )
        ).alias("r"),
        *TIERS,
    )
    return rows.filter("r.counts").groupBy("r.dimension", "r.value").agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TIERS))


def alternatives(index: DataFrame, key: list[str]) -> DataFrame:
    """Every artifact with the formats that its report has, and the most preferred one."""
    priority = F.array_position(F.array(*(F.lit(f) for f in PREFERENCE)), F.col("format"))
    groups = index.groupBy(*key).agg(F.array_sort(F.collect_set("format")).alias("formats"), F.min_by("report_key", F.struct(priority, "report_key")).alias("preferred_key"), F.bool_or(F.col("format") == "json").alias("has_json"))
    return index.join(groups, key)


def suffix_match(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """asked: id, path. keys: key. Each path's best key of the same last segment: equal 0, one a suffix of
    the other 1, else 2; of equal rank the least key."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    j = asked.withColumn("_l", last(F.col("path"))).join(keys.select("key", last(F.col("key")).alias("_l")), "_l")
    slash = lambda c: F.concat(F.lit("/"), c)
    suffix = F.endswith("path", slash(F.col("key"))) | F.endswith("key", slash(F.col("path")))
    rank = F.when(F.col("path") == F.col("key"), 0).when(suffix, 1).otherwise(2)
    return j.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "key")).alias("m")).select("id", "m.key", "m.rank")
