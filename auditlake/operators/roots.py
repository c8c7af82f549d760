"""Roots of scanned trees, settings from the environment, and report and index sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def relocated(paths: DataFrame, listing: DataFrame, key: str, path: str = "path") -> DataFrame:
    """`key` and the longest suffix of its path that is in the listing (column `entry`); null if none is. Suffixes meet the
    listing by an equi-join, so neither side has to be small."""
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    suffix = paths.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("at", "entry"))
    found = suffix.join(listing.select("entry").distinct(), "entry").groupBy(key).agg(F.min_by("entry", "at").alias("entry"))
    return paths.select(key).distinct().join(found, key, "left")


def stored_root(path: Column, parent: Column) -> Column:
    """A root relative to its parent ('.' for the parent itself), as it is where it lies elsewhere."""
    return F.when(path == parent, ".").when(F.startswith(path, F.concat(parent, F.lit("/"))), F.substr(path, F.length(parent) + 2)).otherwise(path)


def int_setting(raw: Column, default: int, least: int, most: int) -> Column:
    """A whole number within bounds; the default where there is none to read."""
    value = F.expr("try_cast(NULL AS BIGINT)")
    value = F.when(F.regexp_like(raw, F.lit(r"^\s*[+-]?\d{1,18}\s*$")), F.trim(raw).cast("long")).otherwise(value)
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(least)), F.lit(most))


def float_setting(raw: Column, default: float, least: float, most: float) -> Column:
    value = F.when(F.regexp_like(raw, F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$")), F.trim(raw).cast("double"))
    return F.least(F.greatest(F.coalesce(value, F.lit(default)), F.lit(least)), F.lit(most))


def parameter_count(text: Column) -> Column:
    """Parameters of a model by its size mark: 7b, 1.5B, 350m; null without one."""
    number = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*([bm])\b", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*([bm])\b", 2))
    return F.when(number != "", F.round(number.cast("double") * F.when(unit == "b", 1e9).otherwise(1e6)).cast("long"))


def save_index(index: DataFrame, path: str) -> None:
    """The code index as Parquet, partitioned by suffix, so a later selection of suffixes reads only theirs."""
    index.write.mode("overwrite").partitionBy("suffix").parquet(path)


def load_index(spark: SparkSession, path: str, columns: list[str], suffixes: list[str] | None = None) -> DataFrame:
    """A saved index, if it has all `columns`; only of the given suffixes, if any are given."""
    index = spark.read.parquet(path)
    if lacking := [c for c in columns if c not in index.columns]:
        raise ValueError(f"not a code index, it lacks: {', '.join(lacking)}")
    return index.select(columns) if suffixes is None else index.filter(F.col("suffix").isin(suffixes)).select(columns)


def rendered_reports(findings: DataFrame) -> DataFrame:
    """(format, report_id, line): Markdown and HTML lines of each report's severities; one JSON and one SARIF line
    each, in no order; `bodies` renders whole reports in order. findings: report_id, severity, level."""
    by = findings.groupBy("report_id", "severity", "level").agg(F.count("*").alias("n"))
    n = F.col("n").cast("string")
    lines = by.select(
        "report_id",
        F.explode(
            F.array(
                F.struct(F.lit("md").alias("format"), F.concat(F.lit("| "), "severity", F.lit(" | "), n, F.lit(" |")).alias("line")),
                F.struct(F.lit("html").alias("format"), F.concat(F.lit("<tr><td>"), "severity", F.lit("</td><td>"), n, F.lit("</td></tr>")).alias("line")),
                F.struct(F.lit("json").alias("format"), F.to_json(F.struct("severity", "n")).alias("line")),
                F.struct(F.lit("sarif").alias("format"), F.to_json(F.struct(F.col("severity").alias("ruleId"), "level", F.struct(n.alias("text")).alias("message"))).alias("line")),
            )
        ).alias("x"),
    )
    return lines.select("x.format", "report_id", "x.line")


def write_reports(lines: DataFrame, path: str) -> None:
    """Text files by format and report."""
    lines.sortWithinPartitions("format", "report_id", "line").write.mode("overwrite").partitionBy("format", "report_id").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("format", F.col("report_id").cast("long").alias("report_id"), F.col("value").alias("line"))
