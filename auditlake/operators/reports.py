"""Operators over nested report documents. Nested arrays are folded where they are; nothing is exploded
and grouped back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of each severity; unknown ones rank below all.
RANKS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Info": 0}


def rank(severity: Column) -> Column:
    out = F.lit(-1)
    for name, n in RANKS.items():
        out = F.when(F.lower(severity) == name.lower(), F.lit(n)).otherwise(out)
    return out


def level(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").when(s == "low", "note").otherwise("warning")


def all_findings(chunks: Column) -> Column:
    """The findings of all chunks of a file as one array."""
    return F.flatten(F.transform(F.coalesce(chunks, F.array().cast("array<struct<chunk:bigint,findings:array<struct<severity:string,title:string,line:bigint>>>>")), lambda c: c.findings))


def count_where(found: Column, test: object) -> Column:
    return F.size(F.filter(found, test)).cast("long")


def report_statistics(files: DataFrame, by: str = "report_id") -> DataFrame:
    """Files without error, chunks with findings and findings by severity; each counted at its own grain."""
    found = all_findings(F.col("chunk_analyses"))
    row = files.withColumn("_f", found)
    of = lambda s: count_where(F.col("_f"), lambda x: x.severity == s)
    sums = [F.sum(of(s)).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")]
    return row.groupBy(by).agg(F.count_if(F.col("error").isNull()).alias("n_files"), F.sum(F.size("chunk_analyses").cast("long")).alias("n_chunks"), F.sum(F.size("_f").cast("long")).alias("n_findings"), *sums)


def pruned(files: DataFrame, tiers: list[str]) -> DataFrame:
    """Only findings of the tiers; chunks without any go, and files without any but those with an error."""
    wanted = [t.lower() for t in tiers]
    kept = F.transform("chunk_analyses", lambda c: F.struct(c.chunk.alias("chunk"), F.filter(c.findings, lambda f: F.lower(f.severity).isin(wanted)).alias("findings")))
    out = files.withColumn("chunk_analyses", F.filter(kept, lambda c: F.size(c.findings) > 0))
    return out.filter((F.size("chunk_analyses") > 0) | F.col("error").isNotNull())


def worst(files: DataFrame) -> DataFrame:
    """Rank and name of each file's worst severity, and its number of findings."""
    found = all_findings(F.col("chunk_analyses"))
    top = F.array_max(F.transform(found, lambda f: F.struct(rank(f.severity).alias("rank"), f.severity.alias("severity"))))
    return files.withColumn("_t", top).select("report_id", "file_path", F.col("_t.severity").alias("max_severity"), F.coalesce("_t.rank", F.lit(-1)).alias("severity_rank"), F.size(found).cast("long").alias("n_findings"))


def sarif(files: DataFrame, rule: Column) -> DataFrame:
    """Each file's results in the SARIF shape, as JSON."""
    found = all_findings(F.col("chunk_analyses"))
    result = lambda f: F.struct(
        rule.alias("ruleId"), level(f.severity).alias("level"), F.struct(f.title.alias("text")).alias("message"),
        F.struct(F.col("file_path").alias("uri"), f.line.alias("startLine")).alias("location"),
    )
    return files.select("report_id", "file_path", F.to_json(F.transform(F.array_sort(found), result)).alias("results"))


def digest(files: DataFrame, max_chunks: int, max_findings: int, max_chars: int) -> DataFrame:
    """A bounded digest of each file: the first chunks, findings and characters."""
    cut = F.transform(F.slice("chunk_analyses", 1, max_chunks), lambda c: F.transform(F.slice(c.findings, 1, max_findings), lambda f: F.substring(f.title, 1, max_chars)))
    return files.select("report_id", "file_path", F.array_join(F.flatten(cut), "|").alias("digest"))
