"""Whole report bodies in Markdown, HTML, JSON and SARIF, as lines in order.

A report is a tree: its head, a summary of severities, files, their chunks, findings. Each node is a row keyed by its path
in the tree, and becomes lines of each format. A line's number comes from sums at two levels (lines of the files before,
then the place within the file), so no window and no row takes a report as a whole. Files are written in that order
by range partition; the order of lines read back is that of part files and of places in them.
`write_reports` deals out findings and not lines, which are many times their size: a task renders what it writes.

Findings: report_id, file_path, score, chunk, severity, title, line. Null titles are empty, other nulls `-`; equal findings
are listed as often as they are there; files go by greatest score, then path; a report without findings has no body."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Severities in order, and their levels. Fixed values.
RANKS = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Info": "warning"}
FORMATS = ("md", "html", "json", "sarif")
HEAD, FOOT = -1, 1 << 40
#: Findings whose lines a task sorts and writes at once.
TASK_FINDINGS = 100_000


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def quoted(c: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.struct(c.alias("x")))
    return F.substring(one, F.lit(6), F.length(one) - 6)


def _lines(kind: Column, case: dict[str, list[Column]]) -> Column:
    out = F.array().cast("array<string>")
    for name, lines in case.items():
        out = F.when(kind == name, F.array(*lines)).otherwise(out)
    return out


def _rank() -> Column:
    rank = F.lit(len(RANKS))
    for i, s in enumerate(RANKS):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    return rank


def _rows(findings: DataFrame) -> DataFrame:
    return findings.select("report_id", "file_path", "score", "chunk", _text("severity").alias("severity"), F.coalesce("title", F.lit("")).alias("title"), "line")


def nodes(findings: DataFrame) -> DataFrame:
    """report_id, file_ord, chunk, kind, rank, title, line, severity, n, file_path, score, last (of its kind in its parent)."""
    rows = _rows(findings).withColumn("rank", _rank())
    files = rows.groupBy("report_id", "file_path").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    order = W.partitionBy("report_id").orderBy(F.desc_nulls_last("score"), "file_path")
    files = files.withColumn("file_ord", F.row_number().over(order).cast("long")).withColumn("last", F.lead("file_ord").over(order).isNull())
    rows = rows.drop("score").join(files.select("report_id", F.col("file_path").alias("_path"), "file_ord"), (F.col("file_path").eqNullSafe(F.col("_path"))) & (files.report_id.eqNullSafe(rows.report_id))).drop(files.report_id)
    place = W.partitionBy("report_id", "file_ord").orderBy(F.desc_nulls_last("chunk"), F.desc("rank"), F.desc("severity"), F.desc("title"), F.desc_nulls_last("line"))
    each = rows.withColumn("last", F.row_number().over(place) == 1).withColumns({"kind": F.lit("finding"), "n": F.lit(1).cast("long"), "score": F.lit(None).cast("double")})
    heads = files.withColumn("kind", F.explode(F.array(F.lit("file"), F.lit("end_file"))))
    chunks = rows.groupBy("report_id", "file_ord", "chunk").agg(F.count("*").alias("n")).withColumn("kind", F.lit("chunk"))
    summary = rows.groupBy("report_id", "severity", "rank").agg(F.count("*").alias("n")).withColumns({"kind": F.lit("severity"), "file_ord": F.lit(HEAD).cast("long")})
    summary = summary.withColumn("last", F.lead("rank").over(W.partitionBy("report_id").orderBy("rank", "severity")).isNull())
    ends = rows.groupBy("report_id").agg(F.count("*").alias("n")).withColumn("kind", F.explode(F.array(F.lit("report"), F.lit("end_summary"), F.lit("end_report"))))
    ends = ends.withColumn("file_ord", F.when(F.col("kind") == "end_report", F.lit(FOOT)).otherwise(F.lit(HEAD)))
    out = each.unionByName(heads, allowMissingColumns=True).unionByName(chunks, allowMissingColumns=True)
    out = out.unionByName(summary, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    return out.drop("_path")


#: Kinds in the order of their lines within a file (or the head), between equal chunks.
KIND_ORDER = ("report", "severity", "end_summary", "file", "chunk", "finding", "end_file", "end_report")


def _case(last: Column, last_file: Column) -> dict[str, dict[str, list[Column]]]:
    """Of each format, the lines of each kind of node. last: of its kind in its parent; last_file: in the report's last file."""
    comma = F.when(last, "").otherwise(",")
    n, title, path, severity, line, chunk = F.col("n").cast("string"), F.col("title"), _text("file_path"), F.col("severity"), _text("line"), _text("chunk")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    score = _text("score")
    level = F.lit("warning")
    for s, v in RANKS.items():
        level = F.when(severity == s, v).otherwise(level)
    lit, cat, report = F.lit, F.concat, _text("report_id")
    return {
        "md": {
            "report": [cat(lit("# Report "), report), lit(""), lit("| Severity | Findings |"), lit("| --- | --- |")],
            "severity": [cat(lit("| "), severity, lit(" | "), n, lit(" |"))],
            "end_summary": [lit("")],
            "file": [cat(lit("## "), path, lit(" ("), score, lit(")")), lit("")],
            "chunk": [cat(lit("### Chunk "), chunk)],
            "finding": [cat(lit("- **["), severity, lit("]** "), title, lit(" (line "), line, lit(")"))],
            "end_file": [lit("")],
            "end_report": [cat(lit("_"), n, lit(" findings_"))],
        },
        "html": {
            "report": [cat(lit("<h1>Report "), report, lit("</h1>")), lit("<table>")],
            "severity": [cat(lit("<tr><td>"), escaped(severity), lit("</td><td>"), n, lit("</td></tr>"))],
            "end_summary": [lit("</table>")],
            "file": [cat(lit("<section><h2>"), escaped(path), lit(" ("), score, lit(")</h2>")), lit("<ul>")],
            "chunk": [cat(lit("<li class=\"chunk\">Chunk "), chunk, lit("</li>"))],
            "finding": [cat(lit("<li><b>"), escaped(severity), lit("</b> "), escaped(title), lit(" (line "), line, lit(")</li>"))],
            "end_file": [lit("</ul></section>")],
            "end_report": [cat(lit("<p>"), n, lit(" findings</p>"))],
        },
        "json": {
            "report": [cat(lit('{"report":'), number("report_id"), lit(","), lit('"summary":{'))],
            "severity": [cat(quoted(severity), lit(":"), n, comma)],
            "end_summary": [lit('},"files":[')],
            "file": [cat(lit('{"path":'), quoted(path), lit(',"score":'), number("score"), lit(',"findings":['))],
            "finding": [cat(lit('{"chunk":'), number("chunk"), lit(',"severity":'), quoted(severity), lit(',"title":'), quoted(title), lit(',"line":'), number("line"), lit("}"), comma)],
            "end_file": [cat(lit("]}"), comma)],
            "end_report": [cat(lit('],"total":'), n, lit("}"))],
        },
        "sarif": {
            "report": [cat(lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"auditlake"}},"properties":{"report":'), number("report_id"), lit('},"results":['))],
            "finding": [cat(lit('{"ruleId":'), quoted(severity), lit(',"level":"'), level, lit('","message":{"text":'), quoted(title), lit('},"locations":[{"physicalLocation":{"artifactLocation":{"uri":'), quoted(path), lit('},"region":{"startLine":'), number("line"), lit("}}}]}"), F.when(last & last_file, "").otherwise(","))],
            "end_report": [lit("]}]}")],
        },
    }


def _floored() -> Column:
    return F.floor(F.col("score") * 1000) / 1000


def rendered(tree: DataFrame) -> DataFrame:
    """(format, report_id, line_no, line) of every report."""
    kind, lit = F.col("kind"), F.lit
    case = _case(F.col("last"), F.col("_last_file"))
    tree = tree.withColumn("score", _floored())
    last_file = tree.filter("kind = 'file'").select(F.col("report_id").alias("_r"), F.col("file_ord").alias("_f"), F.col("last").alias("_last_file"), F.col("file_path").alias("_path"))
    tree = tree.join(last_file, F.col("report_id").eqNullSafe(F.col("_r")) & (F.col("file_ord") == F.col("_f")), "left").withColumn("file_path", F.col("_path"))
    each = F.array(*(F.struct(lit(f).alias("format"), _lines(kind, kinds).alias("lines")) for f, kinds in case.items()))
    at = F.array_position(F.array(*(lit(k) for k in KIND_ORDER)), kind)
    # The heads of a file come before, its ends after all chunks.
    step = F.when(kind.isin("chunk", "finding"), 1).when(kind.isin("file", "report", "severity", "end_summary"), 0).otherwise(2)
    rows = tree.withColumn("x", F.explode(each)).select("x.format", "report_id", "file_ord", step.alias("step"), "chunk", at.alias("kind"), "rank", "severity", "title", "line", F.coalesce("last", F.lit(False)).alias("last"), F.posexplode("x.lines").alias("k", "text"))
    inner = W.partitionBy("format", "report_id", "file_ord").orderBy("step", "chunk", "kind", "rank", "severity", "title", "line", "last", "k")
    rows = rows.withColumn("_own", F.row_number().over(inner))
    files = rows.groupBy("format", "report_id", "file_ord").agg(F.count("*").alias("_n"))
    before = W.partitionBy("format", "report_id").orderBy("file_ord").rowsBetween(W.unboundedPreceding, -1)
    files = files.select(F.col("format").alias("_fmt"), F.col("report_id").alias("_r"), F.col("file_ord").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(files, (F.col("format") == F.col("_fmt")) & F.col("report_id").eqNullSafe(F.col("_r")) & (F.col("file_ord") == F.col("_f")))
    return rows.select("format", "report_id", (F.col("_before") + F.col("_own")).alias("line_no"), F.col("text").alias("line"))


def write_bodies(lines: DataFrame, path: str) -> None:
    """Text files by format and report, their lines in order."""
    order = ["format", "report_id", "line_no"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("format", "report_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("format", "report_id").text(path)


def _late(score: Column) -> Column:
    """A whole number that is the greater, the less the score: its bits in the order of doubles, turned round. Windows by doubles
    normalise them and would be dealt out anew after a range partition by scores."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(score, F.lit(0.0)) + 0.0).cast("long")
    return F.bitwise_not(F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """`df` by way of files in a shared folder, so that its real size is known when it is joined."""
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_reports(findings: DataFrame, path: str) -> None:
    """The lines of `rendered` as gzip text files by format and report, in order. Of the rows only the findings are dealt out, once, by
    report, score and path of their file; their lines are made after that. Beside `path` it leaves the findings and two small tables."""
    rows = _kept(_rows(findings), f"{path}-findings")
    # A file's score is its greatest. Only files with different ones are joined.
    scores = rows.groupBy("report_id", "file_path").agg(F.max("score").alias("_most"), F.min("score").alias("_least"), F.count("score").alias("_c"), F.count("*").alias("_n"))
    mixed = scores.filter(~F.col("_most").eqNullSafe(F.col("_least")) | (F.col("_c").between(1, F.col("_n") - 1)))
    mixed = _kept(mixed.select(F.col("report_id").alias("_r"), F.col("file_path").alias("_path"), "_most"), f"{path}-scores")
    own = rows.report_id.eqNullSafe(mixed._r) & rows.file_path.eqNullSafe(mixed._path)
    rows = rows.join(mixed, own, "left").withColumn("score", F.coalesce("_most", "score")).drop("_r", "_path", "_most")
    # Within a report files go by greatest score, null last, then by path.
    rows = rows.withColumns({"_none": F.col("score").isNull(), "_late": _late(F.col("score"))})
    key = F.struct("_none", "_late", "file_path")
    totals = rows.groupBy("report_id", "severity").agg(F.count("*").alias("n"), F.max(key).alias("_key"))
    totals = _kept(totals, f"{path}-totals")
    reports = totals.groupBy("report_id").agg(F.sum("n").alias("n"), F.max("_key").alias("_last_key"))
    summary = totals.select("report_id", F.lit(0).alias("part"), F.lit("severity").alias("kind"), "severity", "n", F.lead(F.lit(1)).over(W.partitionBy("report_id").orderBy(_rank(), "severity")).isNull().alias("last"))
    ends = reports.select("report_id", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(k).alias("kind")) for p, k in ((0, "report"), (0, "end_summary"), (2, "end_report"))))).alias("x"), "n").select("report_id", "x.*", "n")
    last = F.broadcast(reports.select(F.col("report_id").alias("_r"), "_last_key")) if reports.count() < 100_000 else reports.select(F.col("report_id").alias("_r"), "_last_key")
    each = rows.join(last, rows.report_id.eqNullSafe(last._r), "left").withColumn("last_file", key.eqNullSafe(F.col("_last_key"))).drop("_r", "_last_key")
    each = each.withColumn("part", F.lit(1)).unionByName(summary.unionByName(ends, allowMissingColumns=True), allowMissingColumns=True)
    place = ["report_id", "part", "_none", "_late", "file_path"]
    n = max(findings.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_FINDINGS))
    # Windows over the columns of the ranges need no further shuffle.
    inner = [F.array_position(F.array(*(F.lit(k) for k in KIND_ORDER)), F.col("kind")), "chunk", _rank(), "severity", "title", "line"]
    file = W.partitionBy(*place).orderBy(*inner)
    each = each.repartitionByRange(n, *place)
    each = each.withColumns({"_first": F.row_number().over(file) == 1, "_chunk": ~F.lag("chunk").over(file).eqNullSafe(F.col("chunk")), "_end": F.lead(F.lit(1)).over(file).isNull()})
    each = each.sortWithinPartitions(*place, *inner).withColumn("_seq", F.monotonically_increasing_id()).withColumn("score", _floored())
    none = F.array().cast("array<string>")
    some = lambda when, lines: F.when(when, F.array(*lines)).otherwise(none) if lines else none
    case = {name: _case(x, F.col("last_file")) for name, x in (("head", F.col("last")), ("finding", F.col("_end")), ("end_file", F.col("last_file")))}
    texts = []
    for f in FORMATS:
        own, head = case["finding"][f], case["head"][f]
        finding = F.concat(some(F.col("_first"), own.get("file")), some(F.col("_first") | F.col("_chunk"), own.get("chunk")), F.array(*own["finding"]), some(F.col("_end"), case["end_file"][f].get("end_file")))
        lines = F.when(F.col("part") == 1, finding).otherwise(_lines(F.col("kind"), {k: head[k] for k in ("report", "severity", "end_summary", "end_report") if k in head}))
        texts.append(F.struct(F.lit(f).alias("format"), lines.alias("lines")))
    each = each.select("report_id", "_seq", F.explode(F.array(*texts)).alias("x")).select("x.format", "report_id", "_seq", F.posexplode("x.lines").alias("k", "value"))
    each = each.sortWithinPartitions("format", "report_id", "_seq", "k").select("format", "report_id", "value")
    each.write.mode("overwrite").partitionBy("format", "report_id").option("compression", "gzip").text(path)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (columns _file and _block last) with _own: the place within a block, which one task reads in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, block = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            change = np.zeros(n, bool)
            change[0] = at != (file[0].as_py(), block[0].as_py())
            change[1:] = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1))).to_numpy(zero_copy_only=False)
            starts = np.where(change, np.arange(n, dtype=np.int64), -before)
            own = np.arange(1, n + 1, dtype=np.int64) - np.maximum.accumulate(starts)
            at, before = (file[n - 1].as_py(), block[n - 1].as_py()), int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "_own"])

    return rows.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, _own long")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(format, report_id, line_no, line): part files of a report stand in the order of their names, blocks of a file in that
    of their starts. A line is numbered within its block first, in the task that reads it, and blocks by the lines before them."""
    rows = spark.read.text(path).select("format", F.col("report_id").cast("long").alias("report_id"), F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    block = ["format", "report_id", "_file", "_block"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("format", "report_id").orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).select("_file", "_block", "_before")
    # A row for each block of files: lines stay where they are read.
    return _numbered(rows).join(F.broadcast(counts), ["_file", "_block"]).select("format", "report_id", (F.col("_before") + F.col("_own")).alias("line_no"), "line")
