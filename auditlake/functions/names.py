"""Scalar functions on names, labels, paths and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(name: Column) -> Column:
    """The last path segment with all but letters and digits as `_`."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), "[^a-zA-Z0-9]", "_")


def project_slug(label: Column, fallback: str = "project") -> Column:
    slug = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def project_label(path: Column) -> Column:
    """The last segment of a path that is not empty, else the one above."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))


def run_timestamp(key: Column) -> Column:
    stamp = F.regexp_extract(key, r"([0-9]{8}_[0-9]{6})", 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def desanitized(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def rule_slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def clean_path(line: Column) -> Column:
    """The first token, without one pair of quotes."""
    token = F.regexp_extract(line, r"^\s*(\S+)", 1)
    return F.when(F.length(token) >= 2, F.regexp_replace(token, "^(['\"])(.*)(['\"])$", "$2")).otherwise(token)


def normalized_path(path: Column) -> Column:
    """Segments without `.` and with `..` applied; null for absolute paths and those that leave the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    zero = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))
    step = lambda s, x: F.when(
        x == "..",
        F.struct(F.when(F.size(s.p) > 0, F.slice(s.p, 1, F.greatest(F.size(s.p) - 1, F.lit(0)))).otherwise(s.p).alias("p"), (s.out | (F.size(s.p) == 0)).alias("out")),
    ).otherwise(F.struct(F.concat(s.p, F.array(x)).alias("p"), s.out.alias("out")))
    folded = F.aggregate(parts, zero, step)
    return F.when(F.startswith(path, F.lit("/")) | folded.out | (F.size(folded.p) == 0), None).otherwise(F.array_join(folded.p, "/"))


def inside(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def first_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).try_cast("long")


def first_float(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def non_negative(text: Column) -> Column:
    return F.greatest(F.coalesce(text.try_cast("long"), F.lit(0)), F.lit(0))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def cache_key(chunk: Column, prompt: Column, name: Column, version: str = "v5") -> Column:
    return F.concat_ws("_", F.lit(version), F.md5(chunk), F.md5(prompt), sanitized(name))


def phase_table(markdown: Column, heading: str = "### Pipeline phases") -> Column:
    """array of (label, status, completed, total): rows of the table under a heading of a Markdown text. Heads, rules
    and rows without two numbers in the third cell are left out; no heading, no rows."""
    section = F.get(F.split(F.get(F.split(markdown, heading), F.lit(1)), r"\n\s*### "), F.lit(0))
    lines = F.filter(F.transform(F.split(section, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")) & ~F.contains(x, F.lit("---")))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    head = lambda c: F.contains(F.lower(c[0]), F.lit("phase")) & F.contains(F.lower(c[1]), F.lit("status"))
    numbers = lambda c: F.regexp_extract_all(c[2], F.lit("([0-9]+)"), F.lit(1))
    good = F.filter(F.filter(cells, lambda c: F.size(c) >= 3), lambda c: ~head(c) & (F.length(c[0]) > 0) & (F.size(numbers(c)) >= 2))
    rows = F.transform(good, lambda c: F.struct(c[0].alias("label"), c[1].alias("status"), numbers(c)[0].try_cast("long").alias("completed"), numbers(c)[1].try_cast("long").alias("total")))
    return F.coalesce(rows, F.array().cast("array<struct<label:string,status:string,completed:bigint,total:bigint>>"))
