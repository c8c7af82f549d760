"""Repair of almost-JSON that models write, and probes for texts that have gone astray."""

from __future__ import annotations

import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
#: Texts shorter than this are not probed; ratio and repeats that count as degenerate.
PROBE_CHARS, PROBE_RATIO, UNIT, REPEATS = 1600, 0.115, 14, 17


def balanced(raw: str) -> str:
    """`raw` from its first bracket, without trailing commas, with open strings and brackets closed."""
    start = min((i for i in (raw.find("{"), raw.find("[")) if i >= 0), default=-1)
    if start < 0:
        return ""
    out: list[str] = []
    closers: list[str] = []
    quoted = escaped = False
    for c in raw[start:]:
        if quoted:
            if escaped:
                if c not in '"\\/bfnrtu':
                    out.append("\\")
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
            elif c in "\n\r\t":
                out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
                continue
            out.append(c)
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closers:
                break
            _drop_comma(out)
            if closers[-1] != c:
                continue
            closers.pop()
        out.append(c)
        if not closers and c in "}]":
            break
    if escaped:
        out.append("\\")
    if quoted:
        out.append('"')
    while closers:
        _drop_comma(out)
        out.append(closers.pop())
    return "".join(out)


def _drop_comma(out: list[str]) -> None:
    i = len(out) - 1
    while i >= 0 and out[i].isspace():
        i -= 1
    if i >= 0 and out[i] == ",":
        del out[i]


def repair(raw: str | None) -> str:
    """Valid JSON: the text itself, else repaired, else a minimal object that says so."""
    text = FENCE.sub("", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", raw or ""))
    for attempt in (text, balanced(text)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return json.dumps({"findings": [], "validation_error": True}, sort_keys=True)


def repaired(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(repair)

    return run(column)


def deflate_ratio(column: Column) -> Column:
    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(zlib.compress(t.encode(), 6)) / max(1, len(t.encode())) if t is not None else None).astype("float64")

    return run(column)


def repeats(column: Column) -> Column:
    return column.rlike(rf"(?s)(.{{{UNIT}}})\1{{{REPEATS - 1},}}")


def degenerate(column: Column) -> Column:
    return F.when(F.length(column) < PROBE_CHARS, F.lit(False)).otherwise(repeats(column) | (deflate_ratio(column) < PROBE_RATIO))


def thoughts(text: Column) -> Column:
    """(thoughts, answer): what stands in reasoning tags, and the rest."""
    pattern = r"(?s)<think>(.*?)</think>"
    return F.struct(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)), "\n").alias("thoughts"), F.trim(F.regexp_replace(text, pattern, "")).alias("answer"))
