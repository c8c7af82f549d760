"""Stages that call a model, through interfaces with deterministic stand-ins. Inputs come in Arrow batches;
one client serves a partition."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.jsonfix import repair
from auditlake.operators.patterns import CATALOG, any_of

#: Calls of the deep model for one chunk, at most; the least size a text is shrunk to for the embedder.
DEEP_ATTEMPTS = 3
LEAST_CHARS = 256


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Triage(Protocol):
    def verdict(self, text: str) -> str: ...


class Deep(Protocol):
    def analyse(self, text: str, attempt: int) -> str: ...


class TooLong(Exception):
    """A text beyond the model's context."""


class HashEmbedder:
    """Counts of words by hash bucket, as a unit vector."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in re.findall(r"[a-z]+", t.lower()) or [""]:
                v[hashlib.md5(w.encode()).digest()[0] % self.dims] += 1
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class PatternTriage:
    """Suspicious where a pattern of the kinds matches."""

    def __init__(self, kinds: list[str], group: str = "sink") -> None:
        self.patterns = [re.compile(any_of(CATALOG[group][k])) for k in kinds]

    def verdict(self, text: str) -> str:
        return "SUSPICIOUS" if any(p.search(text) for p in self.patterns) else "CLEAN"


class StubDeep:
    """One finding a text; now and then the JSON is fenced and cut."""

    def analyse(self, text: str, attempt: int) -> str:
        body = json.dumps({"findings": [{"title": text[:20], "severity": "Low"}]})
        return f"```json\n{body[:-1]}\n```" if len(text) % 3 == 0 else body


def verdict(raw: Column) -> Column:
    """SUSPICIOUS, CLEAN or ERROR: nothing said is an error, anything unknown is clean."""
    word = F.upper(F.regexp_extract(F.trim(raw), "^([A-Za-z]*)", 1))
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "ERROR").when(word.isin("SUSPICIOUS", "ERROR"), word).otherwise("CLEAN")


def _embed_one(client: Embedder, text: str) -> list[float] | None:
    """Halves a text that is too long for the model until it fits or would be too short."""
    while True:
        try:
            return client.embed([text])[0]
        except TooLong:
            if len(text) // 2 < LEAST_CHARS:
                return None
            text = text[: len(text) // 2]


def embed(files: DataFrame, client: Embedder) -> DataFrame:
    """(key, embedding) of (key, text)."""
    key = files.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            try:
                vectors: list = client.embed(texts)
            except TooLong:
                vectors = [_embed_one(client, t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "embedding"])

    return files.mapInArrow(run, f"{key} {files.schema[0].dataType.simpleString()}, embedding array<double>")


def triage(files: DataFrame, client: Triage) -> DataFrame:
    """(key, verdict) of (key, text)."""
    key = files.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([client.verdict(t or "") for t in b.column(1).to_pylist()], pa.string())], names=[key, "verdict"])

    return files.mapInArrow(run, f"{key} {files.schema[0].dataType.simpleString()}, verdict string")


def _deep_one(client: Deep, text: str) -> tuple[str, int, str]:
    """Call, validate, repair; again if that fails; at last a fallback that says so."""
    for attempt in range(1, DEEP_ATTEMPTS + 1):
        raw = client.analyse(text, attempt)
        try:
            return json.dumps(json.loads(raw), sort_keys=True), attempt, "ok"
        except ValueError:
            fixed = repair(raw)
            if "validation_error" not in json.loads(fixed):
                return fixed, attempt, "repaired"
    return fixed, DEEP_ATTEMPTS, "fallback"


def deep(files: DataFrame, client: Deep) -> DataFrame:
    """(key, payload, attempts, status) of (key, text)."""
    key = files.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_deep_one(client, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string())))], names=[key, "payload", "attempts", "status"])

    return files.mapInArrow(run, f"{key} {files.schema[0].dataType.simpleString()}, payload string, attempts int, status string")


_STARTS = re.compile(r"^(\s*)(?:async\s+)?(?:def|function|func|fn|sub)\s+([A-Za-z0-9_]+)\s*\(", re.M)


def function_spans(text: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line): to the matching brace where one opens on the line, else as far as
    lines are indented deeper."""
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines):
        m = _STARTS.match(line)
        if not m:
            continue
        last = i
        if "{" in line:
            depth = 0
            for j in range(i, len(lines)):
                depth += lines[j].count("{") - lines[j].count("}")
                last = j
                if depth <= 0:
                    break
        else:
            indent = len(m[1])
            for j in range(i + 1, len(lines)):
                if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    break
                if lines[j].strip():
                    last = j
        out.append((m[2], i + 1, last + 1))
    return out


def functions(files: DataFrame, key: str) -> DataFrame:
    """(key, name, start_line, end_line) of every function of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *f) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in function_spans(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.string()), (2, pa.int32()), (3, pa.int32())))], names=[key, "name", "start_line", "end_line"])

    return files.mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, name string, start_line int, end_line int")
