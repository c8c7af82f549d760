"""The corpus pipeline: language identification, near-duplicate removal, removal of repeated passages,
redaction of secrets, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, importable, short, table, text_bytes
from auditlake.llm.op4_suffix_dedup import kept_parts, merged, with_stretches
from auditlake.llm.op6_language import UNDETERMINED, predictions, training_sample
from auditlake.llm.op7_secrets import redacted, scanned
from auditlake.llm.op8_neardup import near_duplicates
from auditlake.llm.op9_packing import pack


def _with_text(batch: pa.RecordBatch, columns: list[str], texts: list[str | None], rows: list[int] | None = None) -> pa.RecordBatch:
    """The batch's `columns` with new texts, their lengths in n_chars if there is such a column."""
    new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
    return pa.RecordBatch.from_arrays([new[c].cast(batch.schema.field(c).type) if c in new else batch.column(c) for c in columns], names=columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no text, or no letter in it) go. Each text goes to Python once, in its own row."""
    importable(spark)
    sample, at = training_sample(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, at, 1024):
            known = [found != UNDETERMINED for found, _ in predictions(batch, at, sample)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of least doc_id."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    stay = docs.join(gone, "doc_id", "left_anti")
    # Rows that repeat a doc_id are one document.
    named = stay.filter("doc_id is not null").dropDuplicates(["doc_id"])
    return named.union(stay.filter("doc_id is null")).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go; a document of which nothing is left goes."""
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, at):
            texts = []
            for raw, cut in zip(text_bytes(batch.column("text")), batch.column("_auditlake_cut").to_pylist(), strict=True):
                # A code point that a cut splits goes too.
                texts.append(None if raw is None else kept_parts(raw, merged(cut or [])).decode("utf-8", "ignore"))
            yield _with_text(batch, columns, texts)

    return with_stretches(docs).mapInArrow(run, schema).filter("text is null or text != ''")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    importable(spark)
    columns, schema = docs.columns, docs.schema
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, spans in scanned(batches, at):
            null = batch.column(at).is_null().to_pylist()
            yield _with_text(batch, columns, [None if n else redacted(t.decode("utf-8", "replace"), s) for n, t, s in zip(null, texts, spans, strict=True)])

    return docs.mapInArrow(run, schema)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL expresses neither the models nor the searches.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
