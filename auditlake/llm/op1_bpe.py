"""Operator 1, BPE encoding and decoding of a table of texts.

Every row is encoded and decoded where it is read: no shuffle, state bounded by the vocabulary and a
word cache of fixed size. A null text counts as empty; texts have no length limit; repeated rows each
give a row; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.bpe import encoder
from auditlake.llm.common import extended, importable, short, table

#: Tokens decoded at once in a check of the round trip.
DECODE_TOKENS = 1 << 20


def encode_texts(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """`df` with the ids of each text as an array<int> column."""
    importable(df.sparkSession)
    schema = extended(df, **{ids: "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in short(batches, text):
            rows = [np.frombuffer(enc.encode(t or ""), "<i4") for t in batch.column(text).to_pylist()]
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """`df` with the text that each array of ids stands for; null ids give null."""
    importable(df.sparkSession)
    schema = extended(df, **{text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = encoder(vocabulary).vocabulary
        for batch in batches:
            rows = [None if x is None else voc.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        strings = enc.vocabulary.strings.__getitem__
        for batch in short(batches, 1):
            counts, of_ids, of_text = [], [], []
            for t in batch.column(1).to_pylist():
                packed = enc.encode(t or "")
                ids = np.frombuffer(packed, "<u4")
                raw = b"".join(b"".join(map(strings, ids[i : i + DECODE_TOKENS].tolist())) for i in range(0, len(ids), DECODE_TOKENS))
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_text.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
